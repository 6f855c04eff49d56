"""Scalar text functions as Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{3400}-\x{9fff}]"
NOT_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = "。！？!?；;"
#: What counts as white space around a text.
SPACE = " \t\n\x0b\f\r\u3000"
#: Function words that lexical search leaves out.
STOP_WORDS = [
    "的", "了", "是", "在", "和", "与", "或", "及", "有", "我", "你", "他", "它",
    "这", "那", "什么", "怎么", "如何", "为什么", "请问", "一下", "可以", "需要",
    "以及", "并且", "但是", "如果", "那么", "就", "都", "很", "把", "被", "给",
    "上", "下", "中", "个", "吗", "呢", "吧", "啊", "么", "对", "从", "到", "为",
    "the", "a", "an", "of", "to", "is", "are", "and", "or", "in", "on", "for",
    "how", "what", "why", "do", "does", "i", "you", "it", "this", "that",
]
#: White space and punctuation that a normalised question leaves out.
QUESTION_NOISE = r"[\s，。？！、；：,.?!;:\"'（）()\[\]【】《》<>「」『』~～\-—_]+"
#: Shapes of secrets and what is left of them.
SECRETS = [
    (r"sk-[A-Za-z0-9_\-]{6,}", "sk-***"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._\-]{8,}", "$1***"),
    (r"(?i)(api[_-]?key\"?\s*[:=]\s*\"?)[A-Za-z0-9._\-]{6,}", "$1***"),
]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def found(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))


def clean_text(text: Column | str) -> Column:
    """Without control characters, page-number lines, hyphen breaks and runs of white space. Null stays null."""
    # The patterns of this function
    t = F.regexp_replace(_col(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(F.regexp_replace(t, "\r\n", "\n"), "\r", "\n")
    t = F.regexp_replace(t, r"([A-Za-z])-\n([a-z])", "$1$2")
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"[ \t\x{3000}]+$", ""))
    lines = F.filter(lines, lambda x: ~x.rlike(r"^[ \t\-—–]*[0-9]{1,4}[ \t\-—–]*$"))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"[ \t\x{3000}]{2,}", " "))
    t = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^[ \t\n\x{3000}]+|[ \t\n\x{3000}]+$", "")


def doc_id(title: Column | str, version: Column | str, path: Column | str) -> Column:
    """Stable id of a document."""
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(_col(x), F.lit("")) for x in (title, version, path)))), 1, 12))


def chunk_id(doc: Column | str, page: Column | str, section: Column | str, index: Column | str, text: Column | str) -> Column:
    """Stable id of a chunk, from its place and its first 80 characters."""
    parts = [_col(doc), _col(page).cast("string"), F.coalesce(_col(section), F.lit("")), _col(index).cast("string"), F.substring(_col(text), 1, 80)]
    return F.concat(F.lit("c_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))


def estimate_tokens(text: Column | str) -> Column:
    """One token for a CJK character, 1.3 for an ASCII word, and one; 0 for no text."""
    t = _col(text)
    n = F.regexp_count(t, F.lit(CJK)) * 10 + F.regexp_count(t, F.lit("[A-Za-z0-9_]+")) * 13
    return F.when(t.isNull() | (t == ""), 0).otherwise(F.floor(n / 10).cast("int") + 1)


def search_text(section: Column | str, heading: Column | str, text: Column | str) -> Column:
    """What is indexed of a chunk: section, heading and text, without the empty ones."""
    return F.concat_ws(" ", *(F.nullif(_col(x), F.lit("")) for x in (section, heading, text)))


def split_sentences(text: Column | str) -> Column:
    """Sentences, with their end marks, trimmed; empty ones left out."""
    marked = reduce(lambda t, mark: F.replace(t, F.lit(mark), F.lit(mark + "\u001f")), SENTENCE_END, _col(text))
    return F.filter(F.transform(F.split(marked, "\u001f"), trimmed), lambda x: x != "")


def trimmed(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(SPACE))


def _pairs(run: Column) -> Column:
    """Neighbouring characters, in one pass over the characters."""
    chars = F.split(run, "")
    n = F.greatest(F.length(run) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))


def tokenize(text: Column | str) -> Column:
    """Lower-cased ASCII words, and of CJK runs the characters and neighbouring pairs, without stop words; repeats stay."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    cjk = F.flatten(F.transform(found(t, f"{CJK}+"), lambda run: F.concat(F.split(run, ""), _pairs(run))))
    return F.filter(F.concat(cjk, found(t, "[a-z0-9_]+")), lambda x: ~x.isin(STOP_WORDS))


_WORD, _RUN, _STOPPED = re.compile("[a-z0-9_]+"), re.compile("[\u3400-\u9fff]+"), frozenset(STOP_WORDS)


def tokens_of(low: str) -> list[str]:
    """What `tokenize` makes of a text, in any order, for use in tasks; the text is lower-cased already."""
    found_here = _WORD.findall(low)
    for run in () if low.isascii() else _RUN.findall(low):
        found_here += [*run, *map("".join, zip(run, run[1:], strict=False))]
    return [t for t in found_here if t not in _STOPPED]


def normalized(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), NOT_WORD, "")


def char_bigrams(text: Column | str) -> Column:
    """The set of neighbouring character pairs of the text without punctuation; of one character, itself."""
    t = normalized(text)
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) == 1, F.array(t)).otherwise(F.array_distinct(_pairs(t)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the set `a` that `b` has; 0 for an empty `a`."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def normalize_question(text: Column | str, limit: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), QUESTION_NOISE, ""), 1, limit)


def mask_secrets(text: Column | str, more: list[tuple[str, str]] = ()) -> Column:
    """Keys and tokens made unreadable, also those of the shapes in `more`."""
    t = F.coalesce(_col(text), F.lit(""))
    for pattern, left in [*SECRETS, *more]:
        t = F.regexp_replace(t, pattern, left)
    return t


def truncate(text: Column | str, limit: int, suffix: str = "…") -> Column:
    t = trimmed(F.coalesce(_col(text), F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"\s+$", ""), F.lit(suffix)))


def title(text: Column | str, limit: int = 30, default: str = "新会话") -> Column:
    t = truncate(text, limit, "")
    return F.when(t == "", F.lit(default)).otherwise(t)


def to_iso(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def from_iso(text: Column | str) -> Column:
    """ISO-8601 text as UTC; text without a zone is UTC, other text null. The session's time zone must be UTC."""
    return F.try_to_timestamp(_col(text))


def rounded(x: Column | str, digits: int) -> Column:
    """As SQL rounds a double: the scaled double goes to the nearest whole number, halves away from zero, and a zero keeps its sign. Spark's `round` goes by the decimal digits of the double, which may be just under a half."""
    scale = 10.0**digits
    r = F.round(_col(x) * scale) / scale
    return F.when(r == 0, _col(x) * 0.0).otherwise(r)


def l2_normalize(v: Column | str) -> Column:
    """A vector by its length; a vector of zeros stays."""
    x = F.transform(_col(v), lambda a: a.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))
    return F.transform(x, lambda a: F.when(norm > 0, a / norm).otherwise(a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def version_key(version: Column | str) -> Column:
    """The numbers of a version, for comparison number by number."""
    numbers = F.transform(found(F.coalesce(_col(version), F.lit("")), "[0-9]+"), lambda x: x.cast("long"))
    return F.when(F.size(numbers) == 0, F.array(F.lit(0).cast("long"))).otherwise(numbers)
