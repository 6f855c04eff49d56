"""Quality rules in a short-circuit cascade.

A first pass over a sample measures what each rule costs and how many texts it rejects; the rules then run in the order of rejection
per cost, and a text that a rule has rejected sees no later one. A text is kept if no rule rejects it, so that the order changes the
work and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import per_text
from evspark.llm.textscan import WHITE, groups, windows, words_of

SYMBOLS = b"#*$%&|<>"
#: Texts of the sample that sets the order of the rules; it never sets a verdict.
SAMPLE, TIMES = 400, 3


def base_features(texts: list[bytes]) -> pd.DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text in UTF-8."""
    out = []
    for lo, hi in groups(texts):
        part = texts[lo:hi]
        h, counts = words_of(part)
        hashes, first, owner = windows(h, counts, 5)
        key = hashes + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, first[twice], 1)
        np.add.at(cover, first[twice] + 5, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        ends = np.cumsum(counts)
        n_repeat = covered[ends] - covered[ends - counts]
        for t, n, r in zip(part, counts.tolist(), n_repeat.tolist(), strict=True):
            bare = t.translate(None, WHITE)
            lines = [x for x in t.split(b"\n") if x.strip(WHITE)]
            out.append((n, len(bare.decode()), len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines)), r))
    got = pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]).astype("int64")
    got["base_failed"] = (got["n_words"] < 10) | (100 * got["n_repeat_words"] > 20 * got["n_words"])
    return got


def _lines(t: bytes) -> list[bytes]:
    return [x for x in t.split(b"\n") if x.strip(WHITE)]


#: Each rule says which of the texts (in UTF-8, with their base features) it rejects. Bounds are wide: only plain junk is to go.
Rule = Callable[[list[bytes], pd.DataFrame], np.ndarray]
RULES: dict[str, Rule] = {
    "symbols": lambda texts, base: (10 * base["n_symbols"] > base["word_chars"]).to_numpy(),
    "word_length": lambda texts, base: ((base["word_chars"] < 2 * base["n_words"]) | (base["word_chars"] > 20 * base["n_words"])).to_numpy(),
    "same_lines": lambda texts, base: np.array([n >= 4 and 2 * n > len(_lines(t)) for t, n in zip(texts, base["n_dup_lines"], strict=True)], bool),
    "letters": lambda texts, base: np.array([2 * sum(map(str.isalpha, t.decode())) < n for t, n in zip(texts, base["word_chars"], strict=True)], bool),
    "ellipses": lambda texts, base: np.array([len(x) >= 4 and 2 * sum(y.rstrip(WHITE).endswith((b"...", "…".encode())) for y in x) > len(x) for x in map(_lines, texts)], bool),
    "digits": lambda texts, base: np.array([2 * (len(t) - len(t.translate(None, b"0123456789"))) > n for t, n in zip(texts, base["word_chars"], strict=True)], bool),
}


def rule_order(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES, sample: int = SAMPLE) -> list[str]:
    """The rules' names by rejections per second on at most `sample` texts: those of the least hash, so that all files take part. A rule's cost is the median of TIMES runs."""
    own = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).withColumn("by", F.xxhash64("text"))
    texts = [r[0].encode() for r in own.orderBy("by").limit(sample).select("text").collect()]
    base = base_features(texts)
    worth = []
    for name, rule in rules.items():
        costs = []
        for _ in range(TIMES):
            began = time.perf_counter()
            rejected = int(rule(texts, base).sum()) if texts else 0
            costs.append(time.perf_counter() - began)
        worth.append(((rejected + 0.5) / (float(np.median(costs)) + 1e-6), name))
    return [name for _, name in sorted(worth, reverse=True)]


def cascade(texts: list[bytes], base: pd.DataFrame, order: list[str], rules: dict[str, Rule] = RULES) -> list[str | None]:
    """The first rule in `order` that rejects each text, or None. A rule sees only the texts that are left."""
    by: list[str | None] = ["base" if x else None for x in base["base_failed"]]
    left = np.flatnonzero(~base["base_failed"].to_numpy(bool))
    for name in order:
        if not len(left):
            break
        bad = rules[name]([texts[i] for i in left], base.iloc[left])
        for i in left[bad]:
            by[i] = name
        left = left[~bad]
    return by


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: id, the base features, base_failed, kept.

    A null or empty text has no words and fails the base. Each text is judged alone, so repeated rows are judged alike. `order`
    gives the rules' names instead of the sample.
    """
    order = order or rule_order(docs, text_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]

    def work(texts: list[str]) -> list:
        raw = [t.encode() for t in texts]
        base = base_features(raw)
        return [*(base[c].to_numpy() for c in names), [x is None for x in cascade(raw, base, order)]]

    made = pa.schema([*((c, pa.int64()) for c in names[:-1]), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
    return per_text(docs, id_col, text_col, made, work)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
x AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS k, w FROM w),
win AS (SELECT doc_id, k, w[k:k + 4] AS win FROM x),
often AS (SELECT doc_id, win FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS place FROM win SEMI JOIN often USING (doc_id, win)) GROUP BY 1),
b AS (SELECT w.doc_id, t, lines, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > word_chars) AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words)
  AND NOT (n_dup_lines >= 4 AND 2 * n_dup_lines > len(lines)) AND NOT 2 * len(regexp_extract_all(t, '\p{L}')) < word_chars
  AND NOT (len(lines) >= 4 AND 2 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) > len(lines))
  AND NOT 2 * len(regexp_extract_all(t, '[0-9]')) > word_chars AS kept
FROM f
"""
