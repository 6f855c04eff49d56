"""Language identification of spans.

The script of a word narrows the languages; each word has a score for each of them from the letter trigrams that labelled texts
have; and a Viterbi pass with a penalty for each switch labels the words of a text, so that a mixed text falls into spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.bpe import LETTER, classes
from evspark.llm.common import per_text, slices, small_batches

#: Labelled texts to learn from, about: a bounded sample by a hash of the text's id.
TRAIN_ROWS = 8000
#: Trigrams fall into so many slots. SWITCH: what a change of language costs, in nats.
SLOTS, SWITCH = 1 << 15, 8.0
#: Languages with less than this share of a script's letters are not tried on its words.
SCRIPT_SHARE = 0.001
UNDETERMINED = "und"
#: Code points at a time; characters times languages at a time.
WINDOW, SCORES = 1 << 19, 1 << 23
#: Rows at a time where whole rows are passed on.
PASSED = 512
#: Where blocks of a script begin. Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai and Lao, other, Georgian, Hangul, other, Latin, Greek, other, kana, Han, other, Hangul, other.
SCRIPT_FROM = [0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0xF00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3400, 0xA000, 0xAC00, 0xD7B0]
SCRIPT_IS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 8, 0, 1, 8, 11, 12, 8, 10, 8]
SCRIPTS = 13


def _trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of windows over the texts: each letter's trigram slot; where words begin among the letters; each word's text; each word's script."""
    group: list[int] = []
    size = 0

    def scan(which: list[int], parts: list[str]):
        points = np.frombuffer("\n".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        letter = classes()[points] == LETTER
        c = np.where(letter, points, 0)
        before, after = np.concatenate([[0], c[:-1]]).astype(np.uint64), np.concatenate([c[1:], [0]]).astype(np.uint64)
        at = np.flatnonzero(letter)
        h = before[at] * np.uint64(0x9E3779B1) + c[at] * np.uint64(0x85EBCA77) + after[at] * np.uint64(0xC2B2AE3D)
        slots = (((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) >> np.uint64(12)).astype(np.int64) % SLOTS
        begins = np.flatnonzero(before[at] == 0)
        ends = np.cumsum([len(p) + 1 for p in parts])
        owner = np.array(which)[np.searchsorted(ends, at[begins], side="right")] if len(begins) else np.empty(0, np.int64)
        script = np.array(SCRIPT_IS)[np.searchsorted(SCRIPT_FROM, points[at[begins]].astype(np.int64), side="right") - 1]
        return slots, begins, owner, script

    parts: list[str] = []
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), WINDOW):  # a long text is cut where a window ends; at most one word in so many letters is split
            part = t[lo : lo + WINDOW]
            if parts and size + len(part) > WINDOW:
                yield scan(group, parts)
                group, parts, size = [], [], 0
            group.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield scan(group, parts)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # SLOTS x languages: log shares
    tried: np.ndarray  # SCRIPTS x languages: whether to try

    def word_scores(self, slots: np.ndarray, begins: np.ndarray, script: np.ndarray) -> np.ndarray:
        if not len(begins):
            return np.zeros((0, len(self.langs)), np.float32)
        scores = np.add.reduceat(self.weights[slots], begins, axis=0)
        tried = self.tried[script]
        known = tried.any(axis=1)  # a word of a script that no language has says nothing
        return np.where(known[:, None], np.where(tried, scores, scores.min(axis=1, keepdims=True) - 50), 0).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word, for many texts together; `counts` are their numbers of words. All texts move on word by word, the shorter ones drop out."""
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-counts, kind="stable")
    length = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")  # texts with more than t words
    small = np.uint8 if scores.shape[1] <= 256 else np.uint32
    back = np.zeros(scores.shape, small)
    own = np.arange(scores.shape[1], dtype=small)
    best = np.zeros((len(counts), scores.shape[1]), np.float32)
    final = np.zeros(len(counts), np.int64)
    for t, k in enumerate(active.tolist()):
        at = first[:k] + t
        b = best[:k]
        if t:
            top = b.argmax(axis=1)
            change = b[np.arange(k), top] - switch
            stay = b >= change[:, None]
            back[at] = np.where(stay, own, top[:, None].astype(small))
            b = np.where(stay, b, change[:, None])
        best[:k] = b + scores[at]
    final = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        labels[at] = final[:k]
        if t:
            final[:k] = back[at, final[:k]]
    return labels


def identify(model: Model, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """Of each text: language, score, spans (first word, number of words, language). Words are runs of letters."""
    if not model.langs:
        yield from ((UNDETERMINED, 0.0, []) for _ in texts)
        return
    texts = [t.lower() for t in texts]
    at, size, n = 0, 0, len(texts)
    for i in range(n):
        size += len(texts[i])
        if i + 1 == n or size * len(model.langs) > SCORES:
            yield from _identify(model, texts[at : i + 1])
            at, size = i + 1, 0


def _identify(model: Model, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    scores, owners, letters = [], [], []
    for slots, begins, owner, script in _trigrams(texts):
        scores.append(model.word_scores(slots, begins, script))
        owners.append(owner)
        letters.append(np.diff(np.append(begins, len(slots))))
    s, owner, size = np.concatenate(scores), np.concatenate(owners).astype(np.int64), np.concatenate(letters)
    counts = np.bincount(owner, minlength=len(texts))
    labels = viterbi(s, counts)
    k = len(model.langs)
    share = np.bincount(owner * k + labels, weights=size, minlength=len(texts) * k).reshape(len(texts), k)
    total = np.stack([np.bincount(owner, weights=s[:, j], minlength=len(texts)) for j in range(k)], axis=1)
    end = np.cumsum(counts)
    for i in range(len(texts)):
        if not counts[i]:
            yield UNDETERMINED, 0.0, []
            continue
        best = int(share[i].argmax())
        rest = np.delete(total[i], best)
        margin = float(total[i][best] - rest.max()) if len(rest) else 30.0
        sure = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        own = labels[end[i] - counts[i] : end[i]]
        cut = np.flatnonzero(np.diff(own)) + 1
        bounds = [0, *cut.tolist(), len(own)]
        spans = [(a, b - a, model.langs[int(own[a])]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield model.langs[best], float(share[i][best] / share[i].sum() * max(0.5, sure)), spans


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """From rows with a text and a language. Tasks count trigrams, Spark adds the counts, and languages x SLOTS sums come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PASSED):
            langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                grams, scripts = np.zeros(SLOTS, np.int64), np.zeros(SCRIPTS, np.int64)
                for slots, begins, _, script in _trigrams([t.lower() for t, x in zip(texts, langs, strict=True) if x == lang]):
                    grams += np.bincount(slots, minlength=SLOTS)
                    if len(begins):
                        scripts += np.bincount(script, weights=np.diff(np.append(begins, len(slots))), minlength=SCRIPTS).astype(np.int64)
                every = np.concatenate([grams, scripts])
                at = np.flatnonzero(every)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(every[at])], ["lang", "at", "n"])

    small_batches(labelled.sparkSession)
    known = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = known.mapInArrow(run, "lang string, at long, n long")
    rows = counted.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    sums = np.zeros((SLOTS + SCRIPTS, len(langs)))
    sums[rows["at"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = rows["n"]
    grams = sums[:SLOTS] + 0.1
    weights = np.log(grams / grams.sum(axis=0)).astype(np.float32)
    if len(langs):
        weights -= weights.mean(axis=1, keepdims=True)
    tried = sums[SLOTS:] > SCRIPT_SHARE * sums[SLOTS:].sum(axis=1, keepdims=True)
    return Model(langs, weights, tried)


def sample(docs: DataFrame, usable: str, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """About `rows` of the labelled rows for which the SQL condition `usable` holds, by a hash of their id. Rows without text, language or id teach nothing."""
    known = docs.filter(usable).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = known.count()
    return known.filter(F.pmod(F.xxhash64(id_col), F.lit(-(-n // rows) or 1)) == 0)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), spans: bool = True) -> DataFrame:
    """One row per row of `docs`: id, the columns `extra`, lang_pred, score and, if asked for, spans.

    `und` with score 0 if the text is null or has no letter, or if nothing was learned. The score is the share of the text's letters
    in spans of the language, times how sure the whole text's trigrams are of it. Equal texts get equal results.
    """

    def work(texts: list[str]) -> list:
        got = list(identify(model, texts))
        found = [[x[0] for x in got], [x[1] for x in got]]
        return [*found, [[{"first_word": a, "n_words": b, "lang": c} for a, b, c in x[2]] for x in got]] if spans else found

    kinds = [("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])))]
    return per_text(docs, id_col, text_col, pa.schema(kinds if spans else kinds[:2]), work, extra, PASSED)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose language is not `und`, with all their columns; a null language is filled in by the predicted one."""

    small_batches(docs.sparkSession)
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PASSED):
            found = pa.array([x[0] for x in identify(model, [t or "" for t in part.column(at).to_pylist()])], pa.string())
            lang = pc.coalesce(part.column(lang_at), found.cast(part.schema.field(lang_at).type))
            yield part.set_column(lang_at, part.schema.field(lang_at), lang).filter(pc.not_equal(found, UNDETERMINED))

    return docs.mapInArrow(run, docs.schema)
