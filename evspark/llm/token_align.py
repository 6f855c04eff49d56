"""Two tokenizers' ids of the same texts, aligned by bytes.

Tokens and the bytes that they cover are incidence matrices in compressed sparse rows. The product of A's matrix with the transpose
of B's, row by row after Gustavson, has an entry for each pair of tokens that overlap, and its value is the number of bytes that
they share. Where tokens of both end, groups end; the product of the tokens' incidence with groups has the pairs of a group.

Texts are cut where neither tokenizer can join what is on both sides (`Pair.cut` says where), so that cuts are ends of groups; the
ids of a piece are made once and kept in a bounded cache. Ids are stored, and links are made again from them when counts of
the whole corpus are known.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructField, StructType

from evspark.llm.common import per_text, slices, small_batches, written

#: Nonzeros that a product has in hand at a time; pairs that a task counts before it hands them on, and pairs in a row of them.
WINDOW, COUNTED, PAIRS_A_ROW = 1 << 22, 1 << 21, 1 << 15
#: Pieces of a generation of a worker's cache (it holds two), and the characters of the longest.
CACHE_PIECES, CACHE_CHARS = 150_000, 48
#: Counts of at most so many pairs are broadcast (16 bytes each); those of other pairs are joined.
BROADCAST_PAIRS = 1 << 20
#: Letters that every version of Unicode has as such, and marks that texts are cut at after them, where B joins no letter with the mark.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,;:!?&$%*#|)\"]>"
_WORD = re.compile(f" ?[{LETTERS}]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Rows:
    """A 0/1 matrix in compressed sparse rows: row i has the columns indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray

    def __len__(self) -> int:
        return len(self.indptr) - 1


def spans(lengths: np.ndarray) -> Rows:
    """Tokens x bytes, for tokens that follow each other."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return Rows(ends, np.arange(ends[-1]))


def owners(lengths: np.ndarray) -> Rows:
    """Its transpose, bytes x tokens."""
    return Rows(np.arange(lengths.sum() + 1), np.repeat(np.arange(len(lengths)), lengths))


def members(group: np.ndarray, groups: int) -> Rows:
    """Groups x tokens, for tokens in order of their groups."""
    return Rows(np.searchsorted(group, np.arange(groups + 1)), np.arange(len(group)))


def row_sizes(left: Rows, right: Rows) -> np.ndarray:
    """The symbolic phase: products that each row of the result sums up."""
    sums = np.concatenate([[0], np.cumsum(np.diff(right.indptr)[left.indices])])
    return sums[left.indptr[1:]] - sums[left.indptr[:-1]]


def product(left: Rows, right: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and value of each entry of left x right, some rows at a time: the rows of `right` that a row of `left` names are added up."""
    sizes = np.cumsum(row_sizes(left, right))
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + WINDOW, "right")))
        named = left.indices[left.indptr[lo] : left.indptr[hi]]
        row = np.repeat(np.arange(lo, hi), np.diff(left.indptr[lo : hi + 1]))
        width = right.indptr[named + 1] - right.indptr[named]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        column = right.indices[np.arange(total) + np.repeat(right.indptr[named] - ends + width, width)]
        row = np.repeat(row, width)
        if total and not ((np.diff(row) > 0) | (np.diff(column) >= 0)).all():
            order = np.lexsort((column, row))
            row, column = row[order], column[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(column) != 0)])) if total else np.empty(0, np.int64)
        yield row[new], column[new], np.diff(np.append(new, total))
        lo = hi


def overlaps(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A's token, B's token and the bytes they share, for tokens of these lengths over the same bytes."""
    return product(spans(a), owners(b))


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of A and of B, and the number of groups."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    end_a, end_b = np.zeros(a.sum() + 1, bool), np.zeros(b.sum() + 1, bool)
    end_a[ends_a], end_b[ends_b] = True, True
    last_a, last_b = end_b[ends_a], end_a[ends_b]
    group = lambda last: np.cumsum(last) - last
    return group(last_a), group(last_b), int(last_a.sum())


def shared(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A's token and B's token, for all that are in one group."""
    of_a, of_b, n = groups_of(a, b)
    return product(Rows(np.arange(len(of_a) + 1), of_a), members(of_b, n))


def written_groups(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids by groups as bytes, `a1,a2|b1;`, and where each token's begin (and the end). In group g A's tokens stand before B's."""
    in_a, in_b = members(of_a, n).indptr, members(of_b, n).indptr
    at_a, at_b = np.arange(len(a)) + in_b[of_a], np.arange(len(b)) + in_a[of_b + 1]
    ids, ends = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    ends[at_a[in_a[1:] - 1]], ends[at_b[in_b[1:] - 1]] = ord("|"), ord(";")
    digits, width = decimals(int(ids.max(initial=0)).bit_length())
    width, table = width[ids], digits[ids]
    table[np.arange(len(ids)), width] = ends
    return table[np.arange(table.shape[1]) <= width[:, None]], np.concatenate([[0], np.cumsum(width + 1)])


@lru_cache(4)
def decimals(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of all numbers of so many bits, a column more than the longest has, and how many there are."""
    every = [str(i).encode() for i in range(1 << bits)]
    wide = len(every[-1]) + 1
    return np.frombuffer(b"".join(x.ljust(wide) for x in every), np.uint8).reshape(-1, wide), np.array([len(x) for x in every])


class Pair:
    """A byte-level BPE file (A) and a piece model with byte fallback (B), which begins a text with a space."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        own = json.loads(self.a.to_str())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.code = "H" if max(self.a.get_vocab_size(), len(pieces)) <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        named = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printable)}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(named[c] for c in token) if all(c in named for c in token) else token.encode()
        as_byte = [_BYTE.fullmatch(p) for p in pieces]
        self.b_bytes = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for p, m in zip(pieces, as_byte, strict=True)]
        self.lengths = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        pre = own["pre_tokenizer"] or {}
        # A's pieces begin anew at a space or line end between other characters, and at a mark after a letter; B joins nothing before a
        # space, nothing with a line end, and no letter with one of these marks
        marks = "".join(c for c in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(c)}", p) for p in pieces))
        self.cuts = re.compile(rf"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)|(?<=[{LETTERS}])(?=[{re.escape(marks)}])")
        self.names = {b: c for c, b in named.items()}
        self.by_pieces = (
            own["normalizer"] is None and own["model"]["type"] == "BPE" and not own["model"]["dropout"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self.b.encode("a  b ", out_type=str) == ["▁a", "▁", "▁b", "▁"]
            and self.b.encode("\n", out_type=str) == ["▁", "<0x0A>"]
        )
        self.new: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def cut(self, text: str) -> list[str]:
        """A space and the text, in pieces; with other rules than those above, in one."""
        return [] if not text else self.cuts.split(" " + text) if self.by_pieces else [" " + text]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of each text by A and by B; none if it is empty or one of them does not give it back."""
        cuts = [self.cut(t) for t in texts]
        every = set().union(*cuts)
        for piece in every.difference(self.new).intersection(self.old):
            self.new[piece] = self.old[piece]
        missing = [*every.difference(self.new)]
        for lo in range(0, len(missing), 4096):
            self._encode(missing[lo : lo + 4096])
        found = [[*map(self.new.__getitem__, c)] for c in cuts]
        found = [[] if None in pieces else pieces for pieces in found]
        for piece in missing:
            if len(piece) > CACHE_CHARS:
                del self.new[piece]
        if len(self.new) > CACHE_PIECES:
            self.old, self.new = self.new, {}
        return [b"".join([a for a, _ in pieces]) for pieces in found], [b"".join([b for _, b in pieces]) for pieces in found]

    def _encode(self, pieces: list[str]) -> None:
        words = [p for p in pieces if self.by_pieces and _WORD.fullmatch(p)]  # A's rules leave them whole
        of_a = dict(zip(words, ([t.id for t in self.a.model.tokenize(w.encode().decode("latin-1").translate(self.names))] for w in words), strict=True))
        others = [p for p in pieces if p not in of_a]
        of_a.update(zip(others, (e.ids for e in self.a.encode_batch_fast(others, add_special_tokens=False)), strict=True))
        # B puts a space before a text: before a piece that has none stands a line end, and both are left out again
        of_b = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        for piece, b in zip(pieces, of_b, strict=True):
            a, b = of_a[piece], b if piece[0] == " " else b[2:]
            raw = piece.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            self.new[piece] = (array(self.code, a).tobytes(), array(self.code, b).tobytes()) if same else None

    def ids(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        return np.frombuffer(b"".join(packed), self.kind).astype(np.int64), np.array([len(x) // self.kind.itemsize for x in packed], np.int64)

    def groups(self, a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of each text by its packed ids: its groups, the pairs of tokens in one group, and the SHA-256 of its groups (empty without tokens)."""
        (of_a, n_a), (of_b, n_b) = self.ids(a), self.ids(b)
        in_a, in_b, n = groups_of(self.lengths[0][of_a], self.lengths[1][of_b])
        out, begins = written_groups(of_a, of_b, in_a, in_b, n)
        upto, raw = np.cumsum(n_a + n_b), out.tobytes()
        digests = [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(begins[upto - n_a - n_b].tolist(), begins[upto].tolist(), strict=True)]
        sizes = row_sizes(Rows(np.arange(len(in_a) + 1), in_a), members(in_b, n))
        text = np.repeat(np.arange(len(a)), n_a)
        last = np.diff(in_a, append=n) > 0
        return np.bincount(text[last], minlength=len(a)), np.bincount(text, sizes, len(a)).astype(np.int64), digests

    def links(self, a: list[bytes], b: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of texts by their packed ids: the text of each link and its pair of ids, A's above 32 bits."""
        (of_a, n_a), (of_b, _) = self.ids(a), self.ids(b)
        ends = np.cumsum(n_a)
        for row, column, _ in overlaps(self.lengths[0][of_a], self.lengths[1][of_b]):
            yield np.searchsorted(ends, row, "right"), (of_a[row] << 32) | of_b[column]


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One in each Python worker."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, a_ids, b_ids, links (a, b: places in the ids; bytes: how many they share), groups (a_end, b_end: places after the last ids of a group).

    A null or empty text, and one that a tokenizer does not give back byte by byte after a space, has empty lists.
    """

    def work(texts: list[str]) -> list:
        own, rows = pair(a_path, b_path), []
        for a, b in zip(*own.encode(texts), strict=True):
            (a, _), (b, _) = own.ids([a]), own.ids([b])
            lengths = own.lengths[0][a], own.lengths[1][b]
            found = [np.stack(x, 1) for x in overlaps(*lengths)]
            of_a, of_b, n = groups_of(*lengths)
            ends = np.stack([members(of_a, n).indptr[1:], members(of_b, n).indptr[1:]], 1)
            links = [dict(zip(("a", "b", "bytes"), x, strict=True)) for x in np.concatenate(found).tolist()] if found else []
            rows.append((a.tolist(), b.tolist(), links, [{"a_end": x, "b_end": y} for x, y in ends.tolist()]))
        return list(zip(*rows, strict=True))

    longs = lambda *names: pa.list_(pa.struct([(x, pa.int64()) for x in names]))
    made = pa.schema([("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64())), ("links", longs("a", "b", "bytes")), ("groups", longs("a_end", "b_end"))])
    return per_text(docs, id_col, text_col, made, work)


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A table with a row for each document (`row`: a number of its own; packed ids, counts and the digest of the groups) and, with no `row`, rows of pairs and how often a task had them."""
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    made = pa.schema([("row", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("a_ids", pa.binary()), ("b_ids", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def counts(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, n = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        return every[new], np.add.reduceat(n, new)

    def of_pairs(keys: list[np.ndarray], times: list[np.ndarray], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        every, n = counts(keys, times)
        for lo in range(0, len(every), PAIRS_A_ROW):
            lists = [pa.array([x[lo : lo + PAIRS_A_ROW]], pa.list_(pa.int64())) for x in (every, n)]
            empty = [pa.nulls(1, kind), *(pa.nulls(1, f.type) for f in list(made)[:-2])]
            yield pa.RecordBatch.from_arrays([*empty, *lists], ["id", *made.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, row = pair(a_path, b_path), TaskContext.get().partitionId() << 36
        keys, times, size, kind = [], [], 0, pa.null()
        for part in slices(batches):
            kind = part.column(1).type
            a, b = own.encode([t or "" for t in part.column(0).to_pylist()])
            n_groups, n_shared, digests = own.groups(a, b)
            n_links = np.zeros(len(a), np.int64)
            for text, link in own.links(a, b):
                n_links += np.bincount(text, minlength=len(a))
                once, n = np.unique(link, return_counts=True)
                keys.append(once)
                times.append(n)
                size += len(once)
            columns = [np.arange(row, row + len(a)), own.ids(a)[1], own.ids(b)[1], n_groups, n_links, n_shared, digests, a, b, [None] * len(a), [None] * len(a)]
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(c, f.type) for c, f in zip(columns, made, strict=True))], ["id", *made.names])
            row += len(a)
            if size > COUNTED:
                keys, times = ([x] for x in counts(keys, times))
                size = len(keys[0])
                if size > COUNTED // 2:
                    yield from of_pairs(keys, times, kind)
                    keys, times, size = [], [], 0
        if size:
            yield from of_pairs(keys, times, kind)

    own_id = StructField("id", kept.schema["id"].dataType)
    return written(kept.mapInArrow(run, StructType([own_id, *from_arrow_schema(made).fields])), "encoded")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it), best (whether no other pair of its B id has more): a table. Of B ids there are as many as its vocabulary has."""
    sums = table.filter("row IS NULL").select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    sums = written(sums, "pairs")
    of_b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = sums.groupBy(of_b.alias("of")).agg(F.max("n").alias("most"))
    return written(sums.join(F.broadcast(most), of_b == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def least_frequent(counts: DataFrame) -> int:
    """A power of two; at most BROADCAST_PAIRS pairs have as many links. From a histogram of at most 64 rows."""
    total, bits = 0, 64
    for r in sorted(counts.groupBy(F.length(F.bin("n")).alias("bits")).count().collect(), reverse=True):
        total += r["count"]
        if total > BROADCAST_PAIRS:
            break
        bits = r.bits
    return 1 << min(bits - 1, 62)


def score_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_a, n_b, n_groups, n_links, n_shared (pairs of tokens in one group), n_best (links whose pair of ids is the most frequent of its B id, ties included), count_sum (frequencies of the links' pairs, summed), groups_sha256.

    A null or empty text, and one that a tokenizer does not give back after a space, has zeros and an empty digest. Ids may be null
    or repeated; other columns do not matter; an empty table gives an empty one. Frequencies of the most frequent pairs go to all
    tasks, and those of the others are joined by pair.
    """
    table = encoded(docs, a_path, b_path, id_col, text_col)
    counts = pair_counts(table)
    least = least_frequent(counts)
    most = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(most["pair"].to_numpy())
    frequent = docs.sparkSession.sparkContext.broadcast(tuple(most[c].to_numpy()[order] for c in ("pair", "n", "best")))
    made = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("rest", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
    own = ["id", *COUNTS, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, (known, n, best) = pair(a_path, b_path), frequent.value
        for part in slices(batches):
            size = part.num_rows
            sums, bests, rest = np.zeros(size, np.int64), np.zeros(size, np.int64), []
            for text, link in both.links(part.column(1).to_pylist(), part.column(2).to_pylist()):
                at = np.minimum(np.searchsorted(known, link), max(0, len(known) - 1))
                found = known[at] == link if len(known) else np.zeros(len(link), bool)
                np.add.at(sums, text[found], n[at[found]])
                np.add.at(bests, text[found], best[at[found]])
                rest.append(np.stack([text[~found], link[~found]]))
            left = np.concatenate(rest, 1) if rest else np.empty((2, 0), np.int64)
            once, times = np.unique(left, axis=1, return_counts=True) if left.size else (left, np.empty(0, np.int64))
            cuts = np.searchsorted(once[0], np.arange(size + 1))
            lists = [[x[i:j].tolist() for i, j in zip(cuts, cuts[1:], strict=False)] for x in (once[1], times)]
            columns = [pa.array(bests), pa.array(sums), *(pa.array(x, pa.list_(pa.int64())) for x in lists)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, *part.columns[3:]], [*made.names, *(f"own{i}" for i in range(len(own)))])

    rows = table.filter("row IS NOT NULL").select("row", "a_ids", "b_ids", *own)
    passed = [StructField(f"own{i}", rows.schema[c].dataType) for i, c in enumerate(own)]
    scored = written(rows.mapInArrow(run, StructType([*from_arrow_schema(made).fields, *passed])), "scored")
    others = scored.select("row", F.inline(F.arrays_zip("rest", "times"))).withColumnRenamed("rest", "pair").join(counts.filter(F.col("n") < least), "pair")
    more = others.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    out = scored.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    names = [F.col(f"own{i}").alias(id_col if c == "id" else c) for i, c in enumerate(own)]
    return out.select(*names, "n_best", "count_sum")
