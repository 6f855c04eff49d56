"""Byte-level BPE by ranks: encoding and decoding.

Texts are cut without a regular expression. Each code point has a class; each class is a transition function on a few states, and
as composition of functions is associative, the state before every code point comes from a scan over blocks of the code points.
State and class say where a piece begins. The merges of a piece are made once and kept in a bounded cache. Where each piece begins in
the text and in the ids is kept, so that decoding goes by runs of pieces and holds each run against its place in the text.
"""

from __future__ import annotations

import hashlib
import heapq
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from sys import maxunicode
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evspark.llm.common import per_text, slices, small_batches

# Classes of code points; APO2 and APO3 are apostrophes that can begin a contraction of two or three characters.
LETTER, NUMBER, SPACE, BLANK, OTHER, APO2, APO3, BREAK = range(8)
# States: what the last code point belongs to. DUE1, DUE2: in a contraction, with one or two letters to come; DONE: it has ended.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, DUE1, DUE2, DONE, BEGIN = range(9)
#: Code points with the property White_Space, without the space itself.
BLANKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16, which Python's tables may not have yet.
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Code points that are scanned at a time.
WINDOW = 1 << 20
#: Pieces that are decoded at a time.
RUN = 1 << 16
#: Pieces that the cache holds before it begins anew, and the bytes of the longest.
CACHE_PIECES, CACHE_BYTES = 600_000, 64
#: Up to so many bytes, all pairs are looked up again after each merge; beyond, a heap holds them. NEVER: above every rank.
SHORT, NEVER = 24, 1 << 40


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    of = np.full(maxunicode + 1, OTHER, np.uint8)
    kinds = np.array([category(chr(c))[0] for c in range(maxunicode + 1)])
    of[kinds == "L"], of[kinds == "N"] = LETTER, NUMBER
    for ranges, kind in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER)):
        for lo, hi in ranges:
            of[lo : hi + 1] = kind
    of[BLANKS], of[0x20] = BLANK, SPACE
    return of


def _step(state: int, kind: int) -> int:
    if kind == LETTER:
        return {DUE2: DUE1, DUE1: DONE}.get(state, IN_LETTERS)
    if kind in (APO2, APO3) and state not in (IN_OTHERS, AFTER_SPACE):
        return DUE1 if kind == APO2 else DUE2
    return {NUMBER: IN_NUMBERS, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, BREAK: BEGIN}.get(kind, IN_OTHERS)


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """All functions that sequences of classes amount to: what each makes of a state, and how two compose (the first, then the second). Class k is function k; the last is the identity."""
    found = [tuple(_step(s, k) for s in range(9)) for k in range(8)]
    at = {f: i for i, f in enumerate(found)}
    assert len(at) == 8
    for f in found:  # grows meanwhile
        for g in found[:8]:
            if (h := tuple(g[s] for s in f)) not in at:
                at[h] = len(found)
                found.append(h)
    if (same := tuple(range(9))) not in at:
        at[same] = len(found)
        found.append(same)
    after = np.array([[at[tuple(g[s] for s in f)] for g in found] for f in found], np.uint8)
    return np.array(found, np.uint8), after


def states_before(kinds: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """The state before each code point, and the one after the last."""
    maps, after = _functions()
    same, n = len(maps) - 1, len(kinds)
    if same > 255:
        raise AssertionError("more functions than a byte can name")
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    if rows < 2 or width < 2:
        out, state = np.empty(n, np.uint8), start
        for i, k in enumerate(kinds.tolist()):
            out[i], state = state, int(maps[k, state])
        return out, state
    block = np.full(rows * width, same, np.uint8)
    block[:n] = kinds
    block = np.ascontiguousarray(block.reshape(rows, width).T)  # a column of the text's blocks at a time
    flat, count = after.ravel(), len(maps)
    whole = block[0].copy()
    for line in block[1:]:
        whole = flat[whole.astype(np.int32) * count + line]
    step = 1
    while step < rows:  # prefixes of the blocks' functions, twice as long each time
        longer = whole.copy()
        longer[step:] = flat[whole[:-step].astype(np.int32) * count + whole[step:]]
        whole, step = longer, step * 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = start, maps[whole[:-1], start]
    out, table = np.empty_like(block), maps.ravel()
    for i, line in enumerate(block):
        out[i] = state
        state = table[line.astype(np.int32) * 9 + state]
    return np.ascontiguousarray(out.T).ravel()[:n], int(maps[whole[-1], start])


def starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pieces begin in `points`; `breaks` are the places of separators between texts, which are pieces of their own."""
    n, of, found, state = len(points), classes(), [], BEGIN
    for lo in range(0, n, WINDOW):
        hi, top = min(n, lo + WINDOW), min(n, lo + WINDOW + 3)
        part = points[lo:top]
        kinds = of[part]
        b = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, top)] - lo
        kinds[b] = BREAK
        apo = np.flatnonzero(part[: hi - lo] == 0x27)
        apo = apo[kinds[apo] != BREAK]
        ahead = lambda k: np.where(apo + k < len(part), np.where(kinds[np.minimum(apo + k, len(part) - 1)] == BREAK, 0, part[np.minimum(apo + k, len(part) - 1)]), 0)
        one, two = ahead(1), ahead(2)
        kinds[apo[np.isin(one, [ord(c) for c in "stmd"])]] = APO2
        kinds[apo[((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = APO3
        before, state = states_before(kinds[: hi - lo], state)
        here = kinds[: hi - lo]
        after = np.full(hi - lo, BREAK, np.uint8)
        after[: len(kinds) - 1] = kinds[1 : hi - lo + 1]
        white = lambda k: (k == SPACE) | (k == BLANK)
        in_white = (before == AFTER_SPACE) | (before == AFTER_BLANK)
        goes_on = (
            ((here == LETTER) & ((before == IN_LETTERS) | (before == DUE1) | (before == DUE2) | (before == AFTER_SPACE)))
            | ((here == NUMBER) & ((before == IN_NUMBERS) | (before == AFTER_SPACE)))
            | (((here == OTHER) | (here == APO2) | (here == APO3)) & ((before == IN_OTHERS) | (before == AFTER_SPACE)))
            | (white(here) & in_white & (white(after) | (after == BREAK)))
        )
        found.append(np.flatnonzero(~goes_on) + lo)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: neighbours of the least rank are joined, the first such pair first, until none can be."""
    if piece in ranks:
        return [ranks[piece]]
    size = len(piece)
    if size <= SHORT:
        parts = [piece[i : i + 1] for i in range(size)]
        while len(parts) > 1:
            found = [ranks.get(a + b, NEVER) for a, b in pairwise(parts)]
            if (least := min(found)) == NEVER:
                break
            at = found.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]
    ends, left = [*range(1, size + 1)], [*range(-1, size)]  # of the part that begins at i; where the part before it begins
    rank = lambda i: ranks.get(piece[i : ends[ends[i]]]) if ends[i] < size else None
    now = [rank(i) for i in range(size)]
    heap = [(r, i) for i, r in enumerate(now) if r is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if now[i] != r:
            continue
        gone = ends[i]
        ends[i], now[gone] = ends[gone], -1
        if ends[i] < size:
            left[ends[i]] = i
        for k in (i, left[i]):
            if k >= 0:
                now[k] = rank(k)
                if now[k] is not None:
                    heapq.heappush(heap, (now[k], k))
    out, i = [], 0
    while i < size:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class _Pieces(dict):
    """The packed ids of each piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(_merged(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int]):
        self.pieces, self.bytes = _Pieces(ranks), {i: b for b, i in ranks.items()}

    @classmethod
    def read(cls, path: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Of each text, its ids as little-endian unsigned 32-bit integers, and where its pieces begin in its UTF-8 bytes and in its ids."""
        group: list[str] = []
        size = 0
        for text in texts:
            if group and size + len(text) > WINDOW:
                yield from self._encode(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])  # one after the separator that follows
        begins = starts(points, ends[:-1] - 1)
        raw, lengths = joined.encode(), 1 + (points >= 0x80).astype(np.int64)
        lengths += points >= 0x800
        lengths += points >= 0x10000
        place = np.concatenate([[0], np.cumsum(lengths)])
        cuts = np.append(place[begins], len(raw)).tolist()
        packed = list(map(self.pieces.__getitem__, map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:]))))
        ids_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) >> 2)])
        firsts = np.searchsorted(begins, np.concatenate([[0], ends[:-1]])).tolist()
        lasts = np.append(np.searchsorted(begins, ends[:-1] - 1), len(packed)).tolist()
        for k, (i, j) in enumerate(zip(firsts, lasts, strict=True)):
            text_at = int(place[ends[k] - 1 - len(texts[k])])
            yield b"".join(packed[i:j]), np.asarray(cuts[i:j], np.int64) - text_at, ids_at[i:j] - ids_at[i]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decoded_runs(self, ids: bytes, piece_at: np.ndarray, ids_at: np.ndarray) -> Iterator[bytes]:
        """The bytes of runs of RUN pieces, one after the other. Each but the last has to reach from its first piece's place in the text to that of the next run's."""
        for lo in range(0, len(piece_at), RUN):
            hi, last = lo + RUN, lo + RUN >= len(piece_at)
            run = self.decode(ids[4 * int(ids_at[lo]) : len(ids) if last else 4 * int(ids_at[hi])])
            if not last and len(run) != piece_at[hi] - piece_at[lo]:
                raise ValueError("the ids do not fit the offsets of their pieces")
            yield run


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec.read(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, ids (packed little-endian unsigned 32-bit), n_tokens, piece_at and ids_at (where pieces begin in the text's bytes and in the ids).

    A null or empty text has no ids. Rows keep their partition: nothing is shuffled. The rank file must be readable on executors.
    """

    def work(texts: list[str]) -> list:
        out = list(codec(path).encode(texts))
        return [[a for a, _, _ in out], [len(a) // 4 for a, _, _ in out], [b for _, b, _ in out], [c for _, _, c in out]]

    made = pa.schema([("ids", pa.binary()), ("n_tokens", pa.int64()), ("piece_at", pa.list_(pa.int64())), ("ids_at", pa.list_(pa.int64()))])
    return per_text(docs, id_col, text_col, made, work)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of `rows` (id, ids, piece_at, ids_at): id, decoded (bytes). Null ids give no bytes."""
    columns = [id_col, "ids", "piece_at", "ids_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in slices(batches):
            of = lambda i, k, part=part: np.array(part.column(k)[i].as_py() or [], np.int64)
            found = [b"".join(own.decoded_runs(x or b"", of(i, 2), of(i, 3))) for i, x in enumerate(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["id", "decoded"])

    small_batches(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(*columns).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids. A null text counts as empty. Else ids are hashed where they are made and not sent on."""

    def work(texts: list[str]) -> list:
        own, rows = codec(path), []
        for ids, piece_at, ids_at in own.encode(texts):
            decoded = hashlib.sha256()
            for run in own.decoded_runs(ids, piece_at, ids_at):
                decoded.update(run)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest(), ids if keep_ids else None))
        columns = list(zip(*rows, strict=True))
        return columns if keep_ids else columns[:3]

    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())]
    return per_text(docs, id_col, text_col, pa.schema(kinds if keep_ids else kinds[:3]), work)
