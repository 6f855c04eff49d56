"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from evspark.llm.common import LOWER, UPPER

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bytes that are scanned at a time; a longer word is scanned whole.
SCAN = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_MIXED_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_window(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    white = _IS_WHITE[b]
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.empty(0, np.uint64)
    inside = np.flatnonzero(~white)
    length = last - first
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(inside)) - np.repeat(starts, length)
    return mix(np.add.reduceat(_MIXED_BYTES[b[inside]] * _powers(int(length.max()))[place], starts) + length.astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word `[^\\x20\\x09-\\x0D]+` of a text in UTF-8, in order."""
    if len(raw) <= SCAN:
        return _hash_window(raw)
    out, lo = [], 0
    while lo < len(raw):
        hi = lo + SCAN
        while hi < len(raw) and raw[hi] not in WHITE:
            hi += 1
        out.append(_hash_window(raw[lo:hi]))
        lo = hi
    return np.concatenate(out)


def groups(texts: list[bytes], most: int = SCAN) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `most` bytes together; a longer text is alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of several texts, and for each text the number of its words."""
    counts = np.zeros(len(texts), np.int64)
    if len(texts) == 1:
        h = word_hashes(texts[0])
        counts[0] = len(h)
        return h, counts
    raw = b"\n".join(texts)
    h = word_hashes(raw)
    b = np.frombuffer(raw, np.uint8)
    white = _IS_WHITE[b]
    begins = ~white
    begins[1:] &= white[:-1]
    at = np.concatenate([[0], np.cumsum(begins)])
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    upto = at[ends]
    counts[:] = np.diff(np.concatenate([[0], upto]))
    return h, counts


def windows(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words within a text: hash, the window's first word, its text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(h) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(h) - width + 1
    ok = np.flatnonzero(owner[:n] == owner[width - 1 :])
    acc = np.full(len(ok), np.uint64(width), np.uint64)
    for k in range(width):
        acc = mix(acc * _ODD + h[ok + k])
    return acc, ok, owner[ok]
