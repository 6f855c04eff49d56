"""Mixing and the quality classifier against slow versions of them, value by value."""

import hashlib
import math
import random
import re
from itertools import pairwise

import numpy as np
import pytest

from evspark.llm import mixing, quality_qda

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, s int, part int, start long, block long, among long, size int, label int, x double, held_out int, score int"
EVERY = 1 << 64


def spread(x):
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 % EVERY
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % EVERY
    return x ^ x >> 31


def placed(i, n, key):
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    while True:
        left, right = i >> half, i & low
        for r in range(4):
            left, right = right, left ^ spread((right + (key * 4 + r + 1) * 0x9E3779B97F4A7C15) % EVERY) & low
        i = left << half | right
        if i < n:
            return i


def slow_mix(rows, weights=(5, 2, 1), block=64, shard=4096, most=3, seed=20240607):
    """Words taken of each row: all blocks, all shards, slot by slot. Rows: id, text, source."""
    sources = {}
    for k, (i, text, source) in enumerate(rows):
        n = len(WORD.findall(text or ""))
        digest = hashlib.md5(text.encode()).digest() if text is not None else None
        sources.setdefault(source, []).append(((i is not None, i or 0), n, (digest is not None, digest or b""), k))
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r[1] for r in sources[s]) for s in names]
    weight = [weights[k % len(weights)] for k in range(len(names))]
    target, capped = [0.0] * len(names), set()
    while True:
        left = max(0.0, sum(sizes) - sum(most * sizes[k] for k in capped))
        free = [k for k in range(len(names)) if k not in capped]
        for k in free:
            target[k] = left * weight[k] / sum(weight[f] for f in free)
        above = [k for k in free if target[k] > most * sizes[k]]
        if not above:
            break
        capped |= set(above)
    target = [most * sizes[k] if k in capped else target[k] for k in range(len(names))]
    blocks = [-(-n // block) for n in sizes]
    wanted = [t / max(n, 1) * b if n else 0.0 for t, n, b in zip(target, sizes, blocks, strict=True)]
    total, given = round(sum(wanted)), [0] * len(names)
    times = [[0] * b for b in blocks]
    for number in range(-(-total // shard)):
        slots = min(shard, total - number * shard)
        expected = [slots * w / sum(wanted) for w in wanted]
        counts = [math.floor(e + 1e-9) for e in expected]
        if rest := slots - sum(counts):
            fraction = np.array([max(0.0, e - c) for e, c in zip(expected, counts, strict=True)])
            counts = [c + int(x) for c, x in zip(counts, np.random.default_rng((seed, number)).multinomial(rest, fraction / fraction.sum()), strict=True)]
        for s, c in enumerate(counts):
            for j in range(given[s], given[s] + c):
                turn = j // blocks[s]
                if turn < most:
                    times[s][placed(j % blocks[s], blocks[s], (seed + s) * 31 + turn)] += 1
            given[s] += c
    out = {}
    for s, name in enumerate(names):
        at = 0
        for _, n, _, k in sorted(sources[name]):
            out[k] = sum(times[s][w // block] for w in range(at, at + n))
            at += n
    return [(r[0], len(WORD.findall(r[1] or "")), sizes[names.index(r[2])], target[names.index(r[2])], out[k]) for k, r in enumerate(rows)]


@pytest.mark.parametrize("sources", [3, 40])
def test_mixing_slot_by_slot(spark, sources):
    pick = random.Random(sources)
    rows = [(i if i % 17 else None, None if i % 23 == 0 else "" if i % 29 == 0 else " ".join(f"w{i}x{k}" for k in range(pick.choice([1, 3, 40, 64, 200, 900]))), f"s{min(pick.randrange(sources), pick.randrange(sources))}" if i % 11 else None) for i in range(300)]
    rows += [(900, "all the words of a small source", "alone"), (901, "again", "again"), (901, "again", "again")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 0.5, 1, 2) for r in rows], SCHEMA).repartition(5)
    order = lambda x: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x), key=str)
    assert order(map(tuple, mixing.mix_report(docs).collect())) == order(slow_mix(rows))


def slow_statistics(text):
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})
    chars, words, n = max(1, sum(map(len, w))), max(1, len(w)), max(1, len(lines))
    share = lambda x, of: math.log((x + 0.5) / (of + 1.0))
    count = lambda cs: sum(text.count(c) for c in cs)
    foreign = len([b for b in text.encode() if b >= 128])
    return [
        math.log1p(len(w)), math.log(chars / words), share(count("#*$%&|<>"), chars), share(len(lines) - len(set(lines)), n), share(repeated, words), share(foreign, chars),
        share(count("0123456789"), chars), share(count(".!?"), words), share(count(",;:"), words), share(sum("A" <= c <= "Z" for c in text), chars), share(len(set(w)), words),
        math.log(words / n), share(text.count("|"), words), math.log1p(n),
    ]


def test_discriminant_by_the_book(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(150).collect()
    odd = [(10_001, None), (10_002, ""), (10_003, "É|| 5\n\n5, 5. Aa"), (None, "no id")]
    rows = [(r.doc_id, r.text) for r in docs] + odd
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    table = spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, 5, 6, 7, 0.5, 1, 2) for i, t in rows], SCHEMA)
    known = spark.createDataFrame([*labels.items(), (10_001, None), (10_002, 7)], "doc_id long, quality long")
    got = {r.doc_id: r for r in quality_qda.score_quality(table, known, "doc_id % 4 = 1").collect()}

    x = {i: slow_statistics(t or "") for i, t in rows}
    taught = {i: labels[i] for i, _ in rows if i in labels and i % 4 != 1}
    assert min(list(taught.values()).count(k) for k in (0, 1)) > 3
    every = np.array([x[i] for i in taught])
    centre, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    of = {k: np.array([(x[i] - centre) / scale for i in taught if taught[i] == k]) for k in (0, 1)}
    own = {k: np.cov(z, rowvar=False, bias=True) for k, z in of.items()}
    pooled = sum(own[k] * len(of[k]) for k in of) / len(taught)
    density = {}
    for k, z in of.items():
        c = 0.8 * own[k] + 0.2 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.02 * np.eye(len(c))
        density[k] = lambda v, c=c, m=z.mean(axis=0), n=len(z): math.log(n + 0.5) - (np.linalg.slogdet(c)[1] + (v - m) @ np.linalg.solve(c, v - m)) / 2
    for i, _ in rows:
        v = (np.array(x[i]) - centre) / scale
        want = 1 / (1 + math.exp(-max(-35.0, min(35.0, density[1](v) - density[0](v)))))
        assert got[i].score == pytest.approx(want, abs=1e-8) and got[i].predicted == int(want >= 0.3) and got[i].held_out == (i is None or i % 4 == 1)


def test_permutation_number_by_number():
    assert [placed(i, 100, 7) for i in range(100)] == mixing.permuted(np.arange(100), 100, 7).tolist() and any(b - a != 1 for a, b in pairwise(placed(i, 100, 7) for i in range(100)))
