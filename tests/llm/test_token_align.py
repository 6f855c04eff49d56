"""Alignment of two tokenizers against brute force over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evspark.llm import queries, token_align
from evspark.llm.common import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
PARTS = ["'", "s", "re", " ", "  ", "\n", "a", "B", "é", "漢", "\t", "\r", "x\n", "▁", "<s>", "<|endoftext|>", "\x1c", "\x85", "1", "!!", "　", "😀", "word ", "the", ".", ",", "²", "ǆ", "́"]
SCHEMA = "doc_id long, text string, lang string, row long, id string, pair long, n int, best boolean, a_ids string, times int"


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = token_align.pair(A, B)

    def of(text):
        """Ids of A and of B with their ends in bytes; nothing if they do not give the text back."""
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [[t[i] for i in x] for t, x in zip((own.a_bytes, own.b_bytes), ids, strict=True)]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return [], []
        return [list(zip(x, np.cumsum([len(y) for y in p]).tolist(), strict=True)) for x, p in zip(ids, parts, strict=True)]

    return of


def brute(a, b):
    """Links and groups, byte by byte."""
    of = [[k for k, (lo, (_, hi)) in enumerate(zip([0, *(e for _, e in x)], x, strict=False)) for _ in range(hi - lo)] for x in (a, b)]
    links = Counter(zip(*of, strict=True))
    groups, i, k = [], 0, 0
    for end in sorted({e for _, e in a} & {e for _, e in b}):
        one, two = [], []
        while i < len(a) and a[i][1] <= end:
            one.append(a[i][0])
            i += 1
        while k < len(b) and b[k][1] <= end:
            two.append(b[k][0])
            k += 1
        groups.append((one, two))
    return links, groups


def texts():
    pick = random.Random(11)
    return [None, "", " ", "\n", "▁", "plain words, and more.", "plain words, and more.", "x" * 3000, "漢字" * 800, " ".join(["antidisestablishment"] * 4000), *("".join(pick.choice(PARTS) for _ in range(pick.randint(1, 40))) for _ in range(600))]


def test_products_are_those_of_matrices(monkeypatch):
    rng = np.random.default_rng(5)
    for window in (3, 1 << 22):
        monkeypatch.setattr(token_align, "WINDOW", window)
        for _ in range(30):
            left, right = (rng.random(s) < 0.3 for s in ((7, 5), (5, 9)))
            rows = lambda m: token_align.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
            got = np.zeros((7, 9), int)
            for r, c, v in token_align.product(rows(left), rows(right)):
                assert (got[r, c] == 0).all()
                got[r, c] = v
            assert (got == left.astype(int) @ right.astype(int)).all()


def test_pairs_of_a_group():
    a, b = np.array([2, 3, 1, 4]), np.array([1, 4, 1, 2, 2])
    found = [(int(x), int(y)) for r, c, _ in token_align.shared(a, b) for x, y in zip(r, c, strict=True)]
    assert found == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3), (3, 4)]
    assert token_align.written_groups(np.arange(4), np.arange(10, 15), *token_align.groups_of(a, b))[0].tobytes() == b"0,1|10,11;2|12;3|13,14;"


def test_alignment_of_whole_texts(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    for r in token_align.align(docs, A, B).collect():
        a, b = library(texts()[r.doc_id])
        links, groups = brute(a, b)
        assert (r.a_ids, r.b_ids) == ([i for i, _ in a], [i for i, _ in b])
        assert [((x["a"], x["b"]), x["bytes"]) for x in r.links] == sorted(links.items())
        ends = [(0, 0), *((x["a_end"], x["b_end"]) for x in r.groups)]
        assert [(r.a_ids[i:j], r.b_ids[k:m]) for (i, k), (j, m) in zip(ends, ends[1:], strict=False)] == groups


def expected(rows, library):
    found = [(i, *brute(a, b), a, b) for i, t in rows for a, b in [library(t)]]
    count = Counter((a[x][0], b[y][0]) for _, links, _, a, b in found for x, y in links)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for i, links, groups, a, b in found:
        pairs = [(a[x][0], b[y][0]) for x, y in links]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), digest, sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("pairs", "counted"), [(1 << 20, 1 << 21), (40, 1000), (0, 100)])
def test_scores(spark, library, monkeypatch, pairs, counted):
    monkeypatch.setattr(token_align, "BROADCAST_PAIRS", pairs)
    monkeypatch.setattr(token_align, "COUNTED", counted)
    monkeypatch.setattr(token_align, "PAIRS_A_ROW", 64)
    rows = [*enumerate(texts()), (None, "plain words"), (None, None), (5, "plain"), (2**53 + 1, "words")]
    docs = spark.createDataFrame([(i, t, "en", 1, "x", 2, 3, True, "a", 4) for i, t in rows], SCHEMA).repartition(5)
    got = token_align.score_alignment(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, library)
    assert token_align.score_alignment(docs.limit(0), A, B).count() == 0


def test_query(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_token_align(spark, sf).collect()), key=str) == expected(rows, library)
