"""The pipeline's stages, each against what its operator or brute force gives on the stage's own input."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from evspark.llm import bpe
from evspark.llm.common import table, tokenizer, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, sf), f"test-{name}")
        assert after.schema.simpleString() == docs.schema.simpleString()
        old = {r.doc_id: r.text for r in before.collect()}
        new = {r.doc_id: r.text for r in after.collect()}
        assert set(new) <= set(old)
        if name == "language_id":
            assert set(old) - set(new) == {i for i, t in old.items() if not re.search(r"[^\W\d_]", t or "")}
        if name == "line_dedup":
            assert set(new) == set(old)
            for i, t in new.items():
                lines = iter((old[i] or "").split("\n"))
                assert t == "" or all(x in lines for x in t.split("\n"))
        if name == "ngram_join":
            assert all(new[i] == old[i] for i in new)
        if name == "mixing":
            words = {i: (t or "").split() for i, t in old.items()}
            assert all(set(t.split()) <= set(words[i]) and 0 < len(t.split()) <= 3 * len(words[i]) for i, t in new.items())
        before = after
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0
    final = corpus_pipeline.STAGES[-1][1](spark, after, sf).collect()
    own = bpe.codec(tokenizer("byte_bpe_multi_50k.tiktoken"))
    assert {r.doc_id: own.decode(bytes(r.ids)).decode() for r in final} == new
    assert all(r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4")) for r in final)
