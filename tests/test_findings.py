"""Cases that larger tables brought up."""

import hashlib
import math
import random
import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evspark import registry
from evspark.functions import text as fx
from evspark.operators import citations, evaluate, images, lexical, vectors
from evspark.sources.store import Change, Store
from evspark.suite.inputs import chunks


@pytest.mark.parametrize("query, table", [("x1_stream_question_stats", "conversations"), ("x2_stream_ingest", "documents")])
def test_a_stream_of_a_folder_of_files(spark, sf, tmp_path, query, table):
    (tmp_path / f"{table}.parquet").mkdir()
    shutil.copy(f"{sf}/{table}.parquet", tmp_path / f"{table}.parquet" / "part-0000.parquet")
    run = registry.queries()[query]
    rows = sorted(map(tuple, run(spark, str(tmp_path)).collect()))
    assert rows and rows == sorted(map(tuple, run(spark, sf).collect()))


def test_points_meet_the_sections_of_their_own_item(spark):
    golden = spark.createDataFrame([(1, "q", False, None, None, ["d#1"], ["blue valve"]), (1, "q", False, None, None, ["d#2"], ["red pump"]), (2, "q", False, None, None, ["d#1", "d#2"], ["red pump"])], "id int, question string, negative boolean, expect string, note string, must_cite array<string>, answer_points array<string>")
    sections = spark.createDataFrame([("d", "1", "the red pump runs"), ("d", "2", "the blue valve opens")], "doc string, section string, text string")
    assert sorted(map(tuple, evaluate.golden_check(golden, sections).collect())) == [(1, "id repeated"), (1, "point not in a cited section")]


def test_points_without_a_letter_and_documents_with_a_number_sign(spark, tmp_path):
    texts = {11: "!? late", 12: "...", 14: None, 16: "", 19: "the pump runs", 21: "the pump", 22: "a", 23: None, 24: "b", 10: "😀. the pump"}  # 10 cites 11, and 15 nothing
    rows = [(i, x, "en", {22: "a#b", 24: "#"}.get(i, "s")) for i, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, registry.queries()["e7_golden_check"](spark, str(tmp_path)).collect()))
    assert got == [(14, "point not in a cited section"), (23, "point not in a cited section")]  # of these two the cited text is null
    golden = spark.createDataFrame([(1, "q", False, None, None, ["d#1"], ["!"]), (2, "q", False, None, None, ["d#2"], ["oil"]), (3, "q", False, None, None, ["d"], ["oil"])], "id int, question string, negative boolean, expect string, note string, must_cite array<string>, answer_points array<string>")
    sections = spark.createDataFrame([("d", "1", "oil"), ("d", "d", "oil")], "doc string, section string, text string")
    missed, gone = "point not in a cited section", "cites what is not there"
    assert sorted(map(tuple, evaluate.golden_check(golden, sections).collect())) == [(1, missed), (2, gone), (2, missed), (3, gone), (3, missed)]


def test_tickets_keep_a_blank_symptom(spark, tmp_path):
    rows = [(1, "", "s"), (2, " \n", ""), (3, None, None), (-1, "late", "s"), (None, "late", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = {"ticket:T1": "Ticket: T1\nDevice: s\nSymptom: \nCause: c\nConclusion: done", "ticket:T2": "Ticket: T2\nDevice: \nSymptom:  \n\nConclusion: done", "ticket:T3": "Ticket: T3\nCause: c\nConclusion: done", "ticket:T-1": "Ticket: T-1\nDevice: s\nSymptom: late\nConclusion: done", None: "Device: s\nSymptom: late\nConclusion: done"}
    assert dict(map(tuple, registry.queries()["r20_format_tickets"](spark, str(tmp_path)).collect())) == {k: hashlib.md5(x.encode()).hexdigest() for k, x in want.items()}
    ticket = spark.createDataFrame([("T1", "m", "s", " ", "", "　")], "ticket_no string, device_model string, symptom string, root_cause string, action string, conclusion string")
    assert images.format_tickets(ticket).first().text == "Ticket: T1\nDevice: m\nSymptom: s"


def test_coverage_is_rounded_as_in_sql(spark):
    terms = [f"w{i:03d}x" for i in range(160)]
    questions, blocks = spark.createDataFrame([(1, " ".join(terms))], "query_id int, text string"), spark.createDataFrame([(1, 1, " ".join(terms[:77]))], "query_id int, n int, text string")
    assert [r.term_coverage for r in citations.anchor_check(questions, blocks).collect()] == [0.4813]  # 77 / 160 is 0.48125, but 1 - 83 / 160 is 0.48124999999999996


def test_anchors_of_a_null_question_and_numbers_left_aside(spark, tmp_path):
    texts = ["the pump, é 3.5 seal", "pump seal pump seal pump seal pump seal ", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("de"), "source": F.lit("s")}).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, "user", "pump seal")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.queries()["c8_anchor_check"](spark, str(tmp_path)).collect()
    # the SQL has no numbers with units (here `3.5 s`), and a text that is null has no verdict
    assert sorted(map(tuple, got)) == [(0, 1.0, 0, 0, True), (1, 0.0, 2, 0, False), (2, 1.0, 0, 0, None), (3, 1.0, 0, 0, True)]
    asked, blocks = spark.createDataFrame([(1, "pump 5 mm"), (2, None)], "query_id int, text string"), spark.createDataFrame([(1, 1, "the pump")], "query_id int, n int, text string")
    assert [(r.term_coverage, r.ok) for r in citations.anchor_check(asked, blocks).sort("query_id").collect()] == [(0.5, False), (1.0, None)]
    assert [(r.missing_numbers, r.ok) for r in citations.anchor_check(asked, blocks, by_numbers=False).sort("query_id").collect()] == [(["5 mm"], True), (None, None)]


def test_components_keep_the_sign_of_a_zero(spark, tmp_path):
    spark.createDataFrame([(1, [-1e-8, 1.0])], "vec_id int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [str(x) for x in registry.queries()["t5_l2_normalize"](spark, str(tmp_path)).first().v] == ["-0.0", "1.0"]


@pytest.mark.parametrize("blocks", [(20_000, 1000, 1024), (3, 7, 2)])
def test_search_by_words_sends_on_only_the_best(spark, monkeypatch, blocks):
    pick = random.Random(5)
    monkeypatch.setattr(lexical, "top_k", lambda df, *a, top_k=lexical.top_k: met.append(df.count()) or top_k(df, *a))
    for name, value in zip(("QUERY_BLOCK", "MEETING_CHUNKS", "MEETING_QUERIES"), blocks, strict=True):
        monkeypatch.setattr(lexical, name, value, raising=False)
    met, words = [], ["oil", "pump", "the", "Ventil", "泵油", "泵 油x", "kalt_1"]
    bodies = [(f"c{i}", " ".join(pick.choices(words, k=pick.randint(0, 9)))) for i in range(700)] + [("n", None)]
    asked = [(i, " ".join(pick.choices([*words, "nowhere"], k=4))) for i in range(8)] + [(8, "the"), (9, None)]
    chunks, queries = spark.createDataFrame(bodies, "chunk_id string, text string").coalesce(1), spark.createDataFrame(asked, "query_id int, text string")
    got = sorted(map(tuple, lexical.bm25_search(queries, chunks, 5).collect()))
    cut = lambda x: fx.tokens_of((x or "").lower())
    docs = {i: Counter(cut(x)) for i, x in bodies}
    assert {i: Counter(r.t) for i, r in zip(docs, chunks.select(fx.tokenize("text").alias("t")).collect(), strict=True)} == docs
    mean, want = sum(d.total() for d in docs.values()) / len(docs), []
    for q, x in asked:
        scores = {}
        for term, qtf in Counter(cut(x)).items():
            n = sum(term in d for d in docs.values())
            for i, d in docs.items():
                if term in d:
                    scores[i] = scores.get(i, 0) + qtf * math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * d[term] * 2.5 / (d[term] + 1.5 * (0.25 + 0.75 * d.total() / mean))
        want += [(q, i, round(s, 6), r + 1) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5])]
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in sorted(want)] and all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(got, sorted(want), strict=True))
    assert sum(met) <= (100 if blocks[1] == 1000 else 3000)  # of about 5000 pairs that share a word


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_meet_queries_in_small_products(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "MEETING_VECTORS", block)
    monkeypatch.setattr(vectors, "MEETING_QUERIES", block)
    pick = random.Random(6)
    rows = [(i, [float(pick.randint(-1, 1)) for _ in range(3)]) for i in range(300)] + [(300, None)]  # many equal scores
    table = spark.createDataFrame(rows, "vec_id int, embedding array<float>").coalesce(1)
    asked = table.filter("vec_id < 30").withColumnRenamed("vec_id", "query_id")
    unit = lambda v: [x / (math.hypot(*v) or 1) for x in v]
    want = []
    for q, x in rows[:30]:
        best = sorted((-round(math.sumprod(unit(x), unit(v)), 6), i) for i, v in rows[:300])[:10]
        want += [(q, i, -s + 0.0, r + 1) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, vectors.vector_search(asked, table, 10).collect())) == sorted(want)


def test_point_hits_make_no_pairs_of_the_text(spark):
    rows = [("ab", "xaby"), ("abcd", "ab-cd"), ("abcd", "zab cdz"), ("a", "b"), ("a", "a"), ("", "a"), (None, "a"), ("ab", None), ("abcde", "abxdy"), ("漢字x", "字x")]
    df = spark.createDataFrame(rows, "p string, t string")
    hit = evaluate.point_hit(fx._col("p"), fx._col("t"))
    share = fx.overlap(fx.char_bigrams("p"), fx.char_bigrams("t")) >= 0.5
    want = [bool((p or "") and (n or s)) for p, n, s in df.select("p", fx.normalized("t").contains(fx.normalized("p")), share).collect()]
    assert [r[0] for r in df.select(hit).collect()] == want
    assert "array_intersect" not in df.select(hit)._jdf.queryExecution().toString()


def test_support_is_found_without_a_row_for_each_pair(spark):
    sentences = spark.createDataFrame([(1, 0, 0, "abcd"), (1, 0, 1, "cdef"), (1, 1, 0, "zz"), (2, 0, 0, "q"), (3, 0, 0, "ab")], "answer_id int, line_no int, no int, sentence string")
    blocks = spark.createDataFrame([(1, 2, "abcd ef"), (1, 1, "xabcdx"), (2, 1, "q"), (2, 2, "pq"), (4, 1, "ab")], "answer_id int, n int, text string")
    found = citations.best_support(sentences, blocks)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 1, 1.0), (1, 0, 1, 2, 1.0), (2, 0, 0, 1, 1.0)]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_trimmed_as_in_sql(spark):
    texts = ["　 a b\t\r\n\x0b\f", "a  ", "a\n\u0085", " a", " 　", ""]  # a pattern's `$` also stands before a last line separator
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", fx.trimmed("x").alias("x")).collect()
    assert [r.x for r in sorted(got)] == ["a b", "a  ", "a\n\u0085", " a", "", ""]


def test_kinds_and_numbers_without_a_pattern_for_each(spark):
    assert all(re.match(r"[§《㐀-鿿]", p) for p in f"{citations.DISCLAIMER}|{citations.ATTRIBUTION}".split("|"))  # no sentence is passed over that begins one of them
    sentences = {"Valve 4 opens late.": "claim", "It is late, 未找到。": "disclaimer", "见《手册》第 3 页。": "attribution", "依据：手册第 3 页说明。": "attribution", "- 依据: the whole manual": "exempt", "**Steps**：      ": "exempt", "12345 [3] late": "exempt", " [3] and more": "exempt", "see § 4 of it": "attribution", "see § 4 of the long manual": "claim", "short": "short"}
    got = spark.createDataFrame(list(sentences), "string").select("value", citations.sentence_kind(F.col("value")).alias("kind")).collect()
    assert dict(map(tuple, got)) == sentences
    cited = {"[1] [2, 3]": [1, 2, 3], "［4–6，9、2-1］": [4, 5, 6, 9], "[7 - 8]": [7, 8], "[0-51]": [], "[99999999999999999999] [1-99999999999999999999]": [], "[3\t] [\n5]": [3, 5], "": []}
    got = spark.createDataFrame(list(cited), "string").select("value", citations.parse_citation_ids("value").alias("ids")).collect()
    assert dict(map(tuple, got)) == cited


def test_features_are_counted_without_a_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(vectors, "DOCS_AT_ONCE", 3, raising=False)
    monkeypatch.setattr(vectors, "KNOWN_FEATURES", 4, raising=False)
    pick = random.Random(9)
    texts = [(i // 2 if i < 8 else i, " ".join(pick.choices(["Oil", "pump_1", "泵油", "泵 x油", "ÄB", "the"], k=pick.randint(0, 12)))) for i in range(40)] + [(40, None), (41, "- ü"), (None, "oil"), (42, "泵")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {}
    for own in {i for i, _ in texts if i is not None}:
        bag = Counter()
        for _, x in (r for r in texts if r[0] == own):  # the rows of an id are one document, but no pair goes from one row to the next
            cjk = "".join(re.findall("[㐀-鿿]", x or ""))
            bag.update([*cjk, *(cjk[i : i + 2] for i in range(len(cjk) - 1)), *re.findall("[a-z0-9_]+", (x or "").lower())])
        sums = {}
        for f, n in bag.items():
            h = hashlib.md5(f.encode()).hexdigest()
            sums[int(h[:3], 16) % 512] = sums.get(int(h[:3], 16) % 512, 0) + (1 + math.log(n)) * (-1 if int(h[8], 16) % 2 else 1)
        want |= {(own, b): v / math.hypot(*sums.values()) for b, v in sums.items()}
    found = vectors.hashing_features(docs)
    got = {(r.doc_id, r.bucket): r.value for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert found.dtypes == [("doc_id", "bigint"), ("bucket", "int"), ("value", "double")]
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    dense = {r.doc_id: r.embedding for r in vectors.hashing_embed(docs.filter("doc_id > 35")).collect()}
    assert sum(map(bool, dense[40])) == 0 and abs(math.hypot(*dense[39]) - 1) < 1e-6 and len(dense) == 7


def test_features_that_cancel_out_and_rows_without_an_id(spark, tmp_path):
    place = lambda f: (int((h := hashlib.md5(f.encode()).hexdigest())[:3], 16) % 512, int(h[8], 16) % 2)
    words = {}
    for f in (f"w{i}" for i in range(9999)):
        words.setdefault(place(f)[0], {}).setdefault(place(f)[1], []).append(f)
    bucket, signs = next((b, x) for b, x in words.items() if len(x) == 2 and min(map(len, x.values())) > 1)
    up, down = signs[0][:2], signs[1][:2]
    other = next(x[0][0] for b, x in words.items() if b != bucket and 0 in x)
    noise = " ".join([up[0]] * 6 + [down[0]] * 2 + [down[1]] * 3 + [up[1]])  # nothing but for what is rounded off
    total = (1 + math.log(6)) - (1 + math.log(2)) - (1 + math.log(3)) + 1
    rows = [(1, f"{up[0]} {down[0]}"), (2, f"{noise} {other}"), (None, other), (None, other), (4, "- ü"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.bucket): str(r.value) for r in registry.queries()["t3_hashing_embed"](spark, str(tmp_path)).collect()}
    assert -1e-12 < total < 0 and got == {(1, bucket): "nan", (2, bucket): "-0.0", (2, place(other)[0]): "1.0", (None, place(other)[0]): "1.0"}
    assert {r.doc_id for r in vectors.hashing_features(docs).collect()} == {2}
    assert {r.doc_id: any(r.embedding) for r in vectors.hashing_embed(docs.filter("doc_id < 5")).collect()} == {1: False, 2: True, 4: False}


def test_chunks_take_the_columns_of_their_own_row(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 900, "de", "web"), (1, "b", "en", "book"), (2, None, "en", "web")], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = chunks(spark, str(tmp_path))
    assert sorted((r.chunk_id, r.text[0], r.category, r.device_model) for r in found.collect()) == [("1-0", "a", "de", "web"), ("1-0", "b", "en", "book"), ("1-1", "a", "de", "web")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_upsert_leaves_what_is_new_as_it_was_written(spark, tmp_path):
    store, row = Store(spark, str(tmp_path)), "key string, n int"
    rows = lambda keys, n: spark.createDataFrame([(None if k is None else f"k{k}", n) for k in keys], row)
    store.change({"t": Change(rows([*range(40), *range(40), None], 1), key="key", parts=2)})
    assert sorted(r.key for r in store.table("t").filter("key IS NOT NULL").collect()) == sorted(f"k{i}" for i in range(40))
    for n in (2, 3):
        store.change({"t": Change(rows([*range(30, 50), 30, None], n), "upsert", "key")})
        found = store.table("t").collect()
        assert sorted((r.key, r.n) for r in found if r.key) == sorted((f"k{i}", 1 if i < 30 else n) for i in range(50))
        assert sum(r.key is None for r in found) == n  # a key that is null is equal to none
    written = [f for found in store.manifest()["tables"]["t"]["folders"].values() for f in found]
    assert sum("-new/" in f for f in written) == 2 and len(written) == 4  # of each part what is new, and what stayed
    store.change({"t": Change(rows(range(50), 4), "upsert", "key")})
    store.change({"t": Change(rows([], 5), "upsert", "key")})
    store.vacuum(1)
    assert {r.n for r in store.table("t").filter("key IS NOT NULL").collect()} == {4}
