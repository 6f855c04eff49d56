import uuid

import pytest
from pyspark.sql import functions as F

from evspark import registry
from evspark.operators import context, maintenance, parts, plan_items, retrieve, training, vectors
from evspark.sources import files
from evspark.streaming import tables


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    order = [r.chunk_id for r in retrieve.rrf_fuse([(a, 1.0), (b, 1.0)]).orderBy(F.desc("score")).collect()]
    assert order == ["b", "a", "c"]
    assert sorted(retrieve.rrf_fuse([(b, 1.0), (a, 1.0)]).collect()) == sorted(retrieve.rrf_fuse([(a, 1.0), (b, 1.0)]).collect())


def test_newer_version_wins(spark):
    rows = [(1, 1, "x", "T", "3", "V2.0"), (1, 2, "y", "T", "3", "V3.10"), (1, 3, "z", "T", "3", "V3.2"), (1, 4, "w", None, "3", None)]
    df = spark.createDataFrame(rows, "query_id int, pos int, chunk_id string, doc_title string, section string, version string")
    assert [(r.chunk_id, r.pos) for r in context.prefer_newer(df).orderBy("pos").collect()] == [("y", 1), ("w", 2)]


def test_ann_recall(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    exact, near = (set(map(tuple, d.select("query_id", "vec_id").collect())) for d in (vectors.vector_search(q, v, 10), vectors.vector_search_ann(q, v, 10, 64, bits=4, tables=24)))
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_ann_recall_of_the_query(spark, sf, size):
    big = sf.replace("0.001", size)
    found = {(r.query_id, r.vec_id) for r in registry.queries()["r4_vector_search_ann"](spark, big).collect()}
    v = spark.read.parquet(f"{big}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in vectors.vector_search(v.filter(F.col("vec_id").isin({q for q, _ in found})).withColumnRenamed("vec_id", "query_id"), v, 10).collect()}
    others = {(q, i) for q, i in exact if q != i}
    assert len(found & others) >= 0.9 * len(others) > 0


def test_glossary_and_forms(spark):
    g = spark.createDataFrame([("密封圈", "term", 0, ["O型圈", "胶圈"])], "canonical string, kind string, ordinal int, synonyms array<string>")
    assert retrieve.glossary_lookup(spark.createDataFrame([("胶圈",)], "term string"), g).first().canonical == "密封圈"
    forms = retrieve.expand_queries(spark.createDataFrame([(1, "胶圈怎么换"), (2, "别的")], "query_id int, text string"), g).orderBy("query_id").collect()
    assert forms[0].forms == ["胶圈怎么换", "密封圈怎么换", "胶圈怎么换 密封圈"] and forms[1].forms == ["别的"]


def test_cart_and_status(spark):
    events = [(1, 1, "add", "a", 2), (1, 2, "add", "a", 998), (1, 3, "set", "b", 5), (1, 4, "remove", "b", 0), (1, 5, "submit", None, None), (1, 6, "add", "a", 1)]
    cart = parts.fold_cart(spark.createDataFrame(events, "order_id int, seq int, action string, code string, qty int")).collect()
    assert [tuple(r) for r in cart] == [(1, "a", 999)]
    lost = parts.rejected_edits(spark.createDataFrame(events, "order_id int, seq int, action string, code string, qty int")).orderBy("seq").collect()
    assert [tuple(r) for r in lost] == [(1, 3, "no such item"), (1, 4, "no such item"), (1, 6, "not a draft")]
    steps = [(1, 1, "submit", ""), (1, 2, "reject", ""), (1, 3, "reject", "取消：错单"), (1, 4, "approve", "")]
    row = parts.fold_order_status(spark.createDataFrame(steps, "order_id int, seq int, action string, reason string")).first()
    assert (row.status, row.accepted, row.rejected) == ("cancelled", [1, 3], [2, 4])


def test_cycles(spark):
    s = spark.createDataFrame([(1, 0, "密封圈每 3 个月更换；泵油累计运行 500 小时换油；型号 12 片。")], "chunk_id int, no int, sentence string")
    assert sorted((r.basis, r.value) for r in maintenance.extract_cycles(s).collect()) == [("days", 90.0), ("hours", 500.0)]


def test_quiz_items_are_traceable(spark):
    s = training.quiz_sentences(spark.createDataFrame([(i, f"- 压力为 {i + 10} 帕，温度为 {i + 20} 度，流量为 {i + 30} 升。") for i in range(12)], "chunk_id int, text string"))
    for r in training.quiz_items(s).collect():
        numbers = {str(r.chunk_id + k) for k in (10, 20, 30)}
        if r.type == "single":
            assert set(r.options) <= numbers and "____" in r.question and r.question.replace("____", r.options[int(r.answer)]) == r.evidence
        else:
            assert (r.question == r.evidence) == (r.answer == "true")


def test_grading(spark):
    rows = [("single", "b", "1", True), ("multiple", "[0,2]", "2,0", True), ("judgement", "对", "true", True), ("short", "压力五帕以下", "x", True), ("short", "", "x", False), ("single", None, "1", False)]
    df = spark.createDataFrame(rows, "kind string, given string, answer string, want boolean")
    got = df.select("want", training.grade(F.col("kind"), F.col("given"), F.col("answer"), F.array(F.lit("压力五帕"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_streams_equal_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value", "event_type", "event_id")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = tables.run_to_table(tables.stream_latency(stream, "6 hours"), f"t{uuid.uuid4().hex[:8]}", "complete").collect()
    want = e.groupBy(F.window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n")).count()
    assert len(got) == want and sum(r.n for r in got) == e.count()
    steps = spark.createDataFrame([(1, 1, "submit"), (1, 2, "receive"), (2, 3, "cancel")], "order_id long, seq long, action string")
    steps.coalesce(1).write.parquet(str(tmp_path / "steps"))
    got = tables.run_to_table(tables.stream_order_status(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps"))), f"t{uuid.uuid4().hex[:8]}", "append").orderBy("seq").collect()
    assert [(r.status, r.legal) for r in got] == [("submitted", True), ("submitted", False), ("cancelled", True)]


def test_scan_corpus(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("真空".encode("gb18030"))
    (tmp_path / "b.TXT").write_bytes("﻿泵".encode())
    (tmp_path / "c.bin").write_bytes(b"x")
    assert sorted(r.text for r in files.scan_corpus(spark, str(tmp_path)).collect()) == ["泵", "真空"]
    assert files.read_reference(spark, str(tmp_path / "none.json"), files.GLOSSARY).count() == 0


def _kinds(spark, rows):
    return [r.k for r in spark.createDataFrame(rows, "s string, pos int").select(plan_items.item_type(F.col("s"), F.col("pos")).alias("k")).collect()]


def test_item_type_is_of_the_nearest_word(spark):
    rows = [("排气过滤器 4000 h 更换；每 8000 h 检查轴承", 6), ("更换；轴承每满 8000 h 检查", 8), ("清洗" + "甲" * 50 + "每 3 天", 54), ("更换；轴承满 8000 h 检查", 7), ("甲每 3 天", 3), (None, 0)]
    assert _kinds(spark, rows) == ["耗材更换", "PM 项", "清洗", "耗材更换", "PM 项", "PM 项"]


def test_names_of_items(spark):
    rows = [
        ("便携式检测仪：每 6 个月检定", 0, 8, "", "", "便携式检测仪"), ("绝缘工具；绝缘手套每 6 个月试验", 5, 11, "", "", "绝缘手套"), ("浓度每 4 小时检测", 0, 4, "", "", "浓度检测"),
        ("SC-1 药液，更换周期为 24 小时", 8, 14, "", "", "SC-1 药液"), ("每 3 天检查", 0, 2, "维护", "手册", "维护"), ("每 3 天检查", 0, 2, None, "手册", "手册 维护项"),
    ]
    d = spark.createDataFrame(rows, "s string, a int, p int, h string, t string, want string")
    for r in d.select("*", plan_items.derive_name(*[F.col(c) for c in "saph"], F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_plans_prefer_the_basis_and_carry_alternates(spark):
    chunks = [
        (1, "A", "换油周期为 12 个月。", "手册", 3), (2, "通用", "泵油累计 4000 小时或 12 个月更换，以先到者为准；滤芯每 90 天清洗。", "通则", 7), (3, "B", "绝缘手套每 6 个月试验；绝缘手套每 6 个月试验。", None, None),
        (4, None, "安全带每 2 年更换。", "", None), (5, "A", None, None, None), (6, "A", "", None, None),
    ]
    c = spark.createDataFrame(chunks, "chunk_id int, device_model string, text string, doc_title string, page int")
    got = {(r.device_model, r.n): r for r in plan_items.generate_plans(spark.createDataFrame([("A",), ("B",), ("A",)], "device_model string"), c).collect()}
    assert [(k, got[k].item, got[k].chunk_id) for k in sorted(got)] == [(("A", 1), "罗茨泵换油", 2), (("A", 2), "安全带更换", 4), (("B", 1), "罗茨泵换油", 2), (("B", 2), "绝缘手套", 3), (("B", 3), "安全带更换", 4)]
    assert got["A", 1].value == 4000 and "《通则》 第 7 页" in got["A", 1].note and got["A", 1].note.endswith("12 个月（以先到者为准）")
    assert "1年=365 天折算为 730 天" in got["A", 2].note and "《未知文档》" in got["A", 2].note
    assert plan_items.generate_plans(spark.createDataFrame([], "device_model string"), c.limit(0)).count() == 0
