"""Readers, writers and plug-ins."""

import json

from pyspark.sql import functions as F

from evspark.functions import plugins
from evspark.functions import text as fx
from evspark.operators import evaluate
from evspark.sources import files


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    good = {"ticket_no": "T1", "symptom": "leak", "parts_used": ["a"], "date": "2024-01-02", "extra": 5}
    lines = [json.dumps(good), "", "  ", '{"ticket_no": "T2"', "[1, 2]", "null", '{"ticket_no": "T3", "parts_used": "x"}', '{"ticket_no": "T4"}']
    (tmp_path / "t.json").write_text("\n".join(lines))
    rows = files.read_reference(spark, str(tmp_path / "t.json"), files.TICKETS)
    assert [(r.ticket_no, r.parts_used, str(r.date)) for r in rows.orderBy("ticket_no").collect()] == [("T1", ["a"], "2024-01-02"), ("T4", None, "None")]
    bad = files.read_corrupt(spark, str(tmp_path / "t.json"), files.TICKETS).collect()
    assert sorted(r.line for r in bad) == sorted(lines[i] for i in (3, 4, 5, 6)) and all(r.path.endswith("t.json") for r in bad)
    for read in (files.read_reference, files.read_corrupt):
        assert read(spark, str(tmp_path / "none.json"), files.TICKETS).count() == 0


def test_golden_items(spark, tmp_path):
    items = [{"id": f"g{i}", "question": "q", "must_cite": ["d#1"], **({"negative": True} if i == 2 else {})} for i in range(5)]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, items)))
    path = str(tmp_path / "g.jsonl")
    assert [(r.id, r.negative, r.must_cite) for r in files.read_golden(spark, path, ["g2", "g4", "none"]).orderBy("id").collect()] == [("g2", True, ["d#1"]), ("g4", False, ["d#1"])]
    assert [r.id for r in files.read_golden(spark, path, limit=2).collect()] == ["g0", "g1"]


def test_reports(spark, tmp_path):
    files.write_report(spark.createDataFrame([(1, "a"), (2, None)], "n int, s string"), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("part-*"))) == 1 and spark.read.schema("n int, s string").json(str(tmp_path / "r")).count() == 2
    rounds = [{"concurrency": c, "n_ok": c, "total_p95_s": 1.5 * c, "unknown": 1} for c in (1, 5)]
    for name in "ab":
        (tmp_path / f"load_{name}.json").write_text(json.dumps({"rounds": rounds, "at": "now"}, indent=2))
    got = files.read_load_reports(spark, str(tmp_path / "load_*.json")).collect()
    assert sorted((r.concurrency, r.total_p95_s, r.n_failed) for r in got) == [(1, 1.5, None)] * 2 + [(5, 7.5, None)] * 2


def test_embedding_goes_in_batches(spark):
    def load():
        def model(texts):
            assert len(texts) <= 3
            return [[float(len(t)), 3.0 * (len(t) > 0)] for t in texts]

        return model

    plugins.register_embedder("lengths", load, "lengths:2")
    rows = spark.createDataFrame([("abcd",), ("",), (None,), *[("x" * i,) for i in range(1, 9)]], "t string").coalesce(1).select(plugins.embed("lengths", 3)("t").alias("v")).collect()
    assert list(rows[0].v) == [0.8, 0.6] and list(rows[1].v) == list(rows[2].v) and len(rows) == 11


def test_scorer_probe(spark):
    plugins.register_scorer("shared", lambda: lambda q, t: [len(set(a) & set(b)) / 10 for a, b in zip(q, t, strict=True)], "1")
    rows = [(1, "abc", "abcd", True), (1, "abc", "xyz", False), (2, "pump", "pumps", True), (2, "pump", "door", False)]
    df = spark.createDataFrame(rows, "probe int, query string, text string, relevant boolean")
    probe = lambda c: plugins.scorer_probe(df, c).first().ok
    scorer = plugins.score("shared")(F.col("query"), F.col("text"))
    assert probe(scorer) and not probe(-scorer) and not probe(F.lit(1.0))
    assert plugins.scorer_probe(df.limit(0), scorer).first().ok is False
    longest = spark.createDataFrame([("a" * 9, "b" * 20 + "a")], "q string, t string").select(plugins.score("shared", 5)(F.col("q"), F.col("t")).alias("s")).first()
    assert longest.s == 0.0  # a text counts up to twice the model's length


def test_tokenizers_by_name(spark):
    plugins.register_tokenizer("words", lambda c: F.split(F.lower(c), " "))
    df = spark.createDataFrame([("A b the",)], "t string")
    assert df.select(plugins.TOKENIZERS["words"](F.col("t")).alias("x")).first().x == ["a", "b", "the"]
    assert plugins.TOKENIZERS["default"] is fx.tokenize


def test_timings_and_errors(spark):
    rows = [("t", 1, {"a": 1.0, "b": 2.0}, ["x"]), ("t", 3, {"b": 5.0}, ["z"]), ("t", 2, {"b": 4.0}, ["y"]), ("u", 1, {}, [])]
    got = {r.id: r for r in plugins.merge_timings(spark.createDataFrame(rows, "id string, seq int, timings map<string,double>, errors array<string>"), "id").collect()}
    assert got["t"].timings == {"a": 1.0, "b": 5.0} and got["t"].errors == ["x", "y", "z"] and got["u"].errors == []


def test_image_cases(spark):
    golden = spark.createDataFrame([(1, ["E1", "Pump"], False), (2, [], True), (3, ["x"], True), (4, ["x"], False)], "id int, expected array<string>, negative boolean")
    results = spark.createDataFrame([(1, "pump e2", "OK", ""), (2, None, "NOT_COVERED", ""), (3, "x", "OK", "")], "id int, extracted string, status string, answer string")
    got = {r.id: (r.passed, r.reason) for r in evaluate.image_eval(results, golden).collect()}
    assert got == {1: (False, "missing: E1"), 2: (True, None), 3: (False, "not refused"), 4: (False, "no result")}
