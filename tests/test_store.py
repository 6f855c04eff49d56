"""Tables of versions, the written index, and the streams that end in them."""

import pytest
from pyspark.sql import functions as F

from evspark.operators import ingest, parts
from evspark.sources import index
from evspark.sources.store import Change, Store, shared_folder
from evspark.streaming import tables
from evspark.suite.streams import order_events

DOCS = "doc_id string, text string, version string"


@pytest.fixture
def home(spark):
    return shared_folder(spark, "test")


def rows(df):
    return sorted(map(tuple, df.collect()))


def keyed(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v int")


class Crash(Exception):
    pass


def crash(*_):
    raise Crash


def test_changes_of_a_store(spark, home, monkeypatch):
    store = Store(spark, home)
    assert store.table("t") is None and store.manifest()["version"] == 0
    store.change({"t": Change(keyed(spark, [(str(i), i) for i in range(50)]), "overwrite", "k", 8), "log": Change(keyed(spark, [("a", 1)]), "append")})
    first = store.manifest()
    store.change({"t": Change(keyed(spark, [("3", 300), ("new", 1), ("new", 1)]), "upsert", "k"), "log": Change(keyed(spark, [("b", 2)]), "append")})
    want = sorted([(str(i), 300 if i == 3 else i) for i in range(50)] + [("new", 1)])
    assert rows(store.table("t")) == want and rows(store.table("log")) == [("a", 1), ("b", 2)]
    old, new = first["tables"]["t"]["folders"], store.manifest()["tables"]["t"]["folders"]
    assert 1 <= sum(old.get(p) != new[p] for p in new) <= 2  # only parts that rows fell in
    assert rows(store.table("t", version=1)) == sorted((str(i), i) for i in range(50))
    reading = store.table("t")
    monkeypatch.setattr(Store, "commit", crash)
    with pytest.raises(Crash):
        store.change({"t": Change(keyed(spark, [("3", 0)]), "upsert", "k"), "log": Change(keyed(spark, [("c", 3)]), "append")})
    monkeypatch.undo()
    assert rows(store.table("t")) == want and rows(store.table("log")) == [("a", 1), ("b", 2)]
    store.change({"t": Change(keyed(spark, [("only", 1)]), "overwrite", "k")})
    assert rows(store.table("t")) == [("only", 1)] and rows(reading) == want  # who reads the version before goes on
    store.vacuum(keep=1)
    assert store.versions() == [3] and rows(store.table("t")) == [("only", 1)] and rows(store.table("log")) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="other columns"):
        store.change({"t": Change(keyed(spark, []).withColumn("more", F.lit(1)), "upsert", "k")})
    store.change({"t": Change(keyed(spark, []), "upsert", "k")})
    assert rows(store.table("t")) == [("only", 1)]


def test_two_jobs_cannot_both_be_next(spark, home):
    store = Store(spark, home)
    store.change({"t": Change(keyed(spark, [("a", 1)]))})
    late = store.manifest() | {"version": 1, "tables": {}}
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(late)
    assert rows(store.table("t")) == [("a", 1)]


def test_batches_count_once(spark, home):
    store = Store(spark, home)
    for batch, row in ((0, "a"), (0, "a"), (1, "b"), (0, "x"), (1, "y")):
        store.change({"log": Change(keyed(spark, [(row, 1)]), "append")}, stream="s", batch=batch)
    store.change({"log": Change(keyed(spark, [("c", 1)]), "append")}, stream="another", batch=0)
    assert rows(store.table("log")) == [("a", 1), ("b", 1), ("c", 1)]


def chunker(docs):
    cut = ingest.chunk_fixed(docs, 10, 2)
    return cut.select(F.concat_ws("-", "doc_id", "index").alias("chunk_id"), "doc_id", "text")


def rebuild(docs, home, mode="overwrite"):
    return rows(index.rebuild_index(docs, chunker, home, "hash", "512", 512, mode, ("version",)))


def test_rebuild_of_the_index(spark, home, monkeypatch):
    one = spark.createDataFrame([("a", "0123456789abcdef", "V1"), ("bad", None, "V1"), ("no version", "x", " ")], DOCS)
    assert rebuild(one, home) == [("a", 2, "ok", None), ("bad", 0, "failed", "no text"), ("no version", 0, "failed", "missing version")]
    assert rows(index.read_failures(spark, home)) == [("bad", "no text"), ("no version", "missing version")]
    (m,) = index.index_manifest(spark, home).collect()
    assert (m.provider, m.signature, m.dim, m.version, m.n_chunks, m.n_documents) == ("hash", "hash:512", 512, 1, 2, 1) and m.updated_at
    two = spark.createDataFrame([("a", "short", "V2"), ("bad", "now it has text", "V1"), ("c", "", "V1")], DOCS)
    assert rebuild(two, home, "append") == [("a", 1, "ok", None), ("bad", 2, "ok", None), ("c", 0, "failed", "no text")]
    want = [("a-0", "a", "short"), ("a-1", "a", "89abcdef"), ("bad-0", "bad", "now it has"), ("bad-1", "bad", "as text")]
    assert rows(index.read_index(spark, home)) == want and rows(index.index_documents(spark, home)) == [("a", 2), ("bad", 2)]
    assert rows(index.read_failures(spark, home)) == [("c", "no text"), ("no version", "missing version")]
    kept, real = Store(spark, home), Store.commit
    monkeypatch.setattr(Store, "commit", lambda self, m: crash() if self.path == kept.path else real(self, m))
    for mode in ("overwrite", "append"):
        with pytest.raises(Crash):
            rebuild(one, home, mode)
        assert rows(index.read_index(spark, home)) == want and len(rows(index.read_failures(spark, home))) == 2
    monkeypatch.undo()
    assert rebuild(one, home)[0] == ("a", 2, "ok", None)
    assert rows(index.read_index(spark, home)) == [("a-0", "a", "0123456789"), ("a-1", "a", "89abcdef")] and kept.versions() == [1, 2, 3]
    index.drop_documents(spark, home, spark.createDataFrame([("a",)], "doc_id string"))
    assert index.read_index(spark, home).count() == 0


def test_write_index_keeps_to_one_signature(spark, home):
    chunks = spark.createDataFrame([("1", "a", [0.5, 0.5])], "chunk_id string, doc_id string, embedding array<float>")
    index.write_index(chunks, home, "local", "m", 2)
    index.write_index(chunks.withColumn("doc_id", F.lit("b")), home, "local", "m", 2, "upsert")
    assert rows(index.read_index(spark, home)) == [("1", "b", [0.5, 0.5])]
    with pytest.raises(ValueError, match="local:m"):
        index.write_index(chunks, home, "hash", "2", 2, "upsert")
    with pytest.raises(ValueError, match="no index"):
        index.read_index(spark, home + "-other")


def put(df, folder):
    df.coalesce(1).write.mode("append").json(folder)


def test_order_status_over_restarts(spark, sf, home, monkeypatch):
    events = order_events(spark.read.parquet(f"{sf}/events.parquet")).withColumn("order_id", F.col("order_id") % 40)
    store = Store(spark, f"{home}/store")
    stream = lambda: spark.readStream.schema(events.schema).json(f"{home}/in")
    third = events.count() // 3
    ids = sorted(r.seq for r in events.select("seq").collect())
    run = lambda: tables.run_order_status(stream(), store.path, f"{home}/checkpoint").awaitTermination()
    put(events.filter(F.col("seq") < ids[third]), f"{home}/in")
    run()
    put(events.filter((F.col("seq") >= ids[third]) & (F.col("seq") < ids[2 * third])), f"{home}/in")
    real = Store.commit
    monkeypatch.setattr(Store, "commit", lambda self, m: (real(self, m), crash()))  # the change is made, the stream does not come to know
    with pytest.raises(Exception, match="Crash"):
        run()
    monkeypatch.undo()
    put(events.filter(F.col("seq") >= ids[2 * third]), f"{home}/in")
    run()
    run()  # nothing new
    want = parts.fold_order_status(events)
    assert rows(store.table("status").select("order_id", "status")) == rows(want.select("order_id", "status"))
    assert rows(store.table("illegal").select("order_id", "seq")) == rows(want.select("order_id", F.explode("rejected").alias("seq")))


def test_question_stats_over_restarts(spark, home):
    log = spark.createDataFrame([(f"What is {'abc'[i % 3]}?", i) for i in range(30)], "question string, s int").select("question", F.timestamp_seconds("s").alias("created_at"), "s")
    stream = lambda: spark.readStream.schema(log.schema).json(f"{home}/in")
    for lo in (0, 7, 20):
        put(log.filter((F.col("s") >= lo) & (F.col("s") < {0: 7, 7: 20, 20: 30}[lo])), f"{home}/in")
        tables.run_question_stats(stream(), f"{home}/store", f"{home}/checkpoint").awaitTermination()
    assert rows(Store(spark, f"{home}/store").table("stats")) == rows(tables.stream_question_stats(log))
    tables.run_question_stats(stream(), f"{home}/store", f"{home}/another").awaitTermination()  # all of it again, by another query
    assert rows(Store(spark, f"{home}/store").table("stats")) == rows(tables.stream_question_stats(log))


def test_stream_ingest_replaces_and_keeps_apart(spark, home):
    schema = "path string, doc_id string, text string"

    def pipeline(batch):
        judged = index.reject_reason(batch)
        return chunker(judged.filter("reason IS NULL")), judged.filter("reason IS NOT NULL").select("path", "reason")

    def take(files, checkpoint="checkpoint"):
        if files:
            put(spark.createDataFrame(files, schema), f"{home}/in")
        tables.stream_ingest(spark.readStream.schema(schema).json(f"{home}/in"), pipeline, f"{home}/store", f"{home}/{checkpoint}").awaitTermination()
        store = Store(spark, f"{home}/store")
        return [(r[0], r[2]) for r in rows(store.table("chunks"))], rows(store.table("quarantine"))

    assert take([("/a", "a", "first text"), ("/b", "b", None)]) == ([("a-0", "first text")], [("/b", "no text")])
    assert take([("/a", "a", "other"), ("/c", "c", " ")]) == ([("a-0", "other")], [("/b", "no text"), ("/c", "no text")])
    assert take([]) == ([("a-0", "other")], [("/b", "no text"), ("/c", "no text")])
    assert take([("/b", "b", "has text")]) == ([("a-0", "other"), ("b-0", "has text")], [("/c", "no text")])
