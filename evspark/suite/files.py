"""Queries of readers and writers: each first writes the files that it reads. And of plug-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.functions import plugins
from evspark.operators import evaluate
from evspark.sources import files
from evspark.sources.store import shared_folder
from evspark.suite.inputs import documents, table


def _lines(spark, df: DataFrame, name: str) -> str:
    folder = shared_folder(spark, name)
    df.write.text(folder)
    return folder


def _corpus(s, sf):
    """Documents as files, one for each of 50 groups, in UTF-8 with a mark in front of some."""
    folder, group = shared_folder(s, "corpus"), F.col("doc_id") % 50
    texts = documents(s, sf).groupBy(group.alias("g")).agg(F.expr("listagg(substring(coalesce(text, ''), 1, 200), '') WITHIN GROUP (ORDER BY doc_id)").alias("text"))
    marked = texts.select(F.concat(F.when(F.col("g") % 2 == 0, "\ufeff").otherwise(""), F.regexp_replace("text", "\\s+", " ")).alias("value"), F.col("g").cast("string").alias("g"))
    marked.repartition("g").write.partitionBy("g").text(folder)
    found = files.scan_corpus(s, folder)
    return found.select(F.regexp_extract("path", "g=([0-9]+)/", 1).cast("int").alias("g"), F.md5(F.regexp_replace("text", "\n$", "")).alias("md5"))


def _golden(s, sf):
    folder = shared_folder(s, "golden")
    b = table(s, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.array("text").alias("answer_points"), F.when(F.col("item_id") % 4 == 0, True).alias("negative"))
    b.write.json(folder)
    return files.read_golden(s, folder).select("id", F.md5("question").alias("md5"), "negative", F.size("answer_points").alias("points"))


def _tickets(s, sf):
    """Documents as lines of tickets, of which some are cut, no object, or have a field of another type."""
    i, row = F.col("doc_id"), F.to_json(F.struct(F.concat(F.lit("T"), F.col("doc_id")).alias("ticket_no"), F.col("text").alias("symptom"), F.array("source").alias("parts_used")))
    value = F.when(i % 9 == 1, F.substring(row, 1, 30)).when(i % 9 == 2, "[1]").when(i % 9 == 3, F.concat(F.lit('{"ticket_no": "T'), i, F.lit('", "parts_used": 5}'))).otherwise(row)
    folder = _lines(s, documents(s, sf).select(value.alias("value")), "tickets")
    good = files.read_reference(s, folder, files.TICKETS).select("ticket_no", F.md5(F.coalesce("symptom", F.lit(""))).alias("md5"), F.get("parts_used", F.lit(0)).alias("part"))
    return good.unionByName(files.read_corrupt(s, folder, files.TICKETS).agg(F.lit("corrupt").alias("ticket_no"), F.lit("").alias("md5"), F.count(F.lit(1)).cast("string").alias("part")))


def _report(s, sf):
    path = shared_folder(s, "report")
    summary = table(s, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("top"))
    files.write_report(summary, path)
    return s.read.schema("event_type string, n long, top double").json(path)


def _loads(s, sf):
    """Rounds of requests by event type as reports of several lines each."""
    e = table(s, sf, "events").groupBy((F.col("user_id") % 6).alias("c"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("bad"))
    one = F.struct(F.col("c").cast("int").alias("concurrency"), (F.col("n") - F.col("bad")).cast("int").alias("n_ok"), F.col("bad").cast("int").alias("n_failed"), F.concat_ws(" ", "event_type", F.lit("round")).alias("verdict"))
    reports = e.groupBy("event_type").agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("rounds"))).alias("value"))  # six rounds a report
    folder = shared_folder(s, "loads")
    reports.select(F.regexp_replace("value", ",", ",\n").alias("value"), "event_type").repartition("event_type").write.partitionBy("event_type").text(folder)
    return files.read_load_reports(s, folder).select("concurrency", "n_ok", "n_failed", "verdict")


def _timings(s, sf):
    """Events of a user as stages with times and errors."""
    e = table(s, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.create_map(F.col("event_type"), F.round("value", 4)).alias("timings"), F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("e"), F.col("event_id")))).otherwise(F.array().cast("array<string>")).alias("errors"))
    merged = plugins.merge_timings(e, "user_id")
    return merged.select("user_id", F.size("errors").alias("errors"), F.get("errors", F.lit(0)).alias("first"), F.array_join(F.transform(F.array_sort(F.map_entries("timings")), lambda x: F.concat_ws("=", x["key"], F.format_string("%.4f", x["value"]))), ",").alias("timings"))


def _image_eval(s, sf):
    d = documents(s, sf)
    golden = d.select(F.col("doc_id").alias("id"), F.array(F.lit("the"), F.col("lang")).alias("expected"), (F.col("doc_id") % 5 == 0).alias("negative"))
    results = d.filter("doc_id % 7 > 0").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", F.when(F.col("doc_id") % 2 == 0, F.upper("lang"))).alias("extracted"), F.when(F.col("doc_id") % 10 == 0, "NOT_COVERED").otherwise("OK").alias("status"), F.lit("").alias("answer"))
    return evaluate.image_eval(results, golden)


QUERIES = {
    "s1_scan_corpus": (_corpus, "SELECT (doc_id % 50)::INT AS g, md5(regexp_replace(string_agg(substr(coalesce(text, ''), 1, 200), '' ORDER BY doc_id), '\\s+', ' ', 'g')) AS md5 FROM documents GROUP BY 1"),
    "s3_read_golden": (_golden, "SELECT item_id::VARCHAR AS id, md5(text) AS md5, item_id % 4 = 0 AS negative, 1 AS points FROM benchmark"),
    "s4_read_reference": (_tickets, """SELECT 'T' || doc_id AS ticket_no, md5(coalesce(text, '')) AS md5, source AS part FROM documents WHERE doc_id % 9 NOT IN (1, 2, 3)
      UNION ALL SELECT 'corrupt', '', count(*)::VARCHAR FROM documents WHERE doc_id % 9 IN (1, 2, 3)"""),
    "s10_write_report": (_report, "SELECT event_type, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY 1"),
    "s11_load_reports": (_loads, "SELECT (user_id % 6)::INT AS concurrency, (count(*) - count(*) FILTER (value > 50))::INT AS n_ok, (count(*) FILTER (value > 50))::INT AS n_failed, event_type || ' round' AS verdict FROM events GROUP BY user_id % 6, event_type"),
    "u4_merge_timings": (_timings, """WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), t AS (SELECT user_id, string_agg(event_type || '=' || printf('%.4f', round(v, 4)), ',' ORDER BY event_type) AS timings FROM l GROUP BY 1)
      SELECT user_id, count(*) FILTER (event_type = 'error')::INT AS errors, 'e' || min(event_id) FILTER (event_type = 'error') AS first, any_value(timings) AS timings FROM events JOIN t USING (user_id) GROUP BY 1"""),
    "e10_image_eval": (_image_eval, """WITH g AS (SELECT doc_id AS id, doc_id % 5 = 0 AS negative, doc_id % 7 > 0 AS there, CASE WHEN doc_id % 10 = 0 THEN 'NOT_COVERED' ELSE 'OK' END AS status, lower(coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' ' || lang ELSE '' END) AS t, lang FROM documents),
      m AS (SELECT *, array_to_string(list_filter(['the', lang], lambda x: NOT contains(t, lower(x))), ', ') AS missing FROM g)
      SELECT id, reason IS NULL AS passed, reason FROM (SELECT id, CASE WHEN NOT there THEN 'no result' WHEN negative AND status <> 'NOT_COVERED' THEN 'not refused' WHEN NOT negative AND missing <> '' THEN 'missing: ' || missing END AS reason FROM m)"""),
}
