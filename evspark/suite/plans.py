"""Queries of composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.operators import evaluate, images, ingest
from evspark.plans import answer
from evspark.suite.ingest import BIGRAMS_SQL
from evspark.suite.inputs import CHUNKS, chunks, documents, table
from evspark.suite.retrieval import BM25


def _queries(s, sf):
    return table(s, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _points(s, sf):
    d, half = documents(s, sf), F.expr("length(text) div 2").cast("int")
    golden = d.select(F.col("doc_id").alias("id"), F.array(F.substring_index("text", ".", 1), F.substring_index("text", ".", -2), F.lit("no such thing")).alias("answer_points"))
    return evaluate.answer_metrics(d.select(F.col("doc_id").alias("id"), F.substring(F.col("text"), F.lit(1), half).alias("answer"), F.substring(F.col("text"), half + 1, F.length("text")).alias("evidence")), golden)


def _norm(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _images(s, sf):
    i = F.col("doc_id")
    return documents(s, sf).select((i % 300).alias("query_id"), F.expr("cast(doc_id div 300 + 1 AS int)").alias("image_no"), (i % 13 / 10).alias("confidence"), F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("n"), i % 9)).alias("name"), F.array(F.concat(F.lit("E"), i % 5)).alias("codes"), F.when(i % 6 == 0, "").otherwise(F.col("text")).alias("text"))


IMAGES = """im AS (SELECT doc_id % 300 AS query_id, doc_id // 300 + 1 AS image_no, least(1, (doc_id % 13) / 10) AS confidence, CASE WHEN doc_id % 4 > 0 THEN 'n' || (doc_id % 9) END AS name, 'E' || (doc_id % 5) AS code, CASE WHEN doc_id % 6 > 0 THEN text END AS text FROM documents WHERE doc_id // 300 + 1 <= 3),
mg AS (SELECT query_id, arg_max(image_no, confidence * 1000 - image_no) AS primary, max(confidence) AS confidence, arg_max(name, confidence * 1000 - image_no) FILTER (name IS NOT NULL) AS name, string_agg(text, chr(10) ORDER BY image_no) AS text FROM im GROUP BY 1)"""


def _replies(s, sf):
    i = F.col("doc_id")
    body = F.concat(F.lit('{"name": "n'), i, F.lit('", "confidence": 0.5}'))
    return documents(s, sf).select("doc_id", F.when(i % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(i % 3 == 1, F.concat(F.lit("It is "), body, F.lit(" so"))).otherwise("{broken").alias("reply"))


def _tickets(s, sf):
    return documents(s, sf).select(F.concat(F.lit("T"), F.col("doc_id")).alias("ticket_no"), F.col("source").alias("device_model"), F.col("text").alias("symptom"), F.when(F.col("doc_id") % 2 > 0, "c").otherwise("").alias("root_cause"), F.lit(None).cast("string").alias("action"), F.lit("done").alias("conclusion"))


QUERIES = {
    "s6_assert_signature": (lambda s, sf: images.assert_signature(ingest.manifest(documents(s, sf), "hash", "512", 512, "lang"), "hash:512").select("signature", "n_chunks"), "SELECT 'hash:512' AS signature, count(*) AS n_chunks FROM documents"),
    "r15_relaxed": (lambda s, sf: answer.relaxed(_queries(s, sf), chunks(s, sf), _queries(s, sf).filter("query_id % 3 > 0")), f"""WITH {CHUNKS}, {BM25.replace("documents", "chunks").replace("doc_id", "chunk_id").replace("lang", "category")}
      SELECT query_id, chunk_id, score, rank FROM bmr WHERE rank <= 80 AND query_id % 3 = 0"""),
    "r20_format_tickets": (lambda s, sf: images.format_tickets(_tickets(s, sf)).select("chunk_id", F.md5("text").alias("md5")), """SELECT 'ticket:T' || doc_id AS chunk_id, md5(concat_ws(chr(10), 'Ticket: T' || doc_id, 'Device: ' || source, 'Symptom: ' || text, CASE WHEN doc_id % 2 > 0 THEN 'Cause: c' END, 'Conclusion: done')) AS md5 FROM documents"""),
    "c16_merge_image_extractions": (lambda s, sf: images.merge_image_extractions(_images(s, sf)).select("query_id", "primary", "confidence", "name", "text"), f"WITH {IMAGES} SELECT * FROM mg"),
    "c17_image_query_terms": (lambda s, sf: images.image_query_terms(images.merge_image_extractions(_images(s, sf))).select("query_id", F.size("forms").alias("forms")), f"WITH {IMAGES} SELECT query_id, CASE WHEN name IS NULL THEN 1 ELSE 3 END AS forms FROM mg"),
    "c18_parse_model_json": (lambda s, sf: _replies(s, sf).select("doc_id", images.parse_model_json("reply", "name string, confidence double").alias("x")).select("doc_id", "x.name", "x.confidence"), "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'n' || doc_id END AS name, CASE WHEN doc_id % 3 < 2 THEN 0.5::DOUBLE END AS confidence FROM documents"),
    "c15_answer_batch": (lambda s, sf: answer.answer_batch(_queries(s, sf), chunks(s, sf)).select("query_id", "status", "confidence", "label", F.size("reasons").alias("n_reasons"), "coverage"), None),
    "e3_answer_metrics": (_points, f"""WITH g AS (SELECT doc_id AS id, unnest([split_part(text, '.', 1), array_to_string(string_split(text, '.')[-2:], '.'), 'no such thing']) AS point, substr(text, 1, length(text) // 2) AS answer, substr(text, length(text) // 2 + 1) AS evidence FROM documents),
      n AS (SELECT id, {_norm('point')} AS p, {_norm('answer')} AS a, {_norm("answer || chr(10) || evidence")} AS b FROM g), x AS (SELECT *, {BIGRAMS_SQL.format('p')} AS pp, {BIGRAMS_SQL.format('a')} AS ap, {BIGRAMS_SQL.format('b')} AS bp FROM n),
      h AS (SELECT id, CASE WHEN p = '' THEN false ELSE contains(a, p) OR len(list_intersect(pp, ap)) / len(pp) >= 0.5 END AS ha, CASE WHEN p = '' THEN false ELSE contains(b, p) OR len(list_intersect(pp, bp)) / len(pp) >= 0.5 END AS hb FROM x)
      SELECT id, count(*) AS points, count(*) FILTER (ha) AS hit_answer, count(*) FILTER (ha OR hb) AS hit_any FROM h GROUP BY 1"""),
}
