"""Queries of text functions, ingestion and the index table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.functions import text as fx
from evspark.operators import ingest
from evspark.sources import index
from evspark.sources.store import shared_folder
from evspark.suite.inputs import CHUNKS, LINES, MARKED, chunks, documents, marked_lines, table

TOKENS_SQL = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in fx.STOP_WORDS if w.isascii()) + "))"
BIGRAMS_SQL = "CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) = 1 THEN [{0}] ELSE list_distinct(list_transform(list_zip(string_split({0}, ''), string_split({0}, '')[2:], true), lambda x: x[1] || x[2])) END"
SPLIT_SQL = "list_filter(list_transform(string_split(regexp_replace({0}, '([。！？!?；;])', '\\1' || chr(31), 'g'), chr(31)), lambda x: regexp_replace(x, '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g')), lambda x: x <> '')"


def _paged_lines(spark, sf):
    return ingest.explode_lines(documents(spark, sf)).withColumn("page", F.expr("pos div 3 + 1").cast("int"))


def _gate(spark, sf):
    return ingest.metadata_gate(chunks(spark, sf))


def _guard(spark, sf):
    new = documents(spark, sf).filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("d"), F.col("doc_id")).alias("doc_title"), F.concat(F.lit("V"), F.col("doc_id") % 4).alias("version"), F.concat(F.lit("f."), F.when(F.col("doc_id") % 5 == 0, "exe").otherwise("MD")).alias("file_name"))
    old = documents(spark, sf).filter("doc_id % 2 = 0").select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_title"), F.concat(F.lit("V"), F.col("doc_id") % 4).alias("version"))
    return ingest.document_version_guard(new, old).select("doc_id", "reject")


def _upsert(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    return ingest.upsert_chunks(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0").withColumn("text", F.reverse("text")), "doc_id").select("doc_id", F.md5("text").alias("md5"))


def _front(spark, sf):
    d = documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ndoc_title: T"), F.col("doc_id"), F.lit('\nversion: "V2"\n---\n'), F.col("text"))).otherwise(F.col("text")).alias("text"))
    return ingest.split_front_matter(d).select("doc_id", "doc_title", "version", F.array_join("missing", ",").alias("missing"), F.md5("body").alias("body_md5"))


def _blocks(spark, sf):
    return ingest.assemble_blocks(ingest.forward_fill_structure(marked_lines(spark, sf)))


def _chunk_udtf(spark, sf):
    """Chunks of blocks in SQL."""
    ingest.register_chunking(spark)
    return spark.sql("""SELECT doc_id, page, section, heading, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, part_no) - 1 AS index, c.text
      FROM (SELECT *, paragraphs(text) AS cut FROM {blocks}) b, LATERAL chunk_block(b.cut, 300, 50) c""", blocks=_blocks(spark, sf))


def _written_index(spark, sf):
    """Two thirds of the chunks written, then a third of all put in their place or beside them."""
    path, c = shared_folder(spark, "index"), chunks(spark, sf).select("chunk_id", "doc_id", "text")
    index.write_index(c.filter("doc_id % 3 < 2"), path, "hash", "512", 512)
    index.write_index(c.filter("doc_id % 3 > 0").withColumn("text", F.reverse("text")), path, "hash", "512", 512, "upsert")
    return index.read_index(spark, path).select("chunk_id", "doc_id", F.md5("text").alias("md5"))


def _rebuilt(spark, sf):
    """A rebuild in which documents of two sources fail, and a second beside it that brings some of them right."""
    path, d = shared_folder(spark, "rebuild"), documents(spark, sf)
    docs = d.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 5 != 0, "V1").alias("version"))
    cut = lambda x: ingest.chunk_fixed(x, 800, 120).select(F.concat_ws("-", "doc_id", "index").alias("chunk_id"), "doc_id", "text")
    index.rebuild_index(docs, cut, path, "hash", "512", 512, "overwrite", ("version",))
    index.rebuild_index(d.filter("doc_id % 14 = 0").select("doc_id", "text", F.lit("V2").alias("version")), cut, path, "hash", "512", 512, "append", ("version",))
    taken = index.index_documents(spark, path).withColumn("reason", F.lit("ok"))
    return taken.unionByName(index.read_failures(spark, path).withColumn("n_chunks", F.lit(0)))


QUERIES = {
    "s2_front_matter": (_front, """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id END AS doc_title, CASE WHEN doc_id % 2 = 0 THEN 'V2' END AS version,
      CASE WHEN doc_id % 2 = 0 THEN 'category' ELSE 'version,category' END AS missing, md5(text) AS body_md5 FROM documents"""),
    "s5_manifest": (lambda s, sf: ingest.manifest(documents(s, sf), "hash", "512", 512, "source").withColumn("documents", F.array_join("documents", ",")), """
      SELECT 'hash' AS provider, '512' AS model, 'hash:512' AS signature, 512 AS dim, count(*) AS n_chunks, array_to_string(list_sort(list(DISTINCT source)), ',') AS documents FROM documents"""),
    "s5_written_index": (_written_index, f"""WITH {CHUNKS} SELECT chunk_id, doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE reverse(text) END) AS md5 FROM chunks"""),
    "s7_upsert_chunks": (_upsert, """SELECT doc_id, md5(text) AS md5 FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0
      UNION ALL SELECT doc_id, md5(reverse(text)) FROM documents WHERE doc_id % 3 = 0"""),
    "s8_delete_documents": (lambda s, sf: ingest.delete_documents(documents(s, sf).select("doc_id", "lang"), table(s, sf, "labels").filter("toxic = 1")), "SELECT doc_id, lang FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)"),
    "s9_rebuild_report": (lambda s, sf: ingest.rebuild_report(documents(s, sf), ingest.chunk_fixed(documents(s, sf), 800, 120)), f"""WITH {CHUNKS}
      SELECT d.doc_id, count(chunk_id) AS n_chunks, CASE WHEN count(chunk_id) > 0 THEN 'ok' ELSE 'failed' END AS status FROM documents d LEFT JOIN chunks USING (doc_id) GROUP BY 1"""),
    "s9_rebuild_index": (_rebuilt, f"""WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1), r AS (SELECT d.doc_id, coalesce(n, 0) AS n,
        CASE WHEN doc_id % 14 = 0 THEN CASE WHEN n IS NULL THEN 'no text' ELSE 'ok' END WHEN doc_id % 7 = 0 OR n IS NULL THEN 'no text' WHEN doc_id % 5 = 0 THEN 'missing version' ELSE 'ok' END AS reason FROM documents d LEFT JOIN n USING (doc_id))
      SELECT doc_id, CASE WHEN reason = 'ok' THEN n ELSE 0 END AS n_chunks, reason FROM r"""),
    "d1_explode_lines": (lambda s, sf: ingest.explode_lines(documents(s, sf)), f"WITH {LINES} SELECT doc_id, pos, line FROM lines"),
    "d2_forward_fill_structure": (lambda s, sf: ingest.forward_fill_structure(marked_lines(s, sf)), f"WITH {MARKED} SELECT * FROM placed"),
    "d3_infer_plain_headings": (lambda s, sf: ingest.infer_plain_headings(ingest.explode_lines(documents(s, sf)).select("doc_id", "pos", F.expr("cast(pos div 20 + 1 AS int)").alias("page"), F.when(F.col("pos") % 7 == 0, F.concat_ws(" ", F.expr("concat(pos div 7 + 1, '.2')"), F.substring_index("line", " ", 2))).otherwise(F.col("line")).alias("line"))), rf"""
      WITH {LINES}, l AS (SELECT doc_id, pos, (pos // 20 + 1)::INT AS page, CASE WHEN pos % 7 = 0 THEN (pos // 7 + 1) || '.2 ' || array_to_string(string_split(line, ' ')[1:2], ' ') ELSE line END AS line FROM lines),
      h AS (SELECT *, trim(line) AS t, length(trim(line)) <= 60 AND regexp_matches(trim(line), '^(?:第[ \t]*([0-9]+)[ \t]*章|([0-9]+(?:\.[0-9]+){{0,3}})[ \t]+\S.{{0,40}})$') AS is_heading FROM l),
      f AS (SELECT *, coalesce(last_value(CASE WHEN is_heading THEN regexp_extract(t, '^([0-9.]+)', 1) END IGNORE NULLS) OVER w, '') AS section,
        coalesce(last_value(CASE WHEN is_heading THEN t END IGNORE NULLS) OVER w, '') AS heading FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT doc_id, pos, page, line, section, heading FROM f WHERE NOT is_heading"""),
    "d4_strip_repeated_lines": (lambda s, sf: ingest.strip_repeated_lines(_paged_lines(s, sf)), f"""WITH {LINES}, p AS (SELECT *, (pos // 3 + 1)::INT AS page, trim(line) AS key FROM lines),
      n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY 1), o AS (SELECT doc_id, key, count(DISTINCT page) AS c FROM p WHERE key <> '' AND length(key) <= 60 GROUP BY 1, 2),
      r AS (SELECT doc_id, key FROM o JOIN n USING (doc_id) WHERE pages >= 2 AND c / pages >= 0.5) SELECT doc_id, pos, line, page FROM p ANTI JOIN r USING (doc_id, key)"""),
    "d5_assemble_blocks": (lambda s, sf: ingest.assemble_blocks(ingest.forward_fill_structure(marked_lines(s, sf))), f"""WITH {MARKED},
      g AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> page || '|' || section THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, lag(page || '|' || section) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM placed)),
      b AS (SELECT doc_id, island, arg_min(page, pos) AS page, arg_min(section, pos) AS section, arg_min(heading, pos) AS heading, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^[\\s]+|[\\s]+$', '', 'g') AS text FROM g GROUP BY 1, 2)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS block_no, page, section, heading, text FROM b WHERE text <> ''"""),
    "d6_clean_text": (lambda s, sf: documents(s, sf).select("doc_id", F.md5(fx.clean_text(F.concat(F.lit("a-\nb\r\n 12 \n\n\n\nx"), F.col("text"), F.lit("  \n")))).alias("clean_md5")), r"""
      WITH l AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split('ab' || chr(10) || ' 12 ' || chr(10) || chr(10) || chr(10) || chr(10) || 'x' || text || '  ' || chr(10), chr(10)), lambda x: regexp_replace(x, '[ \t\x{3000}]+$', '')),
        lambda x: NOT regexp_matches(x, '^[ \t\-—–]*[0-9]{1,4}[ \t\-—–]*$')), lambda x: regexp_replace(x, '[ \t\x{3000}]{2,}', ' ', 'g')) AS l FROM documents)
      SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x{3000}]+|[ \t\n\x{3000}]+$', '', 'g')) AS clean_md5 FROM l"""),
    "d7_extract_images": (lambda s, sf: ingest.extract_images(ingest.forward_fill_structure(marked_lines(s, sf)).withColumn("line", F.when(F.col("pos") % 4 == 1, F.concat(F.lit("![fig "), F.col("pos"), F.lit("](img/"), F.col("doc_id"), F.lit(".png) "), F.col("line"))).otherwise(F.col("line")))), f"""
      WITH {MARKED} SELECT doc_id, pos, page, section, 'fig ' || pos AS alt, 'img/' || doc_id || '.png' AS src FROM placed WHERE pos % 4 = 1"""),
    "d9_chunk_blocks": (lambda s, sf: ingest.chunk_blocks(ingest.assemble_blocks(ingest.forward_fill_structure(marked_lines(s, sf))), 300, 50), None),
    "u5_chunk_udtf": (_chunk_udtf, None),
    "d10_chunk_fixed": (lambda s, sf: ingest.chunk_fixed(documents(s, sf), 800, 120), f"WITH {CHUNKS} SELECT doc_id, index, text FROM chunks"),
    "d11_stable_ids": (lambda s, sf: chunks(s, sf).select(fx.doc_id("doc_title", "version", "device_model").alias("doc"), fx.chunk_id("chunk_id", "page", "section", "index", "text").alias("chunk")), f"""WITH {CHUNKS}
      SELECT 'doc_' || substr(sha1(concat_ws('|', doc_title, coalesce(version, ''), device_model)), 1, 12) AS doc, 'c_' || substr(sha1(concat_ws('|', chunk_id, page, section, index, substr(text, 1, 80))), 1, 12) AS chunk FROM chunks""".replace("sha1(", "sha1(")),
    "d12_estimate_tokens": (lambda s, sf: documents(s, sf).select("doc_id", fx.estimate_tokens("text").alias("tokens")), "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE (len(regexp_extract_all(text, '[A-Za-z0-9_]+')) * 13 + len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]')) * 10) // 10 + 1 END AS tokens FROM documents"),
    "d13_search_text": (lambda s, sf: chunks(s, sf).select("chunk_id", F.md5(fx.search_text("section", "heading", "text")).alias("md5")), f"WITH {CHUNKS} SELECT chunk_id, md5(section || ' ' || text) AS md5 FROM chunks"),
    "d14_metadata_gate": (lambda s, sf: _gate(s, sf).withColumn("offenders", F.array_join("offenders", ",")), f"""WITH {CHUNKS}
      SELECT doc_id, count(*) AS chunks, count(*) FILTER (version IS NOT NULL) AS complete, round(count(*) FILTER (version IS NOT NULL) / count(*), 6) AS ratio, count(*) FILTER (version IS NULL) = 0 AS accepted,
        array_to_string(coalesce(list_sort(list(index) FILTER (version IS NULL))[1:5], []), ',') AS offenders FROM chunks GROUP BY 1"""),
    "d15_split_sentences": (lambda s, sf: documents(s, sf).select("doc_id", F.posexplode(fx.split_sentences(F.regexp_replace("text", r"\.", "。"))).alias("no", "sentence")), rf"""
      WITH s AS (SELECT doc_id, {SPLIT_SQL.format("replace(text, '.', '。')")} AS s FROM documents) SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS no FROM s"""),
    "d16_version_guard": (_guard, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unsupported suffix' WHEN doc_id % 2 = 0 THEN 'version exists' END AS reject FROM documents WHERE doc_id % 3 = 0"),
    "d17_browse_chunks": (lambda s, sf: ingest.browse_chunks(chunks(s, sf), F.lower("text").contains("the") & (F.col("page") == 1), 40, 10)[0].select("chunk_id", "page", "section"), f"""WITH {CHUNKS}
      SELECT chunk_id, page, section FROM chunks WHERE contains(lower(text), 'the') AND page = 1 ORDER BY doc_id, page, index LIMIT 40 OFFSET 10"""),
    "d18_neighbors": (lambda s, sf: ingest.neighbors(chunks(s, sf), chunks(s, sf).filter("doc_id % 7 = 0 AND index % 2 = 0"), 2), f"""WITH {CHUNKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, index) AS p FROM chunks)
      SELECT a.chunk_id, b.chunk_id AS neighbor_id, b.p - a.p AS distance FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p - 2 AND a.p + 2 AND a.p <> b.p WHERE a.doc_id % 7 = 0 AND a.index % 2 = 0"""),
    "d19_index_stats": (lambda s, sf: ingest.index_stats(chunks(s, sf)), f"""WITH {CHUNKS}, t AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) * 13 // 10 + 1 AS k FROM chunks)
      SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, round(avg(length(text)), 1) AS avg_chars, round(avg(k), 1) AS avg_tokens, max(k) AS max_tokens FROM t"""),
    "t1_tokenize": (lambda s, sf: documents(s, sf).select("doc_id", F.explode(fx.tokenize("text")).alias("token")).groupBy("doc_id", "token").count().withColumnRenamed("count", "n"), f"""
      SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS token FROM documents) GROUP BY ALL"""),
    "t2_char_bigrams": (lambda s, sf: documents(s, sf).select("doc_id", F.array_join(F.sort_array(fx.char_bigrams("text")), "|").alias("bigrams")), rf"""
      WITH n AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM documents) SELECT doc_id, array_to_string(list_sort({BIGRAMS_SQL.format('t')}), '|') AS bigrams FROM n"""),
    "t5_l2_normalize": (lambda s, sf: table(s, sf, "embeddings").select("vec_id", F.transform(fx.l2_normalize("embedding"), lambda x: fx.rounded(x, 6)).alias("v")), """
      SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6)) AS v FROM embeddings"""),
    "l1_normalize_question": (lambda s, sf: table(s, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", fx.normalize_question("text").alias("key")), r"""
      SELECT conv_id, turn, substr(regexp_replace(lower(text), '[\s，。？！、；：,.?!;:"''（）()\[\]【】《》<>「」『』~～\-—_]+', '', 'g'), 1, 120) AS key FROM conversations WHERE role = 'user'"""),
    "l8_mask_secrets": (lambda s, sf: documents(s, sf).select("doc_id", F.md5(fx.mask_secrets("text", [(r'(?i)(token\s*=\s*")[A-Za-z0-9]{6,}', "$1***")])).alias("md5")), r"""
      SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_\-]{6,}', 'sk-***', 'g'), '(?i)(bearer\s+)[A-Za-z0-9._\-]{8,}', '\1***', 'g'), '(?i)(api[_-]?key"?\s*[:=]\s*"?)[A-Za-z0-9._\-]{6,}', '\1***', 'g'), '(?i)(token\s*=\s*")[A-Za-z0-9]{6,}', '\1***', 'g')) AS md5 FROM documents"""),
    "l9_titles": (lambda s, sf: table(s, sf, "conversations").select("conv_id", "turn", fx.title("text").alias("title"), fx.truncate("text", 50).alias("short")), r"""
      WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g') AS t FROM conversations)
      SELECT conv_id, turn, CASE WHEN t = '' THEN '新会话' WHEN length(t) <= 30 THEN t ELSE regexp_replace(substr(t, 1, 30), '\s+$', '') END AS title, CASE WHEN length(t) <= 50 THEN t ELSE regexp_replace(substr(t, 1, 50), '\s+$', '') || '…' END AS short FROM t"""),
    "l11_paged": (lambda s, sf: ingest.paged(table(s, sf, "orders"), (F.desc("o_totalprice"), "o_orderkey"), 500, 20).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 20"),
    "l12_iso_times": (lambda s, sf: table(s, sf, "events").select("event_id", fx.to_iso(F.col("ts").cast("timestamp")).alias("iso"), (fx.from_iso(fx.to_iso(F.col("ts").cast("timestamp"))) == F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("same")), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, true AS same FROM events"),
}
