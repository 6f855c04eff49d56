"""Line dedup by a tree of line templates, of fixed depth.

A line goes down by its number of tokens and its leading tokens; a token with a digit is a variable field. In a leaf with several
different lines, each token of a line has as many votes as lines have it in its place, and the median of a line's votes tells how large
its family is: tokens with half as many votes or more are constant, the others are variable fields. Lines of a leaf with the same
constants have one template, so that a leaf holds any number of families, large and small; a line of which less than four fifths is
constant is a template of its own. A template that more than one document has recurs: its lines are dropped from every document but
the first that has it. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import WORD, lookup, written

#: Leading tokens that a line goes down by; tenths of a line's places that must be constant for it to share a template.
DEPTH, AGREE = 3, 8
FIELD = "<*>"
#: Keys that are broadcast at most (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: A token with a digit. The guard and the possessive repeats keep it linear on long tokens.
_TOKEN = r"[^\x20\x09-\x0D]"
_FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, FIELD)).otherwise(line)


def leaf(line: Column) -> Column:
    """The leaf of a masked line: its number of tokens and its leading tokens. Where single spaces alone part them, no expression is matched."""
    odd = reduce(Column.__or__, [line.contains(x) for x in ("  ", "\t", "\x0b", "\x0c", "\r")], line.startswith(" ") | line.endswith(" "))
    leading = F.regexp_extract(line, rf"^[\x20\x09-\x0D]*({WORD}(?:[\x20\x09-\x0D]+{WORD}){{0,{DEPTH - 1}}})", 1)
    n = F.when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    first = F.when(odd, F.regexp_replace(leading, r"[\x20\x09-\x0D]+", " ")).otherwise(F.substring_index(line, " ", DEPTH))
    return _key(F.concat_ws(" ", n.cast("string"), first))


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def _key(text: Column) -> Column:
    """Never null, so that a join by it needs no test for null, which would be pushed down and make the expression anew."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(bytearray()))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def _with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row (a hash of the text, as rows may repeat an id), place, line (masked) for each line with a token."""
    text = F.coalesce(text_col, F.lit(""))
    lines = docs.select(_doc(id_col).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return lines.filter(F.col("line").rlike(_TOKEN)).withColumn("line", masked(F.col("line")))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, row, place, key (of the masked line), leaf: the one pass over all lines."""
    lines = _with_text(docs, id_col, text_col)
    return written(lines.select("doc", "row", "place", _key(F.col("line")).alias("key"), leaf(F.col("line")).alias("leaf")), "line-keys")


def families(distinct: DataFrame) -> DataFrame:
    """key, template: of the lines that share a template with others of their leaf. `distinct`: leaf, key, tokens, times."""
    placed = distinct.select("leaf", "key", "times", F.posexplode("tokens").alias("place", "token")).filter((F.col("place") >= DEPTH) & (F.col("token") != FIELD))
    named = F.xxhash64("leaf", "place", "token").alias("name")
    placed = written(placed.select(named, "key", "place", "times"), "placed-tokens")
    votes = placed.groupBy("name").agg(F.sum("times").alias("votes"), F.count(F.lit(1)).alias("lines")).filter("votes > 1")
    voted = lookup(placed.select("name", "key", "place"), written(votes, "votes"), "name", "lines", placed.count())
    by_line = voted.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("votes", "place", "name"))).alias("votes"))  # as many as the line has tokens
    lead = F.size(F.filter(F.slice("tokens", 1, DEPTH), lambda x: x != FIELD))
    line = by_line.join(distinct.select("key", "leaf", F.size("tokens").alias("n"), lead.alias("lead")), "key")
    # places without a vote beside the line's own have one
    at = F.expr(f"(n - {DEPTH}) div 2 - (n - {DEPTH} - size(votes))").cast("int")
    median = F.when(at >= 0, F.col("votes")[at]["votes"]).otherwise(1)
    line = line.withColumn("median", median).filter("median > 2")
    line = line.withColumn("constants", F.filter("votes", lambda x: 2 * x["votes"] >= F.col("median"))).filter(10 * (F.col("lead") + F.size("constants")) >= AGREE * F.col("n"))
    order = F.transform(F.sort_array(F.transform("constants", lambda x: F.struct(x["place"], x["name"]))), lambda x: x["name"].cast("string"))
    return line.select("key", _key(F.concat_ws(" ", F.hex("leaf"), F.array_join(order, " "))).alias("template"))


def recurring_lines(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (of a masked line), first_doc (the least document with its template), times: for lines whose template recurs. `lines`: those of line_keys."""
    by_key = lines.groupBy("leaf", "key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("times"))
    by_key = written(by_key, "lines")
    crowded = by_key.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1")
    crowded = written(crowded, "crowded-leaves")
    # only the lines of crowded leaves are read again with their text
    text = _with_text(docs, id_col, text_col).withColumn("leaf", leaf(F.col("line"))).join(_few(crowded.select("leaf")), "leaf", "left_semi")
    distinct = text.select("leaf", "line").groupBy("leaf", _key(F.col("line")).alias("key")).agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("times"))
    distinct = written(distinct.select("leaf", "key", tokens(F.col("line")).alias("tokens"), "times"), "crowded-lines")
    near = families(distinct)
    with_template = by_key.join(_few(written(near, "families")), "key", "left").withColumn("template", F.coalesce("template", "key"))
    with_template = written(with_template.select("key", "template", "first", "last", "times"), "templates")
    found = with_template.groupBy("template").agg(F.min("first").alias("first_doc"), F.max("last").alias("last_doc"), F.count(F.lit(1)).alias("keys")).filter("first_doc < last_doc")
    return lookup(with_template, found, "template", "keys", with_template.count()).select("key", "first_doc", "times")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True, keep_first: bool = True) -> DataFrame:
    """`docs` with the recurring lines dropped from its text and, if asked for, the columns n_lines (with a token) and n_dropped, in place of columns of that name.

    The least document that has a template keeps its lines, so that of copies one stays whole, unless `keep_first` is false. Lines are
    cut at line feeds; those without a token stay. A null text stays null, with no lines. Rows that repeat an id are one document; rows
    without an id are one that comes before all others. An id must be an integer. Other columns pass through.
    """
    lines = line_keys(docs, id_col, text_col)
    gone = written(recurring_lines(docs, lines, id_col, text_col), "recurring")
    dropped = lookup(lines.select("doc", "row", "place", "key"), gone, "key", "times", lines.count()).filter(F.lit(not keep_first) | (F.col("doc") > F.col("first_doc")))
    by_row = dropped.groupBy("doc", "row").agg(F.collect_set("place").alias("__gone"))  # as many as the text has lines
    by_row = written(by_row.withColumnsRenamed({"doc": "__doc", "row": "__row"}), "dropped")
    text = F.coalesce(text_col, F.lit(""))
    out = docs.join(by_row, (_doc(id_col) == F.col("__doc")) & (F.xxhash64(text) == F.col("__row")), "left")
    every = F.split(text, "\n")
    # the lines are one element of an array, so that they are cut once and not for each line
    left = F.transform(F.array(every), lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__gone")), lambda i: own[i]))[0]
    kept = F.when(F.col("__gone").isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text_col))
    has = F.size(F.filter(every, lambda x: x.rlike(_TOKEN))).cast("long")
    added = {"n_lines": has, "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")} if counts else {}
    return out.select(*[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_lines, n_dropped, text_sha256 (of the text that is left)."""
    return drop_recurring(docs.select(id_col, text_col), id_col, text_col).select(
        id_col, "n_lines", "n_dropped", F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM d),
l AS (SELECT doc_id, place, line, regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') AS key FROM raw),
k AS (SELECT key, regexp_extract_all(key, '[^\x20\x09-\x0D]+') AS tokens, min(doc_id) AS first, max(doc_id) AS last, count(*) AS times FROM l GROUP BY 1),
leafed AS (SELECT *, concat_ws(' ', len(tokens), array_to_string(tokens[1:3], ' ')) AS leaf FROM k WHERE len(tokens) > 0),
crowded AS (SELECT leaf FROM leafed GROUP BY 1 HAVING count(*) > 1),
placed AS (SELECT leaf, key, times, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM leafed SEMI JOIN crowded USING (leaf)),
votes AS (SELECT leaf, p, token, sum(times) AS votes FROM placed WHERE p > 3 AND token <> '<*>' GROUP BY ALL),
voted AS (SELECT placed.leaf, key, placed.p, placed.token, votes, coalesce(votes, 1) AS v FROM placed LEFT JOIN votes ON placed.leaf = votes.leaf AND placed.p = votes.p AND placed.token = votes.token),
medians AS (SELECT key, list_sort(list(v))[len(list(v)) // 2 + 1] AS median FROM voted WHERE p > 3 GROUP BY 1),
near AS (SELECT leaf, key, string_agg(p || ' ' || token, ' ' ORDER BY p) FILTER (p > 3 AND votes IS NOT NULL AND 2 * v >= median) AS constants FROM voted JOIN medians USING (key)
  WHERE median > 2 GROUP BY ALL HAVING 10 * count(*) FILTER (CASE WHEN p > 3 THEN votes IS NOT NULL AND 2 * v >= median ELSE token <> '<*>' END) >= 8 * count(*)),
t AS (SELECT leafed.key, first, last, coalesce('leaf ' || near.leaf || ' ' || constants, 'line ' || leafed.key) AS template FROM leafed LEFT JOIN near ON near.key = leafed.key),
g AS (SELECT template, min(first) AS first_doc FROM t GROUP BY 1 HAVING min(first) < max(last)),
gone AS (SELECT key, first_doc FROM t JOIN g USING (template)),
marked AS (SELECT l.doc_id, place, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_line, coalesce(l.doc_id > first_doc, false) AS dropped FROM l LEFT JOIN gone ON gone.key = l.key)
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
