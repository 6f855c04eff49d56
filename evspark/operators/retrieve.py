"""Query forms, filters, fusion and reranking of hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.config import DEFAULT, Config
from evspark.functions import text as fx
from evspark.operators import matching
from evspark.operators.lexical import top_k

#: Words that point back to an earlier turn, and the length up to which a question needs one.
FOLLOWUP_MARKERS = [
    "它", "他", "她", "该", "这个", "那个", "其", "此", "上述", "刚才", "上面",
    "前面", "这些", "那些", "还有", "同样", "那", "呢", "再讲", "接着",
]
SHORT_QUESTION = 12


def metadata_filter(df: DataFrame, where: dict[str, object]) -> Column:
    """AND of equalities, {'$eq': x} and {'$in': [...]}; a column that `df` lacks matches nothing."""

    def one(name: str, want: object) -> Column:
        if name not in df.columns:
            return F.lit(False)
        if isinstance(want, dict):
            return reduce(lambda a, b: a & b, [F.col(name).isin(list(v)) if op == "$in" else F.col(name) == v for op, v in want.items()], F.lit(True))
        return F.col(name) == F.lit(want)

    return F.coalesce(reduce(lambda a, b: a & b, [one(k, v) for k, v in where.items()], F.lit(True)), F.lit(False))


def device_filter(device: str, generic: str = "通用") -> Column:
    """Chunks of a device and generic ones."""
    return F.coalesce(F.col("device_model").isin(device, generic), F.lit(False))


def glossary_lookup(terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """term, canonical, synonyms, queries: the first entry (terms before devices, in file order) that has a name or synonym which is the term or contains it, without regard to case and spaces at the ends.

    Queries: of a term its name and two first synonyms, of a device its name, and the term itself if there is no entry (canonical null, no synonyms). `glossary`: canonical, kind, ordinal, synonyms.
    """
    first = F.struct(F.when(F.col("kind") == "term", 0).otherwise(1).alias("late"), "ordinal")
    names = glossary.select(first.alias("rank"), F.explode(F.concat(F.array("canonical"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("text")).withColumn("text", F.lower("text"))
    asked = terms.select("term").distinct().withColumn("pattern", F.lower(F.trim("term")))
    hits = matching.first_containing(names, asked)
    top = names.agg(F.min("rank").alias("first")).select(F.lit("").alias("pattern"), "first").filter("first IS NOT NULL")  # an empty term is in every name
    found = asked.join(hits.unionByName(top), "pattern", "left").select("term", F.col("first.late").alias("late"), F.col("first.ordinal").alias("ordinal"))
    entries = glossary.select(F.when(F.col("kind") == "term", 0).otherwise(1).alias("late"), "ordinal", "canonical", "synonyms")
    own = found.join(entries, ["late", "ordinal"], "left")
    none = F.array().cast("array<string>")
    queries = F.when(F.col("canonical").isNull(), F.array("term")).when(F.col("late") == 1, F.array("canonical")).otherwise(F.concat(F.array("canonical"), F.slice(F.coalesce("synonyms", none), 1, 2)))
    return own.select("term", "canonical", F.coalesce("synonyms", none).alias("synonyms"), queries.alias("queries"))


def expand_queries(queries: DataFrame, glossary: DataFrame, text: str = "text") -> DataFrame:
    """query_id, forms (three at most, each once): the question; the question with synonyms made canonical; the question with the canonical names of these added.

    Entries take their turn in file order, and of each the first synonym that can be replaced. A synonym is not replaced after a letter,
    digit or hyphen, nor before these if a digit follows, as it is part of a code there. One automaton of the synonyms runs over the questions. An empty question has no form.
    """
    synonyms = glossary.filter("kind = 'term'").select("canonical", "ordinal", F.posexplode("synonyms").alias("at", "synonym")).withColumn("low", F.lower("synonym"))
    asked = queries.select("query_id", F.trim(F.coalesce(text, F.lit(""))).alias("q")).withColumn("low", F.lower("q"))
    hits = matching.find_patterns(asked, synonyms, "low", "low", ("query_id",)).withColumnRenamed("pattern", "low").join(synonyms, "low")
    by = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "at", "canonical", "synonym"))).alias("hits"))  # at most the glossary's synonyms
    rows = asked.join(by, "query_id", "left")
    start = F.struct(F.col("q").alias("text"), F.lit(-1).cast("long").alias("last"), F.array().cast("array<string>").alias("names"))
    quoted = lambda c: F.concat(F.lit(r"(?<![A-Za-z0-9\-])\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9\-]*\d)"))

    def turn(s: Column, h: Column) -> Column:
        pattern = quoted(h["synonym"])
        goes = (s["last"] != h["ordinal"]) & F.rlike(s["text"], pattern)
        text = F.when(goes, F.regexp_replace(s["text"], pattern, F.regexp_replace(h["canonical"], r"([\\$])", r"\\$1"))).otherwise(s["text"])
        return F.struct(text.alias("text"), F.when(goes, h["ordinal"].cast("long")).otherwise(s["last"]).alias("last"), F.when(goes, F.array_append(s["names"], h["canonical"])).otherwise(s["names"]).alias("names"))

    none = F.array().cast("array<struct<ordinal:int,at:int,canonical:string,synonym:string>>")
    folded = rows.select("query_id", "q", F.aggregate(F.coalesce("hits", none), start, turn).alias("s"))
    forms = F.array(F.col("q"), F.trim("s.text"), F.array_join(F.array_distinct(F.concat(F.array("q"), "s.names")), " "))
    return folded.select("query_id", F.array_distinct(F.filter(forms, lambda x: x != "")).alias("forms"))


def is_referential(text: Column, markers: list[str] = FOLLOWUP_MARKERS, short: int = SHORT_QUESTION) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers], F.length(fx.trimmed(text)) <= short)


def followup_queries(conversations: DataFrame, markers: list[str] = FOLLOWUP_MARKERS, short: int = SHORT_QUESTION, lookback: int = 5) -> DataFrame:
    """conv_id, turn, followup, antecedent, forms for each user turn. The antecedent is the latest of the `lookback` user turns before that stands alone, else the latest."""
    users = conversations.filter((F.col("role") == "user") & (fx.trimmed("text") != "")).select("conv_id", "turn", fx.trimmed("text").alias("text"))
    ref = is_referential(F.col("text"), markers, short)
    w = Window.partitionBy("conv_id").orderBy("turn")
    back = w.rowsBetween(-lookback, -1)
    prior = F.coalesce(F.last(F.when(~ref, F.col("text")), ignorenulls=True).over(back), F.last("text").over(back))
    rows = users.withColumn("followup", ref & F.lag("text").over(w).isNotNull()).withColumn("antecedent", prior)
    forms = F.when(F.col("followup"), F.array(F.concat_ws(" ", "antecedent", "text"), F.col("antecedent"), F.col("text"))).otherwise(F.array("text"))
    return rows.select("conv_id", "turn", "followup", F.when(F.col("followup"), F.col("antecedent")).alias("antecedent"), F.array_distinct(forms).alias("forms"))


def merge_query_forms(hits: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """hits (query_id, form, chunk, score, rank) -> query_id, chunk, score (the best), rank: in the order of first appearance, form by form, cut to k."""
    merged = hits.groupBy("query_id", id_col).agg(F.max("score").alias("score"), F.min(F.struct("form", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy("first.form", "first.rank", id_col)
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("first")


def rrf_fuse(lists: list[tuple[DataFrame, float]], k: int = DEFAULT.rrf_k, id_col: str = "chunk_id") -> DataFrame:
    """query_id, chunk, score: the sum of weight / (k + rank) over ranked lists (query_id, chunk, rank)."""
    each = [df.select("query_id", id_col, (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for df, w in lists]
    return reduce(DataFrame.unionByName, each).groupBy("query_id", id_col).agg(F.round(F.sum("part"), 9).alias("score"))


def hybrid_hits(lexical: DataFrame, vector: DataFrame, cfg: Config = DEFAULT, id_col: str = "chunk_id") -> DataFrame:
    """query_id, chunk, bm25, vector, fused, rank: both lists (query_id, chunk, score, rank) fused by rank, cut to top_k. Either list may be empty."""
    fused = rrf_fuse([(lexical, cfg.bm25_weight), (vector, cfg.vector_weight)], cfg.rrf_k, id_col)
    scores = [df.select("query_id", id_col, F.round("score", 4).alias(n)) for df, n in ((lexical, "bm25"), (vector, "vector"))]
    both = scores[0].join(scores[1], ["query_id", id_col], "full_outer").join(fused.withColumnRenamed("score", "__fused"), ["query_id", id_col])
    return top_k(both, "query_id", "__fused", id_col, cfg.top_k).withColumn("fused", F.round("__fused", 6)).drop("__fused")


def lexical_score(query: Column, section: Column, heading: Column, text: Column) -> Column:
    """0.55 for the query's tokens in the chunk, 0.2 for a CJK run of four in its text, 0.15 for tokens in its heading, 0.1 for its section number."""
    q = F.array_distinct(fx.tokenize(query))
    share = lambda t: F.size(F.array_intersect(q, fx.tokenize(t))) / F.size(q)
    phrase = F.exists(F.filter(fx.found(query, f"{fx.CJK}+"), lambda x: F.length(x) >= 4), lambda x: text.contains(x))
    named = F.array_contains(fx.found(query, r"[0-9]+(?:\.[0-9]+)+"), section)
    score = 0.55 * share(fx.search_text(section, heading, text)) + 0.2 * phrase.cast("int") + 0.15 * share(F.concat_ws(" ", heading, section)) + 0.1 * F.coalesce(named, F.lit(False)).cast("int")
    return F.when(F.size(q) == 0, 0.0).otherwise(score)


def clamped(raw: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def sigmoid(raw: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), raw))))


def rerank(candidates: DataFrame, score: Column, normalise: object = clamped, n: int = DEFAULT.rerank_n, most: int = DEFAULT.rerank_candidates, id_col: str = "chunk_id") -> DataFrame:
    """The max(n, most) best by `fused` of each query are scored, and the n best of those stay: adds rerank, normalized, position, truncated (candidates not scored)."""
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    first = top_k(candidates.withColumn("__total", total).drop("rank"), "query_id", "fused", id_col, max(n, most)).drop("rank")
    scored = first.withColumn("rerank", F.round(score, 6)).withColumn("normalized", F.round(normalise(score), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), F.desc_nulls_last(F.when(F.col("rerank").isNull(), F.col("fused"))), id_col)  # rows that could not be scored stay in the order of fusion
    best = scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
    return best.withColumn("truncated", F.greatest(F.lit(0), F.col("__total") - max(n, most))).drop("__total")


def route_external(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Names of the external sources whose keywords the text has, in the order of `keywords`."""
    has = lambda words: reduce(lambda a, b: a | b, [F.lower(text).contains(w.lower()) for w in words])
    return F.array_compact(F.array(*[F.when(has(words), F.lit(name)) for name, words in keywords.items()]))


def branch(top_score: Column, rounds: Column, calls: Column, external: Column, threshold: float = DEFAULT.sufficiency, max_rounds: int = 2, max_calls: int = 3) -> Column:
    """AUGMENT if rounds and calls are left and the evidence is too weak or an external source is needed, else GENERATE."""
    left = (rounds < max_rounds) & (calls < max_calls)
    return F.when(left & ((F.coalesce(top_score, F.lit(0.0)) < threshold) | (F.size(external) > 0)), "AUGMENT").otherwise("GENERATE")


def ticket_search(queries: DataFrame, tickets: DataFrame, k: int = 3) -> DataFrame:
    """query_id, ticket_no, score, rank: the share of the query's tokens of two characters or more that a ticket has, half a point more for the same device."""
    long = lambda t: F.array_distinct(F.filter(fx.tokenize(t), lambda x: F.length(x) >= 2))
    q = queries.select("query_id", F.col("device_model").alias("device"), long("text").alias("tokens"))
    q = q.withColumn("n", F.size("tokens")).withColumn("token", F.explode("tokens")).drop("tokens")
    body = F.concat_ws(" ", "symptom", "root_cause", "action", "conclusion")
    t = tickets.select("ticket_no", "device_model", F.explode(long(body)).alias("token"))
    hits = q.join(t, "token").groupBy("query_id", "ticket_no").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"), F.max((F.col("device") == F.col("device_model")).cast("int")).alias("same"))
    scored = hits.withColumn("score", F.round(F.col("hits") / F.col("n") + 0.5 * F.coalesce("same", F.lit(0)), 4))
    return top_k(scored, "query_id", "score", "ticket_no", k).select("query_id", "ticket_no", "score", "rank")
