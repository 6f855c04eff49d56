"""A batch of questions to checked answers, as one plan.

Each step makes rows of questions and evidence. What fails for a question is a row's error and not a failed job: a scorer or a
generator that gives nothing for some rows is taken over by the order of fusion and by the extractive answer, and says so in
`errors`. What later steps read more than once is written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.config import DEFAULT, Config
from evspark.functions import plugins
from evspark.functions import text as fx
from evspark.operators import citations, context, images, ingest, lexical, parts, retrieve
from evspark.sources.store import shared_folder

#: Source calls that a question may have in a round beside the first search, and rounds; forms of a question that the relaxed search takes.
MAX_CALLS, MAX_ROUNDS = 3, 2
#: Normalised score of evidence that was looked up and not searched.
STRUCTURED = 0.9
TICKETS_A_QUESTION = 2
STRINGS = "array<string>"


@dataclass(frozen=True)
class Sources:
    """Tables beside the chunks. `glossary`: canonical, kind, ordinal, synonyms. `tickets`: ticket_no, device_model, symptom, root_cause, action, conclusion. `parts`: code, part, ordinal, stock, and what `format_parts` knows. `keywords`: by source ('parts', 'tickets') the words of questions that need it."""

    glossary: DataFrame | None = None
    tickets: DataFrame | None = None
    parts: DataFrame | None = None
    keywords: dict[str, list[str]] | None = None


@dataclass(frozen=True)
class Notices:
    """What goes before an answer that speaks of an operation, and before one to images that were not recognised."""

    operation_words: list[str]
    safety: str
    image: str


@dataclass(frozen=True)
class Models:
    """Plug-ins by name: scorers in the order in which they are tried, and a generator with its prompt ({question}, {context})."""

    scorers: tuple[str, ...] = ()
    generator: str | None = None
    prompt: str = "{context}\n\n{question}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, read again."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_forms(queries: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """`queries` (query_id, text, and what is there of forms, followup, device_model, images, recognised) with all of these: forms from the glossary unless given, else the text alone."""
    none = {"followup": F.lit(False), "device_model": F.lit(None).cast("string"), "images": F.lit(0), "recognised": F.lit(None).cast("boolean")}
    out = queries.withColumns({k: v for k, v in none.items() if k not in queries.columns})
    if "forms" in queries.columns:
        return out
    if glossary is None:
        return out.withColumn("forms", F.array(F.coalesce("text", F.lit(""))))
    return out.join(retrieve.expand_queries(queries, glossary).withColumnRenamed("query_id", "__of"), F.col("query_id") == F.col("__of"), "left").drop("__of").withColumn("forms", F.coalesce("forms", F.array().cast(STRINGS)))


def conversation_questions(conversations: DataFrame) -> DataFrame:
    """Each user turn as a question: query_id (`conversation-turn`), text, forms, followup; a follow-up is asked together with what it points back to."""
    asked = retrieve.followup_queries(conversations)
    text = conversations.select("conv_id", "turn", fx.trimmed("text").alias("text"))
    return asked.join(text, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text", "forms", "followup")


class Searcher:
    """Search by words over chunks: the words asked for are counted in the corpus once."""

    def __init__(self, asked: DataFrame, chunks: DataFrame, cfg: Config):
        self.chunks, self.cfg = chunks, cfg
        terms = asked.select(F.explode("forms").alias("form")).union(asked.select("text")).select(F.explode(fx.tokenize("form")).alias("term")).distinct()
        self.corpus = lexical.corpus_counts(chunks, terms)

    def vocabulary(self) -> DataFrame:
        """Words of the questions that the corpus has."""
        return self.chunks.sparkSession.createDataFrame([(w,) for w in self.corpus.df], "term string")

    def search(self, asked: DataFrame, k: int, forms: Column | None = None, filtered: bool = True) -> DataFrame:
        """query_id, chunk_id, score, rank: the forms' hits merged in their order. `filtered`: chunks of the question's device, if it names one, or of none."""
        each = asked.select("query_id", "device_model", F.posexplode(F.col("forms") if forms is None else forms).alias("form", "text"))
        keyed = each.select(F.struct("query_id", "form", "device_model").alias("key"), "text")
        own = F.col("key.device_model") if filtered and "device_model" in self.chunks.columns else None
        found = lexical.bm25_best(lexical.query_terms(keyed, "key"), self.chunks, self.corpus, k, self.cfg, query_col="key", own=own, of=None if own is None else "device_model")
        hits = written(found.select("key.query_id", "key.form", "chunk_id", "score", "rank"), "hits")
        return retrieve.merge_query_forms(hits, k)


def scored(rows: DataFrame, models: Models) -> tuple[DataFrame, Column, object]:
    """Rows (query, section, heading, text) with `scoring`, the score's Column, and how it is normalised."""
    if not models.scorers:
        return rows.withColumn("scoring", F.lit(None).cast("struct<score:double,provider:string,error:string>")), retrieve.lexical_score(F.col("query"), F.col("section"), F.col("heading"), F.col("text")), retrieve.clamped
    return rows.withColumn("scoring", plugins.score_chain(list(models.scorers))(F.col("query"), F.col("text"))), F.col("scoring.score"), retrieve.sigmoid


def reranked(candidates: DataFrame, asked: DataFrame, cfg: Config, models: Models) -> DataFrame:
    """The best `rerank_n` of the candidates (query_id, chunk_id, fused, the chunk's columns, fixed) of each question: adds rerank, normalized, position, provider, error. `fixed` is the normalised score of evidence that no model scores."""
    rows = candidates.join(asked.select("query_id", F.col("text").alias("query")), "query_id")
    first = lexical.top_k(rows, "query_id", "fused", "chunk_id", max(cfg.rerank_n, cfg.rerank_candidates)).drop("rank")
    rows, score, normalise = scored(first, models)
    out = retrieve.rerank(rows, F.coalesce("fixed", score), lambda x: F.coalesce(F.col("fixed"), F.when(score.isNotNull(), normalise(score)), F.lit(0.0)), cfg.rerank_n, cfg.rerank_candidates)
    return out.withColumns({"provider": F.coalesce("scoring.provider", F.lit("lexical")), "error": F.when(F.col("fixed").isNull(), F.col("scoring.error"))}).drop("scoring")


CHUNK = ["doc_title", "version", "page", "section", "heading", "category", "text"]


def evidence(queries: DataFrame, chunks: DataFrame, vector_hits: DataFrame | None = None, cfg: Config = DEFAULT, models: Models = Models(), searcher: Searcher | None = None) -> DataFrame:  # noqa: B008 - frozen
    """query_id, position and the chunk's columns, with bm25, vector, fused, rerank and normalized: hybrid retrieval, reranked. Without `vector_hits` (query_id, chunk_id, score, rank) words alone decide."""
    asked = with_forms(queries)
    words = (searcher or Searcher(asked, chunks, cfg)).search(asked, cfg.top_k)
    fused = retrieve.hybrid_hits(words, words.limit(0) if vector_hits is None else vector_hits, cfg).drop("rank")
    rows = fused.join(chunks, "chunk_id").withColumns({"fixed": F.lit(None).cast("double"), "source_type": F.lit("document")})
    return reranked(rows, asked, cfg, models)


def plan_calls(asked: DataFrame, top: DataFrame, sources: Sources, cfg: Config = DEFAULT, rounds: int = 0, calls: int = 0) -> DataFrame:
    """For the questions (query_id, text, forms) whose evidence has to be added to: external (the sources asked, in order), n_forms (forms searched again), neighbors (whether a call is left for them), calls.

    A round has MAX_CALLS calls less those made: first one for each external source, then one for each form, but at most one fewer
    than the round began with, then one for neighbours. `top`: query_id, top.
    """
    need = retrieve.route_external(F.col("text"), sources.keywords) if sources.keywords else F.array().cast(STRINGS)
    budget = MAX_CALLS - calls
    rows = asked.join(top, "query_id", "left").withColumn("external", need)
    step = retrieve.branch(F.col("top"), F.lit(rounds), F.lit(calls), F.col("external"), cfg.sufficiency, MAX_ROUNDS, MAX_CALLS)
    rows = rows.filter(step == "AUGMENT").withColumn("external", F.slice("external", 1, max(1, budget)))
    rows = rows.withColumn("n_forms", F.least(F.size("forms"), F.lit(max(1, budget - 1)), F.lit(budget) - F.size("external")))
    used = F.size("external") + F.col("n_forms")
    return rows.withColumn("neighbors", used < budget).withColumn("calls", F.lit(calls) + used)


def _blank(df: DataFrame, like: DataFrame, new: int, at: Column) -> DataFrame:
    """`df` in the columns of `like`, those that it lacks null, and where it stands among the evidence: `__new`, then `__at` from the top."""
    return df.select(F.lit(new).alias("__new"), at.cast("double").alias("__at"), *[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def augment(ranked: DataFrame, plan: DataFrame, chunks: DataFrame, searcher: Searcher, sources: Sources = Sources(), cfg: Config = DEFAULT, models: Models = Models()) -> tuple[DataFrame, DataFrame]:  # noqa: B008 - frozen
    """Evidence anew for the questions of `plan` (`plan_calls`), and per question its calls and whether anything was found.

    New evidence comes from parts and tickets, from a search without filters and twice as wide, and from the neighbours of the best
    new chunk; it stands before the old, each chunk once, and all of it is ranked together.
    """
    like = ranked.drop("query", "rerank", "normalized", "position", "provider", "error", "truncated")
    has = lambda name: F.array_contains("external", name)
    found = []
    if sources.parts is not None:
        rows = images.format_parts(parts.match_parts(plan.filter(has("parts")).select(F.col("query_id").alias("request_id"), "text"), sources.parts), plan.filter(has("parts")).select(F.col("query_id").alias("request_id"), "text"), sources.parts)
        found.append((0, rows.withColumnRenamed("request_id", "query_id").withColumn("fused", F.lit(STRUCTURED))))
    if sources.tickets is not None:
        hits = retrieve.ticket_search(plan.filter(has("tickets")).select("query_id", "text", "device_model"), sources.tickets, TICKETS_A_QUESTION)
        blocks = images.format_tickets(sources.tickets).withColumn("ticket_no", F.substring_index("chunk_id", ":", -1))
        told = sources.tickets.select("ticket_no", F.concat(F.lit("历史工单 "), "ticket_no").alias("doc_title"), F.col("device_model").alias("section"))
        found.append((1, hits.join(blocks, "ticket_no").join(told, "ticket_no").withColumns({"fused": F.col("score"), "page": F.lit(1)})))
    found = [(n, df.withColumnRenamed("normalized", "fixed")) for n, df in found]
    wide = searcher.search(plan, 2 * cfg.top_k, F.slice("forms", F.lit(1), F.greatest(F.lit(0), F.col("n_forms"))), filtered=False)
    relaxed = retrieve.hybrid_hits(wide, wide.limit(0), cfg).drop("rank").join(chunks, "chunk_id").withColumns({"fixed": F.lit(None).cast("double"), "source_type": F.lit("document")})
    again = reranked(relaxed, plan, cfg, models)
    new = _blank(again, like, 2, F.col("normalized"))
    for n, df in found:
        new = new.unionByName(_blank(df, like, n, F.lit(STRUCTURED)))
    new = written(new, "augmented")
    best = lexical.top_k(new.filter("__new = 2").join(plan.filter("neighbors").select("query_id"), "query_id"), "query_id", "__at", "chunk_id", 1).select("query_id", "chunk_id")
    beside = ingest.neighbors(chunks, best, 1).join(best, "chunk_id").select("query_id", F.col("neighbor_id").alias("chunk_id")).join(chunks, "chunk_id")
    near = _blank(beside.withColumns({"fused": F.lit(1.0), "source_type": F.lit("document")}), like, 3, F.lit(0.0))
    old = _blank(ranked.join(plan.select("query_id"), "query_id", "left_semi"), like, 4, F.col("normalized"))
    every = new.unionByName(near).unionByName(old).withColumn("pos", F.struct("__new", -F.col("__at"), "chunk_id"))
    merged = context.dedupe_keep_first(every).drop("pos", "__new", "__at")
    calls = plan.select("query_id", (F.col("calls") + F.col("neighbors").cast("int")).alias("calls")).join(new.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_new")), "query_id", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return reranked(merged, plan, cfg, models), calls


def answer_batch(queries: DataFrame, chunks: DataFrame, vector_hits: DataFrame | None = None, cfg: Config = DEFAULT, sources: Sources = Sources(), models: Models = Models(), notices: Notices | None = None) -> DataFrame:  # noqa: B008 - frozen
    """query_id, text, status, confidence, label, reasons, coverage, augmented, calls, degraded, errors.

    `queries`: query_id, text, and if they are there forms, followup, device_model, images, recognised; `chunks`: chunk_id, doc_id,
    doc_title, version, page, section, heading, category, index, text, and if it is there device_model. A question without evidence is
    refused; what it was refused for is in `reasons`, what failed on the way in `errors`, and `degraded` says whether anything did.
    """
    asked = written(with_forms(queries, sources.glossary), "asked")
    searcher = Searcher(asked, chunks, cfg)
    first = written(evidence(asked, chunks, vector_hits, cfg, models, searcher), "ranked")
    plan = written(plan_calls(asked, first.groupBy("query_id").agg(F.max("normalized").alias("top")), sources, cfg), "augment")
    more, calls = augment(first, plan, chunks, searcher, sources, cfg, models)
    ranked = written(first.join(plan.select("query_id"), "query_id", "left_anti").unionByName(more.select(*first.columns)), "ranked")
    blocks = written(context.build_context(ranked.withColumnRenamed("position", "pos"), cfg.context_budget), "blocks")
    drafted = citations.extractive_answer(blocks, asked)
    if models.generator is not None:
        ask = asked.join(context.context_text(blocks), "query_id")
        made = written(ask.select("query_id", plugins.generate(models.generator)(F.col("text"), plugins.render_prompt(models.prompt, question=F.col("text"), context=F.col("context"))).alias("g")).select("query_id", "g.*"), "generated")
        drafted = drafted.join(made, "query_id", "left").select("query_id", F.coalesce(F.nullif(fx.trimmed("answer"), F.lit("")), F.col("text")).alias("text"), F.when(fx.trimmed(F.coalesce("answer", F.lit(""))) == "", F.concat(F.lit("generation failed: "), F.coalesce("error", F.lit("no answer")))).alias("failed"))
    else:
        drafted = drafted.withColumn("failed", F.lit(None).cast("string"))
    drafted = written(drafted.withColumn("text", citations.strip_refusal_header("text")), "drafted")
    numbered = blocks.select(F.col("query_id").alias("answer_id"), F.col("n").cast("long").alias("n"), "text")
    enforced = written(citations.enforce_citations(drafted.withColumnRenamed("query_id", "answer_id"), numbered, cfg.attribution).select("answer_id", "text"), "enforced")
    checked = citations.check_citations(enforced, numbered)
    anchors = citations.anchor_check(asked, blocks.select("query_id", "n", F.concat_ws(" ", "doc_title", "section", "text").alias("text")), searcher.vocabulary(), cfg)
    of_ranked = ranked.groupBy("query_id").agg(F.max("normalized").alias("top"), F.max("error").alias("scoring"))
    rows = asked.select("query_id", "followup", "images", "recognised")
    for part in (
        enforced.join(checked, "answer_id").withColumnRenamed("answer_id", "query_id"), drafted.select("query_id", "failed"), of_ranked, anchors.select("query_id", "missing_models", F.col("ok").alias("anchors_ok")),
        citations.authority(blocks), blocks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks")), calls,
    ):
        rows = rows.join(part, "query_id", "left")
    none = F.array().cast("array<bigint>")
    errors = F.array_compact(F.array(
        F.when(F.col("scoring").isNotNull(), F.concat(F.lit("scoring failed: "), F.col("scoring"))), F.col("failed"), F.when(F.col("n_new") == 0, "the second search found nothing new"),
    ))
    judged = citations.refusal(rows.select(
        "query_id", "images", "recognised", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("used", none).alias("used"), F.coalesce("fake", none).alias("fake"), F.coalesce("total_claims", F.lit(0)).alias("total_claims"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("top", F.lit(0.0)).alias("top"), citations.confidence(F.col("top"), F.col("coverage"), F.col("authority")).alias("confidence"), F.coalesce("anchors_ok", F.lit(False)).alias("anchors_ok"), "followup",
        F.coalesce("missing_models", F.array().cast(STRINGS)).alias("missing_models"), F.col("calls").isNotNull().alias("augmented"), F.coalesce("calls", F.lit(0)).alias("calls"), errors.alias("errors"),
    ), cfg)
    text = F.when(F.col("status") == "OK", F.col("text")).otherwise("")
    if notices is not None:
        text = citations.notices(F.col("status"), text, notices.operation_words, F.col("images"), F.col("recognised"), notices.safety, notices.image)
    return judged.select("query_id", text.alias("text"), "status", "confidence", citations.confidence_label(F.col("confidence"), cfg).alias("label"), "reasons", "coverage", "augmented", "calls", (F.size("errors") > 0).alias("degraded"), "errors")


def relaxed(queries: DataFrame, chunks: DataFrame, sufficient: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """query_id, chunk_id, score, rank: a second search for the questions that `sufficient` (query_id) lacks, without filters and for twice as many chunks."""
    return lexical.bm25_search(queries.join(sufficient.select("query_id"), "query_id", "left_anti"), chunks, 2 * cfg.top_k, None, cfg)
