"""Plug-ins: embedders, scorers, tokenizers and generators by name; a worker loads each once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions import text as fx


@dataclass(frozen=True)
class Plugin:
    name: str
    load: Callable[[], Callable]  # run once in each worker
    signature: str


EMBEDDERS: dict[str, Plugin] = {}
SCORERS: dict[str, Plugin] = {}
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"default": fx.tokenize}
GENERATORS: dict[str, Plugin] = {}


def register_embedder(name: str, load: Callable[[], Callable], signature: str) -> None:
    """`load()` gives a function from a list of texts to a list of vectors."""
    EMBEDDERS[name] = Plugin(name, load, signature)


def register_scorer(name: str, load: Callable[[], Callable], signature: str = "") -> None:
    """`load()` gives a function from lists of queries and texts to a list of scores."""
    SCORERS[name] = Plugin(name, load, signature or name)


def register_tokenizer(name: str, fn: Callable[[Column], Column]) -> None:
    TOKENIZERS[name] = fn


def register_generator(name: str, load: Callable[[], Callable]) -> None:
    """`load()` gives a function from (question, context) to an answer."""
    GENERATORS[name] = Plugin(name, load, name)


def embed(name: str, batch: int = 16) -> Callable[[str], Column]:
    """A Column function: texts to vectors of length 1, `batch` texts at a time."""
    load = EMBEDDERS[name].load

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([_unit(v) for lo in range(0, len(texts), batch) for v in model(texts[lo : lo + batch])], dtype="object")

    return run


def _unit(vector: list[float]) -> list[float]:
    """A vector of length 1; one of zeros stays as it is."""
    length = sum(float(x) ** 2 for x in vector) ** 0.5 or 1.0
    return [float(x) / length for x in vector]


def score(name: str, longest: int = 512) -> Callable[[Column, Column], Column]:
    """A Column function: the score of a query and a text; texts are cut to twice the model's length."""
    load = SCORERS[name].load

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            yield pd.Series(model(list(q), [x[: 2 * longest] for x in t]), dtype="float64")

    return lambda q, t: run(q, t)


def _first(names: list[str], registry: dict[str, Plugin], work: Callable, n: int) -> list[tuple]:
    """Of n rows: value, provider and the errors before it, by the first of `names` that can. A provider that fails on a batch is tried row by row, and rows that it fails on go to the next."""
    out: list[tuple | None] = [None] * n
    errors: list[list[str]] = [[] for _ in range(n)]
    for name in names:
        left = [i for i in range(n) if out[i] is None]
        try:
            model = _loaded(registry[name])
        except Exception as e:  # noqa: BLE001 - kept in the rows
            for i in left:
                errors[i].append(f"{name}: {e}")
            continue
        for i, value, error in _tried(model, work, left):
            if error is None and value is not None:
                out[i] = (value, name)
            else:
                errors[i].append(f"{name}: {error or 'no value'}")
    return [(*(o or (None, None)), "; ".join(e) or None) for o, e in zip(out, errors, strict=True)]


def _tried(model: Callable, work: Callable, rows: list[int]) -> Iterator[tuple]:
    try:
        yield from [(i, v, None) for i, v in zip(rows, work(model, rows), strict=True)]
    except Exception as e:  # noqa: BLE001 - kept in the rows
        if len(rows) <= 1:
            yield from [(i, None, e) for i in rows]
        else:
            for i in rows:
                yield from _tried(model, work, [i])


_models: dict[str, Callable] = {}


def _loaded(plugin: Plugin) -> Callable:
    key = f"{plugin.name} {plugin.signature}"
    if key not in _models:
        _models[key] = plugin.load()
    return _models[key]


def score_chain(names: list[str], longest: int = 512) -> Callable[[Column, Column], Column]:
    """A Column function of a query and a text: struct of score, provider and error, by the first of the scorers that gives one. Error: what those before it said; a score of null means that none could."""
    registry = {n: SCORERS[n] for n in names}

    @F.pandas_udf("score double, provider string, error string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for q, t in parts:
            qs, ts = q.fillna("").tolist(), [x[: 2 * longest] for x in t.fillna("")]
            rows = _first(names, registry, lambda model, at, qs=qs, ts=ts: model([qs[i] for i in at], [ts[i] for i in at]), len(qs))
            yield pd.DataFrame(rows, columns=["score", "provider", "error"]).astype({"score": "float64"})

    return lambda q, t: run(q, t)


def embed_chain(names: list[str], batch: int = 16) -> Callable[[Column], Column]:
    """A Column function of a text: struct of vector (of length 1), provider, signature and error, by the first of the embedders that gives one. With one name there is no other: rows that it fails on have no vector."""
    registry = {n: EMBEDDERS[n] for n in names}
    signatures = {n: EMBEDDERS[n].signature for n in names}

    @F.pandas_udf("vector array<double>, provider string, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            texts, rows = s.fillna("").tolist(), []
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                rows += _first(names, registry, lambda model, at, part=part: [list(map(float, v)) for v in model([part[i] for i in at])], len(part))
            yield pd.DataFrame(rows, columns=["vector", "provider", "error"])

    known = F.create_map(*[F.lit(x) for kv in signatures.items() for x in kv])

    def of(text: Column) -> Column:
        x = run(text)
        return F.transform(F.array(x), lambda r: F.struct(fx.l2_normalize(r["vector"]).alias("vector"), r["provider"].alias("provider"), known[r["provider"]].alias("signature"), r["error"].alias("error")))[0]

    return of


def render_prompt(template: str, **values: Column) -> Column:
    """The template with `{name}` replaced by the values, each once and not in what another value brought in; null counts as empty."""
    import re

    parts = [F.coalesce(values[x[1:-1]], F.lit("")) if x[1:-1] in values and x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x]
    return F.concat(*parts) if parts else F.lit("")


def scorer_probe(df: DataFrame, scorer: Column) -> DataFrame:
    """One row, ok: whether the scorer ranks `relevant` above `irrelevant` for every row (query, text, probe, relevant)."""
    per = df.withColumn("s", scorer).groupBy("probe").agg(F.min(F.when(F.col("relevant"), F.col("s"))).alias("good"), F.max(F.when(~F.col("relevant"), F.col("s"))).alias("bad"))
    return per.agg(F.coalesce(F.bool_and(F.col("good") > F.col("bad")), F.lit(False)).alias("ok"))


def generate(name: str) -> Callable[[Column, Column], Column]:
    """A Column function: struct of answer and error. A failure is kept in the row, whose answer is then null."""
    load = GENERATORS[name].load

    @F.pandas_udf("answer string, error string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(question: str, context: str) -> tuple[str | None, str | None]:
            try:
                return model(question, context), None
            except Exception as e:  # noqa: BLE001 - kept in the row
                return None, str(e)

        for q, c in parts:
            yield pd.DataFrame([one(a, b) for a, b in zip(q, c, strict=True)], columns=["answer", "error"])

    return lambda q, c: run(q, c)


def merge_timings(rows: DataFrame, by: str) -> DataFrame:
    """by, timings (of each stage the latest), errors (all, in order). `rows`: by, seq, timings, errors."""
    each = rows.select(by, "seq", F.explode("timings").alias("stage", "ms")).groupBy(by, "stage").agg(F.max_by("ms", "seq").alias("ms"))
    times = each.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "ms")))).alias("timings"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "errors"))), lambda x: x["errors"])
    errors = rows.groupBy(by).agg(F.flatten(ordered).alias("errors"))
    return errors.join(times, by, "left").select(by, "timings", "errors")
