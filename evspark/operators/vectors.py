"""Feature-hashing vectors, exact and approximate cosine search."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from evspark.functions import text as fx
from evspark.operators.lexical import top_k

#: Query vectors that a pass over the corpus carries to every task (at 64 dimensions, 5 MB); more queries take more passes.
QUERY_BLOCK = 20_000
#: Features of which a task knows the bucket by heart, and documents whose buckets stand in one matrix (1 MB at 512 dimensions).
KNOWN_FEATURES, DOCS_AT_ONCE = 1 << 19, 256
_WORD, _CJK = re.compile("[a-z0-9_]+"), re.compile("[\u3400-\u9fff]")


class _Places(dict):
    """Feature to its bucket, plus `dim` if its sign is negative."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, feature: str) -> int:
        if len(self) >= KNOWN_FEATURES:
            self.clear()
        h = hashlib.md5(feature.encode()).hexdigest()
        self[feature] = place = int(h[:3], 16) % self.dim + self.dim * (int(h[8], 16) % 2)
        return place


def hashing_features(docs: DataFrame, dim: int = 512, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """id, bucket, value: signed feature hashing of CJK characters and pairs and ASCII words, weighed by 1 + ln(tf), of length 1.

    The rows of an id come one after another, and features are counted in the task that has them: there is no row for each feature.
    Rows without an id, and texts whose features cancel out, are left out, or, if `whole`, are one document, and have NaN in their buckets.
    """
    schema = StructType([docs.schema[id_col], StructField("bucket", IntegerType()), StructField("value", DoubleType())])

    def features(text: str) -> list[str]:
        cjk = "" if text.isascii() else "".join(_CJK.findall(text))
        return [*cjk, *map("".join, zip(cjk, cjk[1:], strict=False)), *_WORD.findall(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, kind, ids, bags = _Places(dim), None, [], []

        def made() -> pa.RecordBatch:
            tf = np.fromiter(chain.from_iterable(b.values() for b in bags), np.float64)
            place = np.fromiter((places[f] for b in bags for f in b), np.int64, len(tf))
            at = np.repeat(np.arange(len(bags)), [len(b) for b in bags]) * dim + place % dim
            size = len(bags) * dim
            m = np.bincount(at, np.where(place < dim, 1, -1) * (1 + np.log(tf)), size).reshape(-1, dim)
            norm = np.sqrt((m * m).sum(axis=1))
            row, bucket = np.nonzero((np.bincount(at, minlength=size).reshape(-1, dim) > 0) & ((norm > 0) | whole)[:, None])
            with np.errstate(invalid="ignore"):
                value = m[row, bucket] / norm[row]
            return pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(row)), pa.array(bucket, pa.int32()), pa.array(value)], schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not ids or own != ids[-1]:
                    if len(ids) == DOCS_AT_ONCE:
                        yield made()
                        ids, bags = [], []
                    ids.append(own), bags.append(Counter())
                bags[-1].update(features(text.as_py()))
        if ids:
            yield made()

    rows = docs.filter(F.lit(whole) | F.col(id_col).isNotNull()).select(id_col, F.lower(F.coalesce(text_col, F.lit(""))).alias("__t"))
    return rows.repartition(id_col).sortWithinPartitions(id_col).mapInArrow(run, schema)


def hashing_embed(docs: DataFrame, dim: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, embedding of `dim` floats; a text without features has zeros."""
    by = hashing_features(docs, dim, id_col, text_col).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))  # dim entries at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)).cast("float"))
    return docs.select(id_col).join(by, id_col, "left").select(id_col, F.coalesce(dense, F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("embedding"))


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", query_col: str = "query_id", col: str = "embedding") -> DataFrame:
    """query, id, score (cosine, 6 decimals), rank: exact. MEETING_VECTORS vectors meet MEETING_QUERIES queries at a time in one matrix product, so that a task's memory does not grow with either, and a task sends on what is among the k best of a query so far."""
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, query_col), (vectors, id_col))}
    parts = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == b).select(query_col, col).toPandas() if n else None
        if own is None or not len(own):
            continue
        q, ids = _unit(own[col]), own[query_col].to_numpy()

        def best(batches: Iterator[pd.DataFrame], q=q, ids=ids) -> Iterator[pd.DataFrame]:
            best = np.full((len(q), k), -np.inf)  # the k best scores of each query so far, the least of them first
            for whole in batches:
                whole = whole[whole[col].notna()].sort_values(id_col, kind="stable")
                for start in range(0, len(whole), MEETING_VECTORS):
                    batch = whole.iloc[start : start + MEETING_VECTORS]
                    v, own = _unit(batch[col]).T, batch[id_col].to_numpy()
                    for low in range(0, len(q), MEETING_QUERIES):
                        some = slice(low, low + MEETING_QUERIES)
                        scores = np.round(q[some] @ v, 6)
                        best[some] = np.partition(np.concatenate([best[some], scores], axis=1), -k, axis=1)[:, -k:]
                        at, which = np.nonzero(scores >= best[some, :1])
                        found = scores[at, which]
                        order = np.lexsort((which, -found, at))  # of equal scores the smaller id first
                        at, which, found = at[order], which[order], found[order]
                        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                        yield pd.DataFrame({query_col: ids[at[kept] + low], id_col: own[which[kept]], "score": found[kept]})

        parts.append(vectors.select(id_col, col).mapInPandas(best, f"`{query_col}` {kinds[query_col]}, `{id_col}` {kinds[id_col]}, score double"))
    if not parts:
        return vectors.select(F.lit(None).cast(kinds[query_col]).alias(query_col), id_col, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return top_k(hits, query_col, "score", id_col, k)


def vector_search_ann(queries: DataFrame, vectors: DataFrame, k: int, dim: int, bits: int = 6, tables: int = 16, seed: int = 7, id_col: str = "vec_id", query_col: str = "query_id", col: str = "embedding", probes: int = 4) -> DataFrame:
    """query, id, score, rank: vectors in the query's bucket of signs of random projections in one of `tables`, or in one of the `probes` beside it (one sign changed, those nearest to zero first), scored exactly. Approximate by nature."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))

    def buckets(near: int):
        @F.pandas_udf("array<int>")
        def own(v: pd.Series) -> pd.Series:
            at = (_unit(v) @ planes.T).reshape(len(v), tables, bits)
            home = ((at > 0) * (1 << np.arange(bits))).sum(axis=2)[:, :, None]
            beside = home ^ (1 << np.argsort(np.abs(at), axis=2, kind="stable")[:, :, :near])
            found = np.concatenate([home, beside], axis=2) + np.arange(tables)[:, None] * (1 << bits)
            return pd.Series(list(found.reshape(len(v), -1).astype(np.int32)))

        return own(col)

    v = vectors.filter(F.col(col).isNotNull())
    left = queries.filter(F.col(col).isNotNull()).select(query_col, F.explode(buckets(probes)).alias("bucket"))
    right = v.select(id_col, F.explode(buckets(0)).alias("bucket"))
    pairs = left.join(right, "bucket").select(query_col, id_col).distinct()
    scored = pairs.join(queries.select(query_col, fx.l2_normalize(col).alias("q")), query_col).join(v.select(id_col, fx.l2_normalize(col).alias("v")), id_col)
    return top_k(scored.select(query_col, id_col, F.round(fx.dot(F.col("q"), F.col("v")), 6).alias("score")), query_col, "score", id_col, k)


def label_knn(hits: DataFrame, labels: DataFrame, id_col: str = "vec_id", query_col: str = "query_id") -> DataFrame:
    """query, agreement: the share of a query's hits, itself left out, with its own label. `labels`: id, label."""
    own = labels.select(F.col(id_col).alias(query_col), F.col("label").alias("own"))
    both = hits.filter(F.col(query_col) != F.col(id_col)).join(labels, id_col).join(own, query_col)
    return both.groupBy(query_col).agg(F.round(F.avg((F.col("label") == F.col("own")).cast("int")), 6).alias("agreement"))


#: Vectors that the coarse quantiser is fitted on, at most, and numbers that they may have together; rounds of the fit.
FIT_VECTORS, FIT_NUMBERS, FIT_ROUNDS = 20_000, 1 << 24, 12
#: Lists of an index at most; vectors of a list, queries, and vectors of a table that meet in one matrix product.
MOST_LISTS, LIST_BLOCK, MEETING_QUERIES, MEETING_VECTORS = 4096, 4096, 1024, 1024


def fit_centroids(vectors: DataFrame, dim: int, lists: int, seed: int = 7, id_col: str = "vec_id", col: str = "embedding") -> np.ndarray:
    """Centres of at most `lists` groups by cosine, fitted on the FIT_VECTORS vectors of the least hash of their id (fewer if they are long). An empty table gives one centre."""
    most = max(1, min(FIT_VECTORS, FIT_NUMBERS // dim))
    some = vectors.filter(F.col(col).isNotNull()).select(col, F.xxhash64(F.lit(seed), id_col).alias("h")).orderBy("h").limit(most).select(col).toPandas()
    if not len(some):
        return np.zeros((1, dim))
    x = _unit(some[col])
    centres = x[: max(1, min(lists, len(x)))].copy()  # the order is that of a hash
    for _ in range(FIT_ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def nearest_lists(centres: np.ndarray, n: int):
    """A Column function: the `n` lists nearest to a vector, the nearest first."""

    @F.pandas_udf("array<int>")
    def of(v: pd.Series) -> pd.Series:
        near = _unit(v) @ centres.T
        return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return of


def ivf_search(queries: DataFrame, vectors: DataFrame, k: int, dim: int, lists: int = 64, share: float = 0.45, seed: int = 7, id_col: str = "vec_id", query_col: str = "query_id", col: str = "embedding") -> DataFrame:
    """query, id, score (cosine, 6 decimals), rank: the best of the vectors in the `share` of the inverted lists nearest to the query. Approximate by nature.

    Every vector is in one list. A list lies in blocks of LIST_BLOCK vectors, and meets its queries MEETING_QUERIES at a time in a
    matrix product, of which the k best of each query go on: a list or a vector that holds a third of all rows is many blocks, and no
    pair is a row. Null vectors are in no list and find nothing.
    """
    centres = fit_centroids(vectors, dim, min(lists, MOST_LISTS), seed, id_col, col)
    probes = max(1, int(np.ceil(share * len(centres))))
    v = vectors.filter(F.col(col).isNotNull()).select(id_col, col, F.get(nearest_lists(centres, 1)(col), F.lit(0)).alias("list"))
    q = queries.filter(F.col(col).isNotNull()).select(query_col, col, F.explode(nearest_lists(centres, probes)(col)).alias("list"))
    blocks = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    counts = F.broadcast(blocks(v, LIST_BLOCK, "nv").join(blocks(q, MEETING_QUERIES, "nq"), "list"))  # a row a list
    deal = lambda id_, n: F.pmod(F.xxhash64(F.lit(seed), id_), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(counts, "list").select(query_col, F.col(col).alias("q"), "list", deal(query_col, F.col("nq")).alias("qb"), each("nv").alias("vb"))
    right = v.join(counts, "list").select(id_col, F.col(col).alias("v"), "list", deal(id_col, F.col("nv")).alias("vb"), each("nq").alias("qb"))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, query_col), (vectors, id_col))}

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({query_col: [], id_col: [], "score": []})
        held = held.sort_values(id_col, kind="stable")
        scores = np.round(_unit(asked["q"]) @ _unit(held["v"]).T, 6)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({query_col: np.repeat(asked[query_col].to_numpy(), top.shape[1]), id_col: held[id_col].to_numpy()[top.ravel()], "score": np.take_along_axis(scores, top, axis=1).ravel()})

    key = ["list", "vb", "qb"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, f"`{query_col}` {kinds[query_col]}, `{id_col}` {kinds[id_col]}, score double")
    return top_k(hits, query_col, "score", id_col, k)
