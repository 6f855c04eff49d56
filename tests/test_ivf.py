import numpy as np
import pytest
from pyspark.sql import functions as F

from evspark.operators import vectors


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf.replace('0.001', '0.01')}/embeddings.parquet").select("vec_id", "embedding")


def pairs(df):
    return {(r.query_id, r.vec_id, r.score, r["rank"]) for r in df.select("query_id", "vec_id", "score", "rank").collect()}


def test_all_lists_are_the_exact_search(spark, table, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_BLOCK", 7)
    monkeypatch.setattr(vectors, "MEETING_QUERIES", 3)
    q = table.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    assert pairs(vectors.ivf_search(q, table, 10, 64, 16, 1.0)) == pairs(vectors.vector_search(q, table, 10))
    assert vectors.ivf_search(q.limit(0), table, 10, 64).count() == 0 == vectors.ivf_search(q, table.limit(0), 10, 64).count()


def test_recall_and_what_is_scored(spark, table):
    q = table.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    best = lambda hits: {(a, b) for a, b, _, _ in pairs(hits) if a != b}
    exact, near = best(vectors.vector_search(q, table, 11)), best(vectors.ivf_search(q, table, 11, 64, 64))
    assert len(exact & near) >= 0.85 * len(exact)
    centres = vectors.fit_centroids(table, 64, 64)
    own = table.select(F.get(vectors.nearest_lists(centres, 1)("embedding"), F.lit(0)).alias("l")).groupBy("l").count().collect()
    assert sum(r["count"] for r in own) == table.count() and len(own) > 32


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((30, 16))
    rows = [(i, (centre[i % 30] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(3000)] + [(9000 + i, centre[0].tolist()) for i in range(1500)] + [(99_999, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = table.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    exact, near = ({(a, round(s, 4)) for a, _, s, _ in pairs(df)} for df in (vectors.vector_search(q, table, 5), vectors.ivf_search(q, table, 5, 16, 60, 0.1)))
    assert len(exact & near) >= 0.95 * len(exact)
