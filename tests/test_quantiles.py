import random
import statistics

import numpy as np
import pytest

from evspark.operators import evaluate, quantiles


@pytest.mark.parametrize(("small", "accuracy"), [(10_000, 10_000), (50, 100), (0, 10_000)])
def test_quantiles_of_groups(spark, monkeypatch, small, accuracy):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    pick = random.Random(small)
    groups = {"tail": [pick.lognormvariate(0, 3) for _ in range(7000)], "few": [pick.choice([1.0, 2.0, 2.5]) for _ in range(3000)], "equal": [7.0] * 5000, "two": [1.0, 9.0], "one": [4.0], None: [pick.gauss(0, 1) for _ in range(1000)], "neither": [None] * 3}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(6)
    if small == 0:  # brackets of very small groups do not reach both neighbours of a rank
        df = df.filter("g IS NULL OR g NOT IN ('one', 'two', 'neither')")
    qs = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], "v", {k: (q, quantiles.linear) for k, q in qs.items()}).collect()}
    want = {g: vs for g, vs in groups.items() if g != "neither" and (small or g not in ("one", "two"))}
    assert set(got) == set(want)
    for g, vs in want.items():
        assert got[g].n == len(vs)
        for k, q in qs.items():
            assert got[g][k] == pytest.approx(float(np.percentile(vs, 100 * q)), abs=1e-9)
    got = {r.g: r.value for r in evaluate.exclusive_quantile(df, ["g"], "v").collect()}
    for g, vs in want.items():
        assert got[g] == pytest.approx(statistics.quantiles(vs, n=20)[-1] if len(vs) >= 20 else max(vs), abs=2e-6)


def test_groups_beyond_the_small_ones(spark):
    df = spark.range(100_000).selectExpr("id % 2 AS g", "cast(id AS double) AS v")
    got = quantiles.quantiles(df, ["g"], "v", {"p95": (0.95, quantiles.linear)})
    assert [(r.g, r.n, round(r.p95, 6)) for r in got.orderBy("g").collect()] == [(0, 50_000, 94_998.1), (1, 50_000, 94_999.1)]


def test_load_summary(spark):
    rows = [(1, True, 0.0, 2.0), (1, True, 1.0, 4.0), (1, False, 1.0, 100.0), (2, False, 0.0, 1.0), (None, True, 0.0, 3.0)]
    got = {r.round: r for r in evaluate.load_summary(spark.createDataFrame(rows, "round int, ok boolean, started double, seconds double")).collect()}
    assert (got[1].n_ok, got[1].n_failed, got[1].p50, got[1].p95, got[1].wall_s) == (2, 1, 3.0, 3.9, 101.0)
    assert (got[2].p50, got[2].verdict, got[None].p95, got[None].verdict) == (None, "over capacity", 3.0, "within capacity")
