"""Plot tables against numpy, and orders of columns against all flips."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlytics.operators import views


def frame(spark, n, k=3, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.random((n, k)) ** 2
    rows = [(i % 3, i, *map(float, v[i])) for i in range(n)]
    order = sorted(range(n), key=lambda i: (i % 3, i))
    return spark.createDataFrame(rows, "chrom int, locus long, " + ", ".join(f"v{j} double" for j in range(k))).repartition(5), v[order]


@pytest.mark.parametrize(("n", "bins", "width"), [(97, 10, 7), (97, 200, 4), (5, 2, 30), (1, 1, 1)])
def test_rate_track(spark, n, bins, width):
    df, v = frame(spark, n)
    got = views.rate_track(df, "v0", ["chrom", "locus"], bins, width).orderBy("bin").collect()
    raw = v[:, 0]
    padded = np.concatenate([np.zeros(width), raw, np.zeros(width)])
    smooth = np.array([padded[i + width - width // 2 : i + width + (width - 1) // 2 + 1].sum() / width for i in range(n)])
    at = np.arange(n) * min(bins, n) // n
    assert [r["bin"] for r in got] == sorted(set(at)) and sum(r["n"] for r in got) == n
    for name, x in (("raw", raw / raw.sum()), ("smooth", smooth / smooth.sum())):
        for r in got:
            own = x[at == r["bin"]]
            assert (r["first"], r["last"]) == tuple(np.flatnonzero(at == r["bin"])[[0, -1]])
            assert (r[f"{name}_mean"], r[f"{name}_min"], r[f"{name}_max"]) == pytest.approx((own.mean(), own.min(), own.max()))


def test_rate_track_of_nothing_and_of_zeros(spark):
    df, _ = frame(spark, 6)
    assert views.rate_track(df.where("false"), "v0", ["chrom", "locus"], 10, 3).count() == 0
    flat = views.rate_track(df.withColumn("v0", F.lit(None).cast("double")), "v0", ["chrom", "locus"], 2, 3).collect()
    assert [r["raw_max"] for r in flat] == [0.0, 0.0] and sum(r["n"] for r in flat) == 6


def test_bins_shuffle_a_row_each(spark):
    df, _ = frame(spark, 50)
    plan = views.binned(df.withColumn("ordinal", F.col("locus")), 50, 4, ["v0"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_avg") and plan.index("partial_avg") > plan.index("Exchange")


def test_rate_matrix_and_order(spark):
    df, v = frame(spark, 40, 5, seed=3)
    names = [f"v{j}" for j in range(5)]
    d = views.cosine_distances(df, names)
    unit = v / np.linalg.norm(v, axis=0)
    assert np.allclose(d, 1 - unit.T @ unit)
    got = views.rate_matrix(df, names, ["chrom", "locus"], 8).collect()
    assert len(got) == 40
    share = v / v.sum(axis=0)
    at = np.arange(40) * 8 // 40
    for r in got:
        assert r["share"] == pytest.approx(share[at == r["bin"], int(r["name"][1])].mean())
    order = [n for _, n in sorted({(r["position"], r["name"]) for r in got})]
    assert order == views.column_order(df, names) and names.index(order[0]) <= names.index(order[-1])


def test_orders_of_three_are_the_best_of_all(spark):
    for seed in range(20):
        d = np.random.default_rng(seed).random((3, 3))
        d = (d + d.T) * (1 - np.eye(3))
        cost = lambda p: sum(d[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert cost(views.distance_order(d)) == pytest.approx(min(cost(p) for p in permutations(range(3))))
    assert views.distance_order(np.zeros((1, 1))) == [0] and views.column_order(spark.range(1), []) == []


def test_matrix_by_segment(spark):
    m = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 3.0), (9, 0.0, 0.0)], "locus long, a double, `b c` double")
    s = spark.createDataFrame([(0, "x", 50, 60), (0, "x", 10, 20), (1, "x", 30, 40), (5, "y", 0, 1)], "locus long, chrom string, start long, end long")
    assert [tuple(r) for r in views.matrix_by_segment(m, s).collect()] == [("x", 10, 20, 1.0, None), ("x", 30, 40, 2.0, 3.0), ("x", 50, 60, 1.0, None)]
