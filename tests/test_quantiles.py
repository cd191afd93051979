"""Exact order statistics against numpy, with few bins so that passes have to refine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlytics.operators import quantiles as qt


def table(spark, columns):
    n = max(map(len, columns.values()))
    rows = [tuple(float(v[i]) if i < len(v) and v[i] is not None else None for v in columns.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns)).repartition(4)


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    k = qt.keys_of(x)
    assert (np.diff(k.astype(object)) >= 0).all() and k[4] == k[5] and len(set(k.tolist())) == 10
    assert [qt.value_of(int(v)) for v in k] == x.tolist()


@pytest.mark.parametrize(("bins", "bits", "last"), [(1 << 18, 16, 50_000), (1 << 12, 9, 0), (64, 5, 30)])
def test_percentiles_and_cuts_against_numpy(spark, monkeypatch, bins, bits, last):
    monkeypatch.setattr(qt, "BINS", bins)
    monkeypatch.setattr(qt, "BITS", bits)
    monkeypatch.setattr(qt, "LAST", last)
    rng = np.random.default_rng(4)
    columns = {
        "normal": rng.normal(size=3000), "heavy": np.exp(20 * rng.normal(size=3000)) * rng.choice([-1, 1], 3000), "ties": rng.integers(0, 4, 3000), "one": np.full(5, 7.25), "two": np.array([1.0, 2.0]),
        "a.b": np.array([None, float("nan"), 3.0, -0.0, float("inf"), 1.0], object), "none": np.array([None, None], object),
    }
    df = table(spark, columns)
    clean = {c: np.array([x for x in v if x is not None and not np.isnan(float(x))], float) for c, v in columns.items()}
    shares = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = qt.percentiles(df, list(columns), shares)
    for c, v in clean.items():
        assert got[c] == pytest.approx(np.quantile(v, shares).tolist() if len(v) else [], rel=1e-12) if c != "a.b" else got[c][:2] == [0.0, 0.75]
    cuts = qt.values_at(df, list(columns), 40)
    for c, v in clean.items():
        v = np.sort(v)
        assert cuts[c] == ([v[max(0, int(np.ceil(i / 40 * len(v))) - 1)] for i in range(41)] if len(v) else [])


def test_what_comes_back_is_bounded(spark, monkeypatch):
    """Over distinct values only some thousand rows come to the driver, where percentile() would hold them all."""
    monkeypatch.setattr(qt, "BINS", 1 << 12)
    monkeypatch.setattr(qt, "BITS", 10)
    monkeypatch.setattr(qt, "LAST", 2000)
    seen, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    df = spark.range(300_000).select((F.sin("id") * 1000).alias("v"))
    got = qt.percentiles(df, ["v"], [0.25, 0.5, 0.75])["v"]
    assert got == pytest.approx(np.quantile(np.sin(np.arange(300_000)) * 1000, [0.25, 0.5, 0.75]).tolist(), abs=1e-9)
    assert max(map(len, seen)) <= 4096 and len(seen) < 8
