import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionlytics.functions import sequence as sq
from regionlytics.functions import special as sp
from regionlytics.operators import rates as rt
from regionlytics.operators.scaling import FeatureTransform


@given(st.floats(1e-3, 1e6))
def test_gamma_family(x):
    assert sp.np_lgamma(np.array(x)) == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)
    h = max(1e-5, x * 1e-5)
    assert sp.np_digamma(np.array(x)) == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h) if x > 2 * h else sp.np_digamma(np.array(x)), rel=1e-3, abs=1e-3)


def test_columns_equal_numpy(spark):
    x = [0.01, 0.5, 1.0, 3.7, 100.0, 1e5]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(sp.digamma("x").alias("d"), sp.trigamma("x").alias("t"), sp.lgamma("x").alias("g")).collect()
    for name, f in (("d", sp.np_digamma), ("t", sp.np_trigamma), ("g", sp.np_lgamma)):
        assert np.allclose([r[name] for r in got], f(np.array(x)), rtol=1e-11, atol=1e-11)
    assert sp.np_digamma(np.array(1.0)) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert sp.np_trigamma(np.array(1.0)) == pytest.approx(math.pi**2 / 6, abs=1e-10)


def test_logsumexp(spark):
    d = spark.createDataFrame([("a", 1000.0), ("a", 1001.0), ("b", float("-inf")), ("b", float("nan"))], "k string, v double")
    got = {r["k"]: r["logsumexp"] for r in sp.logsumexp(d, "v", "k").collect()}
    assert got["a"] == pytest.approx(1001 + math.log1p(math.exp(-1)))
    assert got["b"] is None or got["b"] == float("-inf")


def test_contexts_and_labels(spark):
    assert len(sq.CONTEXTS) == 64 and sq.CONTEXTS[0] == "AAA" and sq.CONTEXTS[16] == "ACA" and len(set(sq.cosmic_order())) == 96
    rows = [(c, a) for c in sq.CONTEXTS for a in sq.alternatives(c)]
    d = spark.createDataFrame(rows, "c string, a string").select("c", "a", sq.context_index(F.col("c")).alias("i"), sq.alt_index(F.col("c"), F.col("a")).alias("m"), sq.cosmic_label(F.col("c"), F.col("a")).alias("l")).collect()
    assert all(sq.CONTEXTS[r["i"]] == r["c"] and sq.alternatives(r["c"])[r["m"]] == r["a"] for r in d)
    assert {r["l"] for r in d} == set(sq.cosmic_order())
    m = sq.signature_matrix({x: 1 / 96 for x in sq.cosmic_order()})
    assert m.sum() == pytest.approx(1) and np.allclose(m, 1 / 192)


def test_kmers_skip_other_letters(spark):
    d = spark.createDataFrame([(1, "ACGTNacg"), (2, "AC"), (3, None)], "k int, s string")
    got = {(r["k"], r["kmer"]): r["n"] for r in sq.kmer_counts(d, "k", "s").collect()}
    assert got == {(1, "ACG"): 2, (1, "CGT"): 1}


def test_feature_transforms(spark):
    d = spark.createDataFrame([(i, float(v), c, 5.0) for i, (v, c) in enumerate([(1, "b"), (2, "a"), (3, "b"), (4, "c")])], "locus int, x double, c string, k double")
    t = lambda kind, col="x", **o: [r[0] for r in FeatureTransform({col: kind}, **o).fit(d).transform(d).collect()]
    assert t("minmax") == pytest.approx([0, 1 / 3, 2 / 3, 1]) and t("minmax", "k") == [0] * 4
    assert t("standardize") == pytest.approx((np.arange(4) - 1.5) / np.std(np.arange(4)))
    assert t("robust") == pytest.approx([-1, -1 / 3, 1 / 3, 1])
    assert t("quantile")[0] == 0 and t("quantile")[-1] == 1 and sorted(t("quantile")) == t("quantile")
    assert t("categorical", "c", ordinal=True) == [1, 0, 1, 2]
    assert FeatureTransform({"c": "categorical"}).fit(d).names() == ["c=b", "c=c"]
    p = t("power")
    assert np.mean(p) == pytest.approx(0, abs=1e-9) and np.std(p) == pytest.approx(1, abs=1e-9)
    with pytest.raises(ValueError):
        FeatureTransform({"missing": "minmax"}).transform(d)


def test_targets_without_exposure_are_errors(spark):
    d = spark.createDataFrame([(0, 0.0, 0.0), (0, 2.0, 4.0)], "component int, target double, eta double")
    assert rt.glm_targets(d).count() == 1
    with pytest.raises(Exception, match="exposure is zero"):
        rt.glm_targets(d.withColumn("target", F.lit(1.0))).collect()
