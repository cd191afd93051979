"""Rate models and kinds of observations that the library doesn't know, under names of their own."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from regionlytics.model import extension, trainer
from regionlytics.operators.corpora import Corpus
from regionlytics.operators.scaling import FeatureTransform

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see the folder of tests


class FlatRate:
    """One rate per corpus: what was observed over what the exposure would give. The last columns of x are corpus indicators."""

    kind = "flat"

    def __init__(self, level, first):
        self.level, self.first = np.asarray(level, float), first

    def log_rate(self, x):
        return x[:, self.first :] @ self.level.T

    def fit(self, targets, rate=1.0):
        k, corpora = self.level.shape
        level = self.level.copy()
        for c in range(corpora):
            own = targets.where(F.get("x", F.lit(self.first + c)) > 0)
            r = own.agg(*[F.sum(F.get(a, F.lit(i))).alias(f"{a}{i}") for a in ("target", "eta") for i in range(k)]).first()
            new = [np.log(max(r[f"target{i}"] or 0, 1e-9) / max(r[f"eta{i}"] or 0, 1e-9)) for i in range(k)]
            level[:, c] = (1 - rate) * level[:, c] + rate * np.array(new)
        return FlatRate(level, self.first)


FLAT = extension.RateKind("flat", lambda k, width, corpora, groups, options: FlatRate(np.zeros((k, len(corpora))), width - len(corpora)), lambda r: {"level": r.level.tolist(), "first": r.first}, lambda d: FlatRate(d["level"], d["first"]))
#: Doublets: sixteen reference pairs as contexts, nine alternatives each.
PAIRS = [a + b for a in "ACGT" for b in "ACGT"]
DOUBLETS = extension.ObservationKind("doublets", 16, 9, lambda m: {f"{PAIRS[c]}>{a}": float(m[c, a]) for c in range(16) for a in range(9)})


@pytest.fixture
def registered(monkeypatch):
    monkeypatch.setattr(extension, "_rates", dict(extension._rates))
    monkeypatch.setattr(extension, "_observations", dict(extension._observations))
    extension.register_rate(FLAT)
    extension.register_observation(DOUBLETS)


def corpus(spark, contexts, mutations, kind=None, seed=0):
    """Six samples over twenty loci; even samples hold mutation 0 mostly, odd ones the last."""
    rng = np.random.default_rng(seed)
    rows = [("c", f"s{s}", int(rng.integers(20)), int(rng.integers(contexts)), int(rng.choice([s % 2 * (mutations - 1), rng.integers(mutations)])), 1.0) for s in range(6) for _ in range(80)]
    m = spark.createDataFrame(rows, "corpus string, sample string, locus long, context int, mutation int, weight double")
    loci = spark.range(20).selectExpr("'c' AS corpus", "id AS locus", "1.0D AS exposure")
    tri = loci.select("corpus", "locus", F.explode(F.sequence(F.lit(0), F.lit(contexts - 1))).alias("context")).withColumn("n", F.lit(2))
    meta = spark.createDataFrame([("c", "observation", kind)], "corpus string, key string, value string") if kind else None
    return Corpus(m, loci, tri, loci.selectExpr("corpus", "locus", "locus % 5 / 5 AS f"), meta)


def test_a_third_rate_model_trains_scores_and_comes_back_from_its_text(spark, registered, tmp_path):
    c = corpus(spark, 64, 3)
    o = dict(k=2, epochs=3, seed=4)
    flat = trainer.train(c, FeatureTransform({"f": "other"}), trainer.Options(model_type="flat", **o))
    assert flat.state.rate_model.kind == "flat" and np.abs(flat.state.rate_model.level).max() > 0
    # without features a linear rate is a level per corpus as well, and levels fall out of the densities
    linear = trainer.train(c, FeatureTransform({}), trainer.Options(model_type="linear", **o))
    assert trainer.score(flat, c)["perplexity"] == pytest.approx(trainer.score(linear, c)["perplexity"], rel=1e-3)
    trainer.save(flat, spark, str(tmp_path / "m"))
    back = trainer.load(spark, str(tmp_path / "m"))
    assert trainer.score(back, c) == pytest.approx(trainer.score(flat, c))


def test_another_kind_of_observation_goes_through_training_to_signatures(spark, registered):
    c = corpus(spark, 16, 9, "doublets")
    model = trainer.train(c, FeatureTransform({"f": "standardize"}), trainer.Options(k=2, epochs=4))
    assert model.state.omega.shape == (2, 16, 9) and model.options.observation == "doublets"
    shares = trainer.signatures(model, spark).groupBy("component").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect()
    assert [r["n"] for r in shares] == [144, 144] and all(r["p"] == pytest.approx(1) for r in shares)
    assert trainer.predict(model, c).count() == 6
    # responsibilities add up to the mutations: none falls into another context's place
    total = trainer.component_rates(model, c).agg(*[F.sum(n).alias(n) for n in model.state.names]).first()
    assert sum(total) == pytest.approx(480)


def test_hot_samples_of_another_kind_give_the_same_statistics(spark, registered):
    from regionlytics.model import core, split

    c = corpus(spark, 16, 9, "doublets")
    model = trainer.train(c, FeatureTransform({"f": "other"}), trainer.Options(k=2, epochs=1))
    cells = core.cells(c.mutations)
    rated, log_z = trainer.rates_for(model, c)
    hot = split.hot_samples(cells, 10, 20)
    sums = lambda hot: {(r["corpus"], r["key"]): r["value"] for r in core.summed(core.infer(cells, rated, log_z, model.state, tolerance=1e-9, hot=hot), "signature", "corpus", "key", k=2).collect()}
    one, many = sums(split.hot_samples(cells)), sums(hot)
    assert hot.count() == 6 and one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k], abs=1e-4) for k in one)


def test_what_does_not_fit_is_refused(spark, registered):
    t, o = FeatureTransform({"f": "other"}), trainer.Options
    with pytest.raises(ValueError, match="registered already"):
        extension.register_rate(FLAT)
    with pytest.raises(ValueError, match="no rate model splines; there are"):
        trainer.train(corpus(spark, 64, 3), t, o(model_type="splines"))
    with pytest.raises(ValueError, match="no kind of observation triplets"):
        trainer.train(corpus(spark, 64, 3), t, o(observation="triplets"))
    with pytest.raises(ValueError, match="mutations aren't sbs"):
        trainer.train(corpus(spark, 16, 9), t, o())
    with pytest.raises(ValueError, match="counts of contexts"):
        extension.check_observations(DOUBLETS, corpus(spark, 16, 9).mutations, corpus(spark, 64, 3).trinucs)
    with pytest.raises(ValueError, match="can't be fixed"):
        trainer.train(corpus(spark, 16, 9, "doublets"), t, o(fixed={"a": {}}))
    short = extension.RateKind("short", lambda k, *_: FlatRate(np.zeros((k + 1, 1)), 0), FLAT.dump, FLAT.load)
    extension.register_rate(short)
    with pytest.raises(ValueError, match="must say so"):
        extension.make_rate("short", 2, 1, ["c"], None, {})
    targets = spark.createDataFrame([([1.0], [1.0], [1.0])], "x array<double>, target array<double>, eta array<double>")
    with pytest.raises(ValueError, match="columns are missing"):
        extension.fit_rate(FlatRate([[0.0]], 0), targets, 1.0, 1)
    with pytest.raises(ValueError, match="other types"):
        extension.fit_rate(FlatRate([[0.0]], 0), targets.withColumn("logmu", F.lit("a")), 1.0, 1)
    extension.register_rate(extension.RateKind("flat", FLAT.make, lambda r: {"level": [[9.0]], "first": 0}, FLAT.load), replace=True)
    with pytest.raises(ValueError, match="changes when it is stored"):
        extension.dump_rate(FlatRate([[0.0]], 0), 1)


def test_categories_reach_trees_as_codes(spark):
    c = corpus(spark, 64, 3)
    c.features = c.features.withColumn("kind", F.concat(F.lit("k"), F.col("locus") % 4))
    t = FeatureTransform({"f": "other", "kind": "categorical"})
    names = {m: trainer.fitted_transform(c, t, trainer.Options(model_type=m)).names() for m in ("linear", "gbt")}
    assert len(names["linear"]) == 4 and sorted(names["gbt"]) == ["f", "kind"]
