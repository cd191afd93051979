"""Invariants of inference and fitting, and recovery of simulated signatures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regionlytics.functions.special import dirichlet_multinomial_logprob, np_dirichlet_expectation
from regionlytics.model import core, posterior, simulate, split, trainer, tuning
from regionlytics.model.boosting import BoostedRate, Tree
from regionlytics.model.linear import LinearRate
from regionlytics.operators import views
from regionlytics.operators.scaling import FeatureTransform


@pytest.fixture(scope="module")
def simulated(spark):
    c, truth = simulate.simulate(spark, simulate.SimulationConfig(n_cells=40, n_loci=60, log_mean_mutations=6.0, log_std_mutations=0.3, signatures=simulate.synthetic_signatures(2, 3, 0.05), seed=5, pi_prior=np.full(2, 0.5)))
    c.mutations = c.mutations.persist()
    return c, truth


def transform():
    return FeatureTransform({"signal_0": "standardize", "signal_1": "standardize"})


@pytest.fixture(scope="module")
def model(spark, simulated):
    return trainer.train(simulated[0], transform(), trainer.Options(k=2, epochs=25, eval_every=5, seed=3, empirical_bayes=True, begin_prior_updates=5))


def test_recovers_signatures(model, simulated):
    assert simulate.recovery(model, simulated[1])["signature_cosine"] > 0.95


def test_bound_grows(model):
    p = [h["perplexity"] for h in model.history]
    assert all(b <= a * 1.01 for a, b in zip(p, p[1:], strict=False))


def test_predict_score_store(spark, model, simulated, tmp_path):
    c = simulated[0]
    g = trainer.predict(model, c)
    assert g.count() == 40 and set(model.state.names) < set(g.columns)
    trainer.save(model, spark, str(tmp_path / "m"))
    again = trainer.load(spark, str(tmp_path / "m"))
    assert trainer.score(again, c)["perplexity"] == pytest.approx(trainer.score(model, c)["perplexity"])
    assert trainer.signatures(model, spark).groupBy("component").agg(F.sum("p").alias("p")).where("abs(p - 1) > 1e-9").count() == 0
    assert 0 < trainer.mutation_rate_r2(model, c).first()["r2"] < 1


@pytest.mark.parametrize("blend", [None, 0.4])
def test_samples_in_chunks_have_the_same_composition(spark, model, simulated, monkeypatch, blend):
    """Whole, in one chunk each, in several, and some of them only: the same gammas, bounds and sums."""
    c = simulated[0]
    rated, log_z = trainer.rates_for(model, c)
    cells = core.cells(c.mutations).persist()
    old = spark.createDataFrame([(x["corpus"], x["sample"], [1.0 + x["sample"], 2.0]) for x in cells.select("corpus", "sample").distinct().collect()], "corpus string, sample long, gamma array<double>") if blend else None
    sizes = sorted(x["count"] for x in cells.groupBy("sample").count().collect())

    def told(limit, chunk):
        hot = split.hot_samples(cells, limit, chunk)
        rows = core.infer(cells, rated, log_z, model.state, old, blend or 1.0, 0.5, 1e-2, 25, 3, hot).collect()
        gamma = {(x["corpus"], x["sample"]): [*x["value"], x["bound"], x["weight"]] for x in rows if x["kind"] == "gamma"}
        sums = {}
        for x in rows:
            if x["kind"] != "gamma":
                sums[x["sample"], x["kind"], x["key"]] = sums.get((x["sample"], x["kind"], x["key"]), 0) + np.array(x["value"])
        assert len(gamma) == sum(x["kind"] == "gamma" for x in rows) == len(sizes)
        return hot.count(), gamma, sums

    n, gamma, sums = told(1 << 30, 10)
    assert n == 0
    for limit, chunk, hot in ((0, sizes[0] // 8, len(sizes)), (sizes[len(sizes) // 2], 20, sum(x > sizes[len(sizes) // 2] for x in sizes))):
        n, gamma_2, sums_2 = told(limit, chunk)
        assert n == hot and gamma.keys() == gamma_2.keys() and sums.keys() == sums_2.keys()
        assert all(np.allclose(gamma[k], gamma_2[k], rtol=1e-7, atol=1e-7) for k in gamma)
        assert all(np.allclose(sums[k], sums_2[k], rtol=1e-6, atol=1e-8) for k in sums)


def test_search_finds_the_fixed_point_of_plain_steps():
    rng = np.random.default_rng(0)
    for k, n, like in ((2, 50, 0.0), (3, 400, 0.9), (6, 300, 0.99), (3, 1, 0.0)):
        phi = (1 - like) * rng.random((k, n)) + like * rng.random(n)
        weight, alpha = rng.integers(1, 50, n).astype(float), np.full(k, 0.7)
        step = lambda g, phi=phi, w=weight, a=alpha: a + np.exp(np_dirichlet_expectation(g)) * (phi @ (w / (phi.T @ np.exp(np_dirichlet_expectation(g)))))
        got = core.fixed_point(phi, weight, alpha, np.full(k, 1.0), 1e-8, 1000)
        assert np.abs(step(got) - got).max() < (1e-6 if like < 0.99 else 1e-3)  # within a thousand evaluations
        plain = np.full(k, 1.0)
        for _ in range(2000):
            plain = step(plain)
        assert core.bound(phi, weight, alpha, got) >= core.bound(phi, weight, alpha, plain) - 1e-3


def test_evidence_is_bracketed():
    """Against the sum over all labels of their Dirichlet-multinomial and likelihoods."""
    from itertools import product

    rng = np.random.default_rng(3)
    for k, weights, sharp in ((2, [1, 1, 1], 1), (3, [2, 1, 3, 1], 1), (2, [4, 3, 2], 2), (3, [1], 2)):
        phi, alpha = rng.random((k, len(weights))) ** sharp, rng.random(k) + 0.3
        logs = np.repeat(np.log(phi), weights, axis=1)
        terms = [dirichlet_multinomial_logprob(alpha, np.bincount(z, minlength=k).astype(float)) + logs[list(z), range(len(z))].sum() for z in product(range(k), repeat=sum(weights))]
        exact = np.log(np.exp(terms).sum())
        lower, estimate, upper = posterior.evidence(phi, np.array(weights, float), alpha, rng, steps=200, runs=80, warm_up=30)
        assert lower - 0.03 < exact < upper + 0.03 and upper - lower < 0.2
        assert estimate == pytest.approx(exact, abs=0.05)


def test_evidence_of_samples(model, simulated):
    got = posterior.marginal_likelihood(model, simulated[0], steps=15, runs=2).toPandas()
    assert len(got) == 40 and (got["lower"] <= got["log_likelihood"] + 1e-9).all() and (got["lower"] < got["upper"]).mean() > 0.9


def test_posterior_names_the_component(model, simulated):
    got = posterior.assign(model, simulated[0], warm_up=20, sweeps=40)
    shares = got.select(*[F.exp(f"logp_{n}").alias(n) for n in model.state.names])
    assert shares.where(F.abs(sum(F.col(n) for n in model.state.names) - 1) > 1e-9).count() == 0
    assert got.count() == simulated[0].mutations.count()


def test_explanations_add_up(model, simulated):
    e = posterior.explain(model, simulated[0], 1).groupBy("locus").agg(F.sum("value").alias("v"))
    assert e.agg(F.abs(F.avg("v"))).first()[0] < 1e-8


def test_boosted_model(spark, simulated):
    m = trainer.train(simulated[0], transform(), trainer.Options(k=2, model_type="gbt", epochs=3, eval_every=3, seed=3, rate_options={"rounds": 4, "depth": 2, "least": 0.5}))
    assert any(m.state.rate_model.trees) and np.isfinite(m.history[-1]["perplexity"])
    again = trainer.from_json(trainer.to_json(m))
    x = np.random.default_rng(0).normal(size=(20, 3))
    assert np.allclose(again.state.rate_model.log_rate(x), m.state.rate_model.log_rate(x))
    assert posterior.explain(m, simulated[0], 0).count() > 0


def test_subsampling_and_resampling(simulated):
    c = simulated[0]
    m = trainer.train(c, transform(), trainer.Options(k=2, epochs=3, eval_every=3, batch_size=20, locus_subsample=0.5, seed=1))
    assert np.isfinite(m.state.omega).all()
    r = simulate.resample(m, c, seed=1)
    assert r.mutations.count() == c.mutations.count()


def test_simulation_of_a_whole_genome(spark):
    config = simulate.SimulationConfig(n_cells=3, n_loci=250_000, log_mean_mutations=8.0, log_std_mutations=0.1, signatures=simulate.synthetic_signatures(9, 3, 0.05), seed=5, pi_prior=np.ones(9))
    c, truth = simulate.simulate(spark, config)
    held = [v for v in truth.values() if isinstance(v, np.ndarray)]
    assert max(v.size for v in held) <= 9 * 192 and c.trinucs.count() == 64 * 250_000
    assert c.mutations.agg(F.countDistinct("sample")).first()[0] == 3 and c.mutations.agg(F.countDistinct("locus")).first()[0] > 5_000
    # half of the time in each state, which changes after one locus in ten, also where blocks meet
    states = truth["states"].orderBy("locus").toPandas()
    assert (states["locus"] == np.arange(250_000)).all() and 0.45 < states["state"].mean() < 0.55
    changes = np.diff(states["state"]) != 0
    assert changes.mean() == pytest.approx(0.1, abs=0.01)
    assert changes[simulate.BLOCK_STATES - 1 :: simulate.BLOCK_STATES].mean() < 0.35
    told = c.features.agg(F.avg("signal_0"), F.stddev_pop("signal_0"), F.avg("signal_1"), F.stddev_pop("signal_1")).first()
    assert told[:] == pytest.approx((0, 1, 0, 1), abs=1e-9)
    config.n_loci = 500
    got, again = (simulate.simulate(spark, config)[0].mutations.toPandas() for _ in range(2))
    key = list(got.columns)
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_bridges_are_chains_given_their_ends():
    p = np.array([[0.7, 0.2, 0.1], [0.0, 0.5, 0.5], [0.6, 0.0, 0.4]])
    powers, rng = simulate.ladder(p, 8), np.random.default_rng(2)
    ends = simulate.block_ends(powers[-1], 20_000, rng)
    path = np.concatenate([simulate.bridge(powers, a, b, rng) for a, b in zip(ends, ends[1:], strict=False)])
    assert (path[::8] == ends[:-1]).all()
    seen = np.zeros((3, 3))
    np.add.at(seen, (path[:-1], path[1:]), 1)
    assert seen[p == 0].sum() == 0 and np.abs(seen / seen.sum(axis=1, keepdims=True) - p).max() < 0.01
    two = np.zeros((3, 3))  # two steps on, over the joints of blocks too
    np.add.at(two, (path[:-2], path[2:]), 1)
    assert np.abs(two / two.sum(axis=1, keepdims=True) - p @ p).max() < 0.01


def test_simulation_takes_cohorts_rates_and_exposures(spark):
    cohort = spark.createDataFrame([("a", 0), ("b", 7), ("c", 3000)], "sample string, n int")
    exposure = spark.range(300).selectExpr("id AS locus", "IF(id < 100, 0.0, 1.0) AS exposure")
    config = simulate.SimulationConfig(n_loci=300, exposures=exposure, rate_function=lambda x: np.zeros((3, len(x))), seed=4)
    for most in (simulate.TASK_DRAWS, 500):
        simulate.TASK_DRAWS, kept = most, simulate.TASK_DRAWS
        try:
            m = simulate.simulate(spark, config, cohort)[0].mutations.toPandas()
        finally:
            simulate.TASK_DRAWS = kept
        assert m.groupby("sample").size().to_dict() == {"b": 7, "c": 3000}
        assert m["locus"].min() >= 100 and m["locus"].max() < 300


def test_simulated_draws_follow_masses_and_counts(spark):
    rng = np.random.default_rng(1)
    counts, delta, omega = rng.integers(1, 9, (5, 64)).astype(float), rng.random((2, 64)) + 0.1, rng.random((2, 64, 3)) + 0.1
    rate = rng.random((2, 5)) + 0.1
    psi = rate[:, :, None] * counts * delta[:, None, :]
    loci = spark.createDataFrame([("c", i, 1.0, counts[i].tolist(), np.log(rate[:, i]).tolist()) for i in range(5)], "corpus string, locus long, exposure double, n array<double>, logmu array<double>")
    cohort = spark.createDataFrame([("c", 1, 60_000.0, 0.3, 0.7)], "corpus string, sample int, n double, g0 double, g1 double")
    got = simulate.drawn(loci, cohort, delta, omega / omega.sum(axis=2, keepdims=True), 5).toPandas()
    assert len(got) == 60_000
    assert (got["component"] == 1).mean() == pytest.approx(0.7, abs=0.02)
    for j in range(2):
        own = got[got["component"] == j]
        p = (psi[j] / psi[j].sum())[:, :, None] * (omega[j] / omega[j].sum(axis=1, keepdims=True))
        for column, axes in (("locus", (1, 2)), ("context", (0, 2)), ("mutation", (0, 1))):
            want = p.sum(axis=axes) * len(own)
            seen = np.bincount(own[column], minlength=len(want))
            assert ((seen - want) ** 2 / want).sum() < len(want) + 5 * np.sqrt(2 * len(want))


def test_resampling_holds_no_table_of_loci(spark, model, simulated, monkeypatch):
    c = simulated[0]
    frame = type(c.mutations)
    rated = trainer.rates_for(model, c)[0].orderBy("locus").toPandas()
    n, mu = np.stack(rated["n"].to_list()), np.exp(np.stack(rated["logmu"].to_list())) * rated["exposure"].to_numpy()[:, None]
    count, sizes = frame.count, []
    # as many loci as the driver's table had no room for, in about nine blocks, and hot blocks cut into tasks
    monkeypatch.setattr(frame, "count", lambda d: sizes.append(1) or (1_000_001 if "logmu" in d.columns else count(d)))
    monkeypatch.setattr(simulate, "BLOCK_LOCI", 1_000_001 // 9, raising=False)
    monkeypatch.setattr(simulate, "TASK_DRAWS", 500, raising=False)
    got = simulate.resample(model, c, seed=1).mutations.toPandas()
    monkeypatch.undo()
    assert sizes and got.groupby("sample").size().to_dict() == c.mutations.groupBy("sample").count().toPandas().set_index("sample")["count"].to_dict()
    for k in range(2):
        psi = mu[:, [k]] * n * model.state.delta[k]
        own = got[got["component"] == k]
        for column, want in (("locus", psi.sum(axis=1)), ("context", psi.sum(axis=0)), ("mutation", (psi.sum(axis=0)[:, None] * model.state.rho()[k]).sum(axis=0))):
            want = want / want.sum() * len(own)
            seen = np.bincount(own[column], minlength=len(want))
            # chi-square within five standard deviations of its mean
            assert len(own) > 1000 and ((seen - want) ** 2 / np.maximum(want, 1e-9)).sum() < len(want) + 5 * np.sqrt(2 * len(want))


def test_poisson_regression_has_zero_gradient(spark):
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(500, 2)), np.ones(500)]
    t = rng.poisson(np.exp(x @ [0.5, -0.3, 1.0])).astype(float)
    d = spark.createDataFrame([(a.tolist(), [float(b)], [1.0]) for a, b in zip(x, t, strict=True)], "x array<double>, target array<double>, eta array<double>")
    beta = LinearRate(1, 3).fit(d, steps=20).beta[0]
    mu = np.exp(x @ beta)
    assert np.abs((t - mu * t.mean()) @ x).max() < 1e-4
    assert np.allclose(beta[:2], [0.5, -0.3], atol=0.1)


def test_fixed_point_and_prior():
    rng = np.random.default_rng(1)
    phi, w = rng.random((3, 50)), np.ones(50)
    a = np.full(3, 0.5)
    g = core.fixed_point(phi, w, a, np.ones(3), 1e-9, 5000)
    assert g.sum() == pytest.approx(a.sum() + 50)
    samples = rng.dirichlet([2.0, 0.5, 1.0], 4000) * 1e12
    assert np.allclose(trainer.update_alpha(np.ones(3), samples), [2.0, 0.5, 1.0], rtol=0.15)


def test_prior_counts_every_sample(spark):
    rng = np.random.default_rng(2)
    g = {"a": rng.gamma(2.0, 3.0, (25_000, 3)) + 0.01, "b": rng.gamma(1.0, 40.0, (10, 3)) + 0.01}
    rows = [(c, i, x.tolist()) for c, v in g.items() for i, x in enumerate(v)]
    got = trainer.log_shares(spark.createDataFrame(rows, "corpus string, sample long, gamma array<double>"), 3)
    assert {c: n for c, (n, _) in got.items()} == {"a": 25_000, "b": 10}
    for c, v in g.items():
        assert np.allclose(got[c][1], np_dirichlet_expectation(v).mean(axis=0), atol=1e-6)
        assert np.allclose(trainer.fit_alpha(np.ones(3), *got[c]), trainer.update_alpha(np.ones(3), v), rtol=1e-4)


def test_trees_add_to_the_rates_before(spark, simulated):
    """What grown() adds to earlier log rates is what log_rate() gives from scratch, for fits that build on each other."""
    c = simulated[0]
    t = transform().fit(c.features)
    loci = core.locus_table(c, t, c.names())
    counts = c.mutations.groupBy("corpus", "locus").agg(F.array(F.sum("weight"), F.count("*").cast("double")).alias("target"))
    data = loci.join(counts, ["corpus", "locus"], "left").withColumn("target", F.coalesce("target", F.array(F.lit(0.0), F.lit(0.0))))
    data = data.withColumn("eta", F.array("exposure", "exposure"))
    model = BoostedRate(2, 3, 1, rounds=3, depth=2, least=0.5)
    x = np.stack([r["x"] for r in loci.select("x").limit(200).collect()])
    log = model.log_rate(x)
    for rate in (1.0, 0.5):
        shared = model
        before = F.pandas_udf(lambda v, m=shared: pd.Series(list(m.log_rate(np.stack(v.to_list())))), "array<double>")
        model = model.fit(data.withColumn("logmu", before("x")), rate)
        log = model.grown(x, log)
        assert np.allclose(log, model.log_rate(x)) and all(model.trees)
    assert all(v == pytest.approx(w) for v, w in zip(log.mean(axis=0), model.log_rate(x).mean(axis=0), strict=True))


def test_groups_keep_features_apart_in_trees(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = np.exp(0.5 * np.sign(x[:, 0]) + 0.5 * np.sign(x[:, 1]) + 0.4 * x[:, 2] + 0.4 * x[:, 3])
    rows = [("c", i, f"l{i}", *map(float, a), float(v)) for i, (a, v) in enumerate(zip(x, y, strict=True))]
    d = spark.createDataFrame(rows, "corpus string, locus long, name string, a double, b double, p double, q double, y double")
    t = FeatureTransform({c: "standardize" for c in "abpq"}, {"a": ["one"], "p": ["one"], "b": ["two"], "q": ["two"]}).fit(d)
    groups = trainer.feature_groups(t)
    assert sorted(map(sorted, groups)) == [[0, 2], [1, 3]] and trainer.feature_groups(FeatureTransform({"a": "standardize"}).fit(d)) is None
    state = trainer.initial_state(trainer.Options(k=1, model_type="gbt", rate_options={"depth": 3, "rounds": 4, "least": 0.5}), ["c"], np.full(64, 1 / 64), 5, groups)
    data = d.select("corpus", "locus", F.array(*t.columns(), F.lit(1.0)).alias("x"), F.array("y").alias("target"), F.array(F.lit(1.0)).alias("eta"), F.array(F.lit(0.0)).alias("logmu"))
    model = state.rate_model.fit(data)
    used = set()
    for _, tree in model.trees[0]:
        def paths(node, seen, tree=tree):
            if tree.feature[node] < 0:
                used.add(frozenset(seen))
                return
            for child in (tree.left[node], tree.right[node]):
                paths(child, seen | {tree.feature[node]})
        paths(0, set())
    assert used and all(u <= {0, 2} or u <= {1, 3} for u in used)


def test_jobs_of_an_epoch(spark, simulated):
    def jobs(epochs):
        spark.sparkContext.setJobGroup(f"epochs-{epochs}", "")
        trainer.train(simulated[0], transform(), trainer.Options(k=2, epochs=epochs, eval_every=100, seed=3))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"epochs-{epochs}"))

    few, many = jobs(2), jobs(6)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (many - few) / 4 <= 45


def test_component_rates_lay_each_mutation_to_components(model, simulated):
    c = simulated[0]
    got = trainer.component_rates(model, c)
    rows = {(r["corpus"], r["locus"]): sum(r[n] for n in model.state.names) for r in got.collect()}
    want = {(r["corpus"], r["locus"]): r["w"] for r in c.mutations.groupBy("corpus", "locus").agg(F.sum("weight").alias("w")).collect()}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want)


def test_marginal_model(simulated):
    c = simulated[0]
    m = trainer.marginal_model(c, transform(), trainer.Options(rate_options={"rounds": 4, "depth": 2, "least": 0.5}))
    counts = {(r["context"], r["mutation"]): r["w"] for r in c.mutations.groupBy("context", "mutation").agg(F.sum("weight").alias("w")).collect()}
    assert m.state.k == 1 and all(m.state.omega[0, k[0], k[1]] == pytest.approx(v) for k, v in counts.items())
    assert m.state.delta.mean() == pytest.approx(1) and m.state.rate_model.trees[0]
    assert np.isfinite(trainer.mutation_rate_r2(m, c).first()["r2"])


def test_gibbs_shares_of_one_mutation():
    """A single mutation goes to a component by its likelihood: counts + alpha over n - 1 + alpha is one where alpha is all there is."""
    phi, alpha = np.array([[0.2], [0.8]]), np.array([3.0, 1.0])
    got = posterior.gibbs(phi, np.ones(1), alpha, np.random.default_rng(0), 200, 4000)
    # the label drawn weighs (1 + alpha) / alpha more than the other
    stay = [0.2 * 4 / 3 / (0.2 * 4 / 3 + 0.8), 0.8 * 2 / (0.8 * 2 + 0.2)]
    p = (1 - stay[1]) / (2 - stay[0] - stay[1])
    assert got[:, 0] == pytest.approx([p, 1 - p], abs=0.05)


def test_search_keeps_trials(spark, simulated, tmp_path):
    import json

    o, where = trainer.Options(epochs=2, eval_every=1, locus_subsample=0.9), str(tmp_path / "study")
    assert tuning.search(simulated[0], transform(), where, 1, (1, 2), o).count() == 1
    t = tuning.search(simulated[0], transform(), where, 1, (1, 2), o)
    rows = {r["trial"]: r for r in t.collect()}
    assert set(rows) == {0, 1} and rows[0]["params"] != rows[1]["params"] and tuning.best(t).count() == 1 == tuning.best(t, 1).count()
    for r in rows.values():
        assert len(json.loads(r["evaluations"])) == 2 and min(json.loads(r["evaluations"])) == r["value"] and r["r2_train"] <= 1 and r["r2_test"] <= 1


def test_a_trial_without_gain_ends(spark, simulated, tmp_path, monkeypatch):
    import json

    falling = iter([9.0, 5.0, 6.0, 7.0, 5.5, 4.0, 3.0])
    monkeypatch.setattr(trainer, "score", lambda *a: {"perplexity": next(falling)})
    t = tuning.search(simulated[0], transform(), str(tmp_path / "study"), 1, (1, 1), trainer.Options(epochs=7, eval_every=1, bound_tol=0.0), patience=3)
    assert json.loads(t.first()["evaluations"]) == [9.0, 5.0, 6.0, 7.0, 5.5] and t.first()["value"] == 5.0


def test_leaf_order():
    from itertools import product

    v = np.array([[1, 0], [0, 1], [0.9, 0.1], [0.1, 0.9]])
    o = views.leaf_order(v)
    assert {frozenset(o[:2]), frozenset(o[2:])} == {frozenset({0, 2}), frozenset({1, 3})}
    assert views.leaf_order(v[:1]) == [0] and views.leaf_order(v[:0]) == []

    def flips(tree):
        if isinstance(tree, int):
            return [[tree]]
        return [x + y for a, b in (tree, tree[::-1]) for x, y in product(flips(a), flips(b))]

    rng = np.random.default_rng(8)
    for n in (2, 3, 5, 7):
        v = rng.random((n, 4))
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        d = 1 - u @ u.T
        trees = [(i, [i]) for i in range(n)]
        while len(trees) > 1:
            _, i, j = min((d[np.ix_(a[1], b[1])].mean(), i, j) for i, a in enumerate(trees) for j, b in enumerate(trees) if i < j)
            trees = [t for k, t in enumerate(trees) if k not in (i, j)] + [((trees[i][0], trees[j][0]), trees[i][1] + trees[j][1])]
        cost = lambda o: sum(d[a, b] for a, b in zip(o[:-1], o[1:], strict=True))  # noqa: B023, E731
        assert cost(views.leaf_order(v)) == pytest.approx(min(map(cost, flips(trees[0][0]))))


def test_tree_shapley_values_against_all_orders():
    from itertools import permutations

    rng = np.random.default_rng(9)
    tree = Tree()
    left, right = tree.split(0, 1, 3)
    a, b = tree.split(left, 0, 2)
    c, d = tree.split(right, 1, 6)
    e, f = tree.split(a, 2, 4)
    for node in (b, c, d, e, f):
        tree.value[node] = float(rng.normal())
    rows, background = rng.integers(0, 9, (6, 3)), rng.integers(0, 9, (5, 3))
    tables = posterior.shapley_tables(tree, background)
    for x in rows:
        got, want = np.zeros(3), np.zeros(3)
        for features, low, high, table in tables:
            inside = (x[features] > low) & (x[features] <= high)
            got[features] += table[inside @ (1 << np.arange(len(features)))]
        for other in background:
            for p in permutations(range(3)):
                now = other.copy()
                for j in p:
                    was = tree.predict(now[None])[0]
                    now[j] = x[j]
                    want[j] += (tree.predict(now[None])[0] - was) / (6 * len(background))
        assert np.allclose(got, want)
        assert got.sum() == pytest.approx(tree.predict(x[None])[0] - tree.predict(background).mean())


def test_r2_rates_the_loci_once(model, simulated, monkeypatch):
    seen, table = [], core.locus_table
    monkeypatch.setattr(core, "locus_table", lambda *a: seen.append(1) or table(*a))
    assert 0 < trainer.mutation_rate_r2(model, simulated[0]).first()["r2"] < 1 and len(seen) == 1
