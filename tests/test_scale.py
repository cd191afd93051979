"""Steps of training and sampling that grew faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from regionlytics.functions.special import values_below
from regionlytics.model import core, posterior, simulate, split
from regionlytics.model.boosting import BoostedRate
from regionlytics.model.linear import LinearRate
from regionlytics.operators import durable, intervals
from regionlytics.operators.clusters import clusters, local_rate, window_sums
from regionlytics.operators.corpora import Corpus, context_share, unpacked
from regionlytics.operators.nearest import nearest_self
from regionlytics.operators.scaling import FeatureTransform, quantile_rank


def test_locus_table_takes_packed_counts(spark):
    own = F.lit("c").alias("corpus")
    loci = spark.range(6).withColumnRenamed("id", "locus")
    packed = loci.select(own, "locus", F.when(F.col("locus") > 0, F.expr("transform(sequence(0, 9), c -> locus * 10 + c)")).otherwise(F.expr("array(null, 7L)")).alias("n"))
    corpora = [Corpus(None, loci.select(own, "locus", F.lit(1.0).alias("exposure")), t, loci.select(own, "locus", (F.col("locus") * 1.0).alias("f"))) for t in (packed, unpacked(packed))]
    told = [sorted(map(tuple, core.locus_table(c, FeatureTransform({}), ["c"], 16).select("locus", "n").collect())) for c in corpora]
    assert told[0] == told[1] and told[0][0][1] == [0.0, 7.0] + [0.0] * 14 and unpacked(packed).count() == 51
    assert sorted(map(tuple, context_share(packed).collect())) == sorted(map(tuple, context_share(unpacked(packed)).collect()))


def test_sums_by_key_are_those_of_the_rows():
    keys, r = np.array([7, 3, 7, 9]), np.arange(8.0).reshape(4, 2)
    found, sums = core.summed_by(keys, r)
    assert found.tolist() == [3, 7, 9] and sums.tolist() == [[2.0, 3.0], [4.0, 6.0], [6.0, 7.0]]


def test_gibbs_sweeps_take_no_powers_and_draw_the_same_labels(monkeypatch):
    rng = np.random.default_rng(1)
    phi, weight, alpha = rng.random((3, 50)), rng.integers(1, 9, 50) * 1.0, np.array([0.5, 1.0, 2.0])
    phi[0, :4] = 0

    def plain(rng, warm_up=20, sweeps=60):
        with np.errstate(divide="ignore"):
            logs = np.log(phi)
        z, tally = rng.choice(3, 50, p=alpha / alpha.sum()), np.zeros((3, 50))
        for t in range(1, warm_up + sweeps + 1):
            q = logs * min(1.0, t / warm_up) + np.log((np.bincount(z, weights=weight, minlength=3) + alpha) / (49 + alpha))[:, None]
            p = np.exp(q - q.max(axis=0))
            z = (np.cumsum(p, axis=0) > rng.random(50) * p.sum(axis=0)).argmax(axis=0)
            if t > warm_up:
                tally[z, np.arange(50)] += 1
        return tally / sweeps

    want, calls, exp = plain(np.random.default_rng(2)), [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    got = posterior.gibbs(phi, weight, alpha, np.random.default_rng(2), 20, 60)
    assert np.array_equal(got, want) and len(calls) <= 21


def test_quantile_ranks_look_at_few_of_the_quantiles(spark):
    rng = np.random.default_rng(5)
    grid = sorted([0.0] * 7 + [3.0] * 5 + rng.normal(0, 4, 989).tolist())
    x = [None, float("nan"), -0.0, 0.0, 3.0, grid[0], grid[-1], -99.0, 99.0, *rng.normal(0, 4, 300).tolist(), *grid[::50]]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    rows = d.select("x", values_below(grid, F.col("x")).alias("b"), values_below(grid, F.col("x"), True).alias("u"), quantile_rank(F.col("x"), grid).alias("r")).collect()
    for v, b, u, r in rows:
        if v is None:
            assert (b, u, r) == (0, 0, None)
        else:
            assert (b, u) == (np.searchsorted(grid, v), np.searchsorted(grid, v, "right"))
            want = 1.0 if v != v or v >= grid[-1] else 0.0 if v <= grid[0] else (b + u - 1) / 2 / 1000 if u > b else (b - 1 + (v - grid[b - 1]) / (grid[b] - grid[b - 1])) / 1000
            assert r == want
    plan = d.select(quantile_rank(F.col("x"), grid))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and values_below([], F.col("x")) is not None and d.select(values_below([], F.col("x"))).distinct().count() == 1


def test_boosting_reads_groups_of_loci_and_sums_as_over_loci(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 3000
    x = np.stack([rng.integers(0, 3, n), rng.integers(0, 4, n), np.arange(n) % 2, 1 - np.arange(n) % 2], axis=1).astype(float)
    t, e, logmu = rng.integers(0, 5, (n, 2)) * 1.0, rng.random((n, 2)), rng.normal(0, 0.1, (n, 2))
    rows = [("c", i, *(v.tolist() for v in row)) for i, row in enumerate(zip(x, t, e, logmu, strict=True))]
    d = spark.createDataFrame(rows, "corpus string, locus long, x array<double>, target array<double>, eta array<double>, logmu array<double>")
    read, sums = [], BoostedRate._sums
    monkeypatch.setattr(BoostedRate, "_sums", lambda self, data, *a: read.append(data.count()) or sums(self, data, *a))
    bare = BoostedRate(2, 4, 2, rounds=0).fit(d)
    for c in range(2):
        own = x[:, 2 + c] == 1
        assert np.allclose(bare.bias[:, c], np.log(t[own & ~held(spark, n)].sum(axis=0) / (e * np.exp(logmu))[own & ~held(spark, n)].sum(axis=0)))
    model = BoostedRate(2, 4, 2, rounds=2, held_out=0.0).fit(d)
    assert all(model.trees) or not any(model.trees)
    assert max(read) <= 3 * 4 * 2 * 2


def held(spark, n):
    rows = spark.range(n).select("id", (F.pmod(F.xxhash64(F.lit("c"), "id"), F.lit(1000)) < 200).alias("h")).collect()
    return np.array([r["h"] for r in sorted(rows)])


def test_window_sums_make_no_pairs(spark):
    rng = np.random.default_rng(7)
    iv, n = [], 400
    for i in range(n):
        a = int(rng.integers(0, 6000))
        iv.append(("chr1" if i % 3 else "chr2", a, a + int(rng.choice([1, 30, 900])), float(rng.integers(0, 4)) / 10))
    iv += [("chr1", 9000, 9010, 0.0), ("chr1", 9500, 9510, float("nan")), ("chr1", 9800, 9810, float("inf")), ("chr1", 9900, 9905, None), ("chr1", 7000, 7000, 5.0), ("chr1", 100, 9100, 0.3)]
    pos = sorted({*rng.integers(0, 10_200, 300).tolist(), 0, 8950, 8900, 9000, 9060, 9061, 9550, 9850, 9950, 9954, 9955})
    t = spark.createDataFrame(iv, "chrom string, start long, end long, value double")
    places = spark.createDataFrame([(c, p) for p in pos for c in ("chr1", "chr2", "chr3")], "chrom string, pos long")
    pairs = places.withColumns({"s": F.greatest(F.col("pos") - 50, F.lit(0)), "e": F.col("pos") + 50}).join(t, "chrom").where("end > start AND start < e AND s < end")
    want = {(r[0], r[1]): r[2:] for r in pairs.groupBy("chrom", "pos").agg(F.sum("value"), F.sum(F.col("end") - F.col("start"))).collect()}
    sums = window_sums(places.union(places), t, 50, size=64, stretch=512)
    got = {(r[0], r[1]): r[2:] for r in sums.collect()}
    assert got.keys() == want.keys() and sums.count() == len(want)
    for k, (v, length) in want.items():
        assert got[k][1] == length and (got[k][0] == v if v in (None, 0.0) else repr(got[k][0]) == repr(v) if not np.isfinite(v) else abs(got[k][0] - v) < 1e-9), k
    plan = local_rate(places.withColumn("sample", F.lit(1)), t, reach=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "_slot" not in plan


def test_tasks_grow_with_the_rows_of_clusters_neighbours_and_overlaps(spark, monkeypatch):
    monkeypatch.setattr(durable, "TASK_ROWS", 50)
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", 100)
    p = spark.range(1000).selectExpr("id % 40 AS sample", "concat('chr', id % 3) AS chrom", "(id * 7919) % 3000 AS pos", "1e-4 AS rate")
    d = clusters(p, rows=1000)
    plan = d.select("sample", "pos", "cluster", "cluster_size")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and ", 20), REPARTITION_BY_NUM" in plan
    assert "20), REPARTITION_BY_NUM" in nearest_self(p, ["sample", "chrom"])._jdf.queryExecution().executedPlan().toString()
    near = {(r[0], r[1], r[2]): r[3] for r in nearest_self(p, ["sample", "chrom"]).select("sample", "chrom", "pos", "neighbour").collect()}
    assert {(r["sample"], r["chrom"], r["pos"]): r["neighbour"] for r in d.collect()} == near and d.count() == 1000
    a = spark.range(600).selectExpr("id AS i", "'chr1' AS chrom", "id * 50 AS start", "id * 50 + 80 AS end")
    pairs = intervals.overlap_join(a, a)
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 600 + 2 * 599


def test_compositions_of_many_samples_take_few_evaluations(monkeypatch):
    rng = np.random.default_rng(0)
    sizes, k = rng.integers(1, 300, 40), 3
    n, calls, spread = sizes.sum(), [], split.spread
    phi, weight = 0.02 * rng.random((k, n)) + 0.98 * rng.random(n), rng.integers(1, 50, n) * 1.0
    alpha, start = np.full((40, k), 0.7), rng.gamma(100, 0.01, (40, k))
    monkeypatch.setattr(split, "spread", lambda *a: calls.append(1) or spread(*a))
    got = split.found(phi, weight, sizes, alpha, start, 1e-8, 1000)
    assert len(calls) <= 60
    ends = np.cumsum(sizes)
    for i, (a, z) in enumerate(zip(ends - sizes, ends, strict=True)):
        again = alpha[i] + spread(got[[i]], weight[a:z], phi[:, a:z], sizes[[i]])[0][0]
        assert np.abs(again - got[i]).max() < 1e-6
        assert np.allclose(core.fixed_point(phi[:, a:z], weight[a:z], alpha[i], start[i], 1e-8, 1000), got[i], rtol=1e-6)


def test_samples_kept_with_their_cells_give_the_sums_of_samples_inferred_alone(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 900
    sample = np.minimum(rng.integers(0, 12, n), 9)
    rows = [(f"c{s % 2}", int(s), int(a), int(b), int(c), float(w)) for s, a, b, c, w in zip(sample, rng.integers(0, 20, n), rng.integers(0, 64, n), rng.integers(0, 3, n), rng.integers(1, 9, n), strict=True)]
    m = spark.createDataFrame(rows, "corpus string, sample long, locus long, context int, mutation int, weight double")
    loci = [(f"c{i % 2}", i // 2, 1.0 + i / 7, (1.0 + rng.integers(0, 9, 64)).tolist(), rng.normal(size=4).tolist()) for i in range(40)]
    loci = spark.createDataFrame(loci, "corpus string, locus long, exposure double, n array<double>, x array<double>")
    rate = LinearRate(2, 4)
    rate.beta = rng.normal(size=(2, 4))
    state = core.State(rng.random((2, 64, 3)) + 0.1, rng.random((2, 64)) + 0.1, {"c0": np.ones(2), "c1": np.full(2, 0.5)}, ["a", "b"], rate, ["c0", "c1"])
    rated, log_z = core.with_log_rates(loci, state)

    def told(rows):
        gamma = {(r["corpus"], r["sample"]): [*r["value"], r["bound"], r["weight"]] for r in rows if r["kind"] == "gamma"}
        sums = {}
        for r in rows:
            if r["kind"] != "gamma":
                key = r["corpus"], r["kind"], r["key"]
                sums[key] = sums.get(key, 0) + np.array(r["value"])
        return gamma, sums

    want, want_sums = told(core.infer(core.cells(m), rated, log_z, state, tolerance=1e-9).collect())
    monkeypatch.setattr(core, "SIDE_CELLS", 200)
    monkeypatch.setattr(core, "SUM_CELLS", 300)
    for limit in (1 << 30, 100):
        monkeypatch.setattr(split.hot_samples, "__defaults__", (limit, 40))
        cells, hot, packed = core.together(m, loci, 3)
        assert packed.count() == 10 - hot.count() and hot.isEmpty() == (limit > 100)
        assert "Join" not in packed.select("sample")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        gamma, sums = told(core.infer(cells, rated, log_z, state, tolerance=1e-9, hot=hot, packed=packed).collect())
        assert gamma.keys() == want.keys() and all(np.allclose(gamma[k], want[k], rtol=1e-6) for k in want)
        assert sums.keys() == want_sums.keys() and all(np.allclose(sums[k], want_sums[k], rtol=1e-5, atol=1e-6) for k in want_sums)
        only, _ = told(core.infer(cells, rated, log_z, state, tolerance=1e-9, hot=hot, packed=packed, kinds=("gamma",)).collect())
        assert all(np.allclose(only[k], want[k], rtol=1e-6) for k in want)


def test_gibbs_side_by_side_draws_the_labels_of_each_sample_alone(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [40, 1, 17, 60]
    phi, weight = [rng.random((3, n)) for n in sizes], [rng.integers(1, 9, n) * 1.0 for n in sizes]
    phi[2][:, 0] = 0
    alpha = [rng.random(3) + 0.2 for _ in sizes]
    monkeypatch.setattr(posterior, "AHEAD", 700)
    rngs = lambda: [np.random.default_rng(i) for i in range(4)]
    got = posterior.gibbs_side_by_side(phi, weight, alpha, rngs(), 15, 40)
    for i, r in enumerate(rngs()):
        assert np.array_equal(got[i], posterior.gibbs(phi[i], weight[i], alpha[i], r, 15, 40))
        assert got[i].shape == (3, sizes[i]) and np.allclose(got[i].sum(axis=0), 1)


def test_samples_are_told_apart_across_batches(spark, monkeypatch):
    """Whatever the batches and who stands beside: the same shares for each mutation."""
    from regionlytics.functions.special import np_logsumexp
    from regionlytics.model import trainer

    rng = np.random.default_rng(8)
    n = 700
    rows = [(f"c{s % 2}", int(s), "chr1", int(i), int(a), int(b), int(c), 1.0) for i, (s, a, b, c) in enumerate(zip(np.minimum(rng.integers(0, 40, n), 15), rng.integers(0, 20, n), rng.integers(0, 64, n), rng.integers(0, 3, n), strict=True))]
    m = spark.createDataFrame(rows, "corpus string, sample long, chrom string, pos long, locus long, context int, mutation int, weight double")
    loci = spark.createDataFrame([(f"c{i % 2}", i // 2, 1.0, (1.0 + rng.integers(0, 9, 64)).tolist(), rng.normal(size=2).tolist()) for i in range(40)], "corpus string, locus long, exposure double, n array<double>, logmu array<double>")
    state = core.State(rng.random((2, 64, 3)) + 0.1, rng.random((2, 64)) + 0.1, {"c0": np.ones(2), "c1": np.full(2, 0.5)}, ["a", "b"], LinearRate(2, 4), ["c0", "c1"])
    model = trainer.Model(state, FeatureTransform({}), np.ones(64), trainer.Options(k=2))

    def told():
        return {(r["sample"], r["pos"]): (r["logp_a"], r["logp_b"]) for r in posterior.assign(model, Corpus(m, None, None, None), 5, 30, rated=loci).collect()}

    want = told()
    assert len(want) == n and np.allclose(np_logsumexp(np.array(list(want.values())), axis=1), 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        monkeypatch.setattr(posterior, "SIDE", 20)
        assert told() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_draws_travel_as_counts(spark, monkeypatch):
    """Between samples and loci goes a row for each component and block that a sample draws from, not one a draw; the draws agree on every run."""
    rng = np.random.default_rng(2)
    loci = spark.createDataFrame([("c", i, 1.0, rng.integers(0, 9, 64).astype(float).tolist(), rng.normal(size=2).tolist()) for i in range(30)], "corpus string, locus long, exposure double, n array<double>, logmu array<double>")
    cohort = spark.createDataFrame([("c", f"s{i}", 5_000.0 + i, 0.3, 0.7 * (i > 0)) for i in range(4)], "corpus string, sample string, n double, g0 double, g1 double")
    monkeypatch.setattr(simulate, "BLOCK_LOCI", 10)
    monkeypatch.setattr(simulate, "TASK_DRAWS", 3_000)
    seen, frame = [], type(loci)
    through = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda d, f, schema, *a: seen.append(through(d, f, schema, *a)) or seen[-1])
    delta, rho = rng.random((2, 64)) + 0.1, rng.dirichlet(np.ones(3), (2, 64))
    told = lambda parts: sorted(map(tuple, simulate.drawn(loci.repartition(parts), cohort.repartition(parts), delta, rho, 30, 5).collect()))
    got = told(1)
    by_block = [d for d in seen if "times" in d.columns][0]
    assert by_block.count() <= 4 * 2 * 2 * 3 and by_block.agg(F.sum("times")).first()[0] == len(got) == 20_006
    counts = {r[0]: r[1] for r in spark.createDataFrame([(r[1],) for r in got], "s string").groupBy("s").count().collect()}
    assert counts == {f"s{i}": 5_000 + i for i in range(4)} and all(r[2] == 0 for r in got if r[1] == "s0")
    assert got == told(3)


def test_boosted_rates_of_many_rows_evaluate_trees_on_what_differs(monkeypatch):
    from regionlytics.model.boosting import Tree

    rng = np.random.default_rng(9)
    model = BoostedRate(2, 4, 2)
    model.edges, model.bias = [np.array([1.0, 2.0]), np.array([0.5])], rng.normal(size=(2, 2))
    for trees in model.trees:
        for _ in range(3):
            t = Tree()
            for node in t.split(0, int(rng.integers(0, 2)), 0):
                t.value[node] = float(rng.normal())
            trees.append((0.5, t))
    x = np.concatenate([rng.integers(0, 4, (5000, 2)) * 0.9, np.eye(2)[rng.integers(0, 2, 5000)]], axis=1)
    b, sizes, predict = model.binned(x), [], Tree.predict
    want = x[:, 2:] @ model.bias.T + np.stack([sum(r * predict(t, b) for r, t in trees) for trees in model.trees], axis=1)
    monkeypatch.setattr(Tree, "predict", lambda t, b: sizes.append(len(b)) or predict(t, b))
    assert np.allclose(model.log_rate(x), want) and max(sizes) <= 6
    assert core.stays_with_cells(model, 4) and not core.stays_with_cells(BoostedRate(2, 30, 2), 30)
