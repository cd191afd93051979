"""Rate plans: trinucs packed or not, one row a locus, and no operator that holds all contexts of all loci."""

from pyspark.sql import functions as F

from regionlytics.operators import rates as rt
from regionlytics.plans import fixture as fx
from regionlytics.plans import registry

SF = "/root/testdata/sf0.001"


def tables(spark):
    loci = fx.loci(spark, SF).where("locus % 5 = 0")
    return fx.rates(spark, SF), fx.packed_trinucs(spark, SF), fx.deltas(spark), loci.select("locus", "exposure")


def rounded(df, *keys):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_packed_trinucs_give_the_same_rates(spark):
    rates, packed, delta, exposure = tables(spark)
    long = fx.trinucs(spark, SF)
    for f in (rt.psi, rt.log_denominator):
        assert rounded(f(rates, packed, delta, exposure)) == rounded(f(rates, long, delta, exposure))
    assert rounded(rt.context_exposure(rates, packed, exposure)) == rounded(rt.context_exposure(rates, long, exposure))
    by_locus = rt.psi(rates, packed, delta, exposure).groupBy("component", "locus").agg(F.sum("psi").alias("psi"))
    assert rounded(by_locus) == rounded(rt.psi(rates, packed, delta, exposure, use_context=False).select("component", "locus", "psi"))


def test_mixed_rates_are_the_mixture_of_psi_and_r2_that_of_the_deviances(spark):
    rates, trinucs, delta, exposure = tables(spark)
    w = spark.createDataFrame([(0, 1.0), (1, 3.0)], "component int, w double")
    y = fx.mutations(spark, SF).groupBy("locus", "context").agg(F.sum("weight").alias("y"))
    mixed = rt.mixed_rates(rates, trinucs, delta, exposure, w, counts=y)
    assert rounded(mixed.select("locus", "context", "log_rate")) == rounded(rt.marginal_mixture(rt.psi(rates, trinucs, delta, exposure), w).select("locus", "context", "log_rate"))
    cells = mixed.withColumn("rate", F.when(F.col("context") != 7, F.exp("log_rate")).otherwise(0.0)).persist()
    assert cells.where("y > 0").count() == y.join(exposure, "locus").count()
    a, b = (rt.deviance(cells, "y", c).first()[0] for c in ("rate", "n"))
    assert abs(rt.pseudo_r2(cells, "y", "rate", "n").first()[0] - (1 - a / b)) < 1e-9


def test_bound_of_mutations_is_that_of_their_cells(spark):
    t = fx.mutations(spark, SF), fx.rates(spark, SF), fx.deltas(spark), fx.signatures(spark)
    gamma = rt.one_step_gamma(*t).persist()
    assert rounded(rt.evidence_bound_of(*t, gamma).select("corpus", "sample", F.round("bound", 4), "weight")) == rounded(rt.evidence_bound(rt.cell_likelihoods(*t), gamma).select("corpus", "sample", F.round("bound", 4), "weight"))


def test_contexts_are_dealt_out_and_never_broadcast_or_sorted(spark):
    assert fx.trinucs(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("context_exposure", "marginal_mixture", "estep_single"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and not any("BroadcastExchange" in a and "Generate" in b for a, b in zip(plan.split("\n"), plan.split("\n")[1:], strict=False))
