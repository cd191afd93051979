"""Queries that train, apply and simulate models. Their results depend on sums in any order, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import posterior, simulate, trainer
from ..operators.corpora import Corpus, union
from ..operators.durable import cut
from ..operators.scaling import FeatureTransform
from . import fixture as fx
from .interval_queries import query
from .table_queries import corpus


def both(spark, sf) -> Corpus:
    return union([corpus(spark, sf, "c0"), corpus(spark, sf, "c1")])


def features() -> FeatureTransform:
    return FeatureTransform({"p_size": "standardize", "p_retailprice": "standardize"})


#: When training has settled: perplexity changes by less than half a percent in three epochs.
SETTLED = {"eval_every": 3, "bound_tol": 0.5}


#: The linear model of the last tables, which the queries that apply one share: by session and folder, its parameters.
_shared: dict[tuple[str, str], trainer.Model] = {}


def two_corpora(spark, sf) -> Corpus:
    c = both(spark, sf)
    c.mutations = c.mutations.select("corpus", "sample", "chrom", "pos", "locus", "context", "mutation", "weight")
    return c


def fitted(spark, sf, **options) -> tuple[trainer.Model, Corpus]:
    c = two_corpora(spark, sf)
    return trainer.train(c, features(), trainer.Options(k=3, **SETTLED | options)), c


def applied(spark, sf) -> tuple[trainer.Model, Corpus]:
    """The fitted linear model, trained once for the queries of a session that only apply it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _shared:
        _shared.clear()
        _shared[key] = fitted(spark, sf)[0]
    return _shared[key], two_corpora(spark, sf)


@query("em_train")
def em_train(spark, sf):
    model, _ = fitted(spark, sf)
    return trainer.signatures(model, spark)


@query("em_train_gbt")
def em_train_gbt(spark, sf):
    model, _ = fitted(spark, sf, model_type="gbt")
    return trainer.signatures(model, spark)


@query("predict_gamma")
def predict_gamma(spark, sf):
    model, c = applied(spark, sf)
    return trainer.predict(model, c)


@query("model_r2")
def model_r2(spark, sf):
    model, c = applied(spark, sf)
    return trainer.mutation_rate_r2(model, c)


@query("gibbs_posterior")
def gibbs_posterior(spark, sf):
    model, c = applied(spark, sf)
    return posterior.assign(model, c)


@query("explain_component")
def explain_component(spark, sf):
    model, c = applied(spark, sf)
    return posterior.explain(model, c, 0)


@query("component_rates", fx.sql("select corpus, locus, round(sum(weight), 3) as total, true as shared from snvs group by corpus, locus", "snvs"))
def component_rates(spark, sf):
    """Mutations of each locus by the component that they are laid to: that they add up to the locus' own, none below zero."""
    model, c = applied(spark, sf)
    names = model.state.names
    r = trainer.component_rates(model, c)
    return r.select("corpus", "locus", F.round(sum((F.col(n) for n in names), F.lit(0.0)), 3).alias("total"), (F.least(*names) >= 0).alias("shared"))


@query("locus_rates", fx.sql("select c.corpus, k.range::int as component, (select count(*) from part) as loci, 1.0::double as mass from (values ('c0'), ('c1')) c(corpus), range(3) k", "loci"))
def locus_rates(spark, sf):
    """The densities over loci that the fitted model gives each component: how many loci they cover, and that each adds up to one."""
    model, c = applied(spark, sf)
    r = trainer.locus_rates(model, c)
    entries = F.posexplode(F.array(*model.state.names)).alias("component", "v")
    return r.select("corpus", entries).groupBy("corpus", "component").agg(F.count("v").alias("loci"), F.round(F.sum("v"), 6).alias("mass"))


@query("marginal_model", fx.sql(""", w as (select context, mutation, sum(weight) as w from snvs group by 1, 2), n as (select context, 2 * sum(n) as n from trinucs group by 1), c as (select context, sum(w) / any_value(n) as r from w join n using (context) group by 1)
select context, mutation, round(r / (select sum(r) / 64 from c), 6) as context_rate, round(w / sum(w) over (partition by context), 6) as share from w join c using (context)""", "snvs", "trinucs"))
def marginal_model(spark, sf):
    """The one signature of the marginal model, whose rate is boosted on size and price: rates of contexts over their mean, and shares of mutations."""
    model = trainer.marginal_model(two_corpora(spark, sf), features())
    delta, rho = model.state.delta[0], model.state.rho()[0]
    rows = [(c, m, round(float(delta[c]), 6), round(float(rho[c, m]), 6)) for c in range(64) for m in range(3) if rho[c, m] > 1e-9]
    return spark.createDataFrame(rows, "context int, mutation int, context_rate double, share double")


def _regression(spark, sf):
    """The loci with design and targets, the fitted regressions and their scales."""
    from ..model import linear

    m = fx.mutations(spark, sf).groupBy("locus").pivot("corpus", ["c0", "c1"]).agg(F.sum("weight")).na.fill(0.0)
    x = F.array((F.col("p_size") / 50).cast("double"), (F.col("p_retailprice") / 2000).cast("double"), F.lit(1.0))
    t = cut(fx.loci(spark, sf).join(m, "locus", "left").na.fill(0.0, ["c0", "c1"]).select(x.alias("x"), F.array("c0", "c1").alias("target"), F.array("exposure", "exposure").alias("eta")))
    return t, linear.LinearRate(2, 3).fit(t, steps=20, tolerance=1e-10), linear._means(t, 2)


@query("poisson_irls")
def poisson_irls(spark, sf):
    """Coefficients of the loci's mutation counts on size and price, one regression per corpus."""
    _, model, _ = _regression(spark, sf)
    return spark.createDataFrame([(f"c{k}", j, float(model.beta[k, j])) for k in range(2) for j in range(3)], "corpus string, feature int, beta double")


@query("simulate_corpus", "select l_suppkey as sample, count(*) as n, count(*) as placed, (select count(*) from part)::bigint as loci from lineitem group by l_suppkey")
def simulate_corpus(spark, sf):
    """As many loci as there are parts, and as many mutations of each sample as it has rows: how many were drawn, and how many of them on a locus."""
    parts = fx.read(spark, sf, "part").count()
    cohort = fx.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.count("*").alias("n"))
    c, truth = simulate.simulate(spark, simulate.SimulationConfig(n_loci=parts, seed=1), cohort)
    on_locus = F.col("locus").between(0, parts - 1) & F.col("context").between(0, 63) & F.col("mutation").between(0, 2) & F.col("component").between(0, 2)
    loci = F.lit(c.loci.join(truth["states"], "locus").count())
    return c.mutations.groupBy("sample").agg(F.count("*").alias("n"), F.count_if(on_locus).alias("placed")).withColumn("loci", loci.cast("long"))


@query("poisson_score", fx.sql(""", m as (select locus, corpus, sum(weight) as y from snvs group by locus, corpus),
x as (select c.corpus, j.j::int as feature, case j.j when 0 then l.p_size / 50 when 1 then l.p_retailprice / 2000 else 1.0 end as x, coalesce(m.y, 0) as y
  from loci l cross join (values ('c0'), ('c1')) c(corpus) cross join (values (0), (1), (2)) j(j) left join m on m.locus = l.locus and m.corpus = c.corpus)
select corpus, feature, round(sum(x * y), 2) as observed, round(sum(x * y), 2) as fitted from x group by corpus, feature""", "loci", "snvs"))
def poisson_score(spark, sf):
    """What the regressions of poisson_irls settle: per feature the counts' sum and that of the fitted rates, equal at the maximum."""
    t, model, scale = _regression(spark, sf)
    rows = []
    for k in range(2):
        eta = sum((F.get("x", F.lit(j)) * float(model.beta[k, j]) for j in range(3)), F.lit(0.0))
        mu = F.get("eta", F.lit(k)) * float(scale[k]) * F.exp(eta)
        sums = [F.struct(F.lit(f"c{k}").alias("corpus"), F.lit(j).alias("feature"), F.round(F.sum(F.get("x", F.lit(j)) * F.get("target", F.lit(k))), 2).alias("observed"), F.round(F.sum(F.get("x", F.lit(j)) * mu), 2).alias("fitted")) for j in range(3)]
        rows.append(t.agg(F.array(*sums).alias("r")))
    return rows[0].unionByName(rows[1]).select(F.explode("r").alias("r")).select("r.*")


@query("resample_corpus", fx.sql("select corpus, sample, round(sum(weight))::bigint as n from snvs group by corpus, sample", "snvs"))
def resample_corpus(spark, sf):
    model, c = applied(spark, sf)
    return simulate.resample(model, c).mutations.groupBy("corpus", "sample").agg(F.count("*").alias("n"))
