"""Training by variational EM with optional subsampling; scoring, prediction, storage."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import blend, dirichlet_expectation, learning_rate, np_dirichlet_expectation, np_digamma, np_trigamma
from ..operators import corpora as co
from ..operators.durable import cut
from ..operators.rates import marginal_signature
from ..operators.scaling import FeatureTransform
from . import core, extension, split


@dataclass
class Options:
    k: int = 3
    model_type: str = "linear"
    observation: str | None = None
    epochs: int = 300
    tau: float = 16.0
    kappa: float = 0.5
    pi_prior: float = 1.0
    batch_size: int | None = None
    locus_subsample: float | None = None
    empirical_bayes: bool = False
    begin_prior_updates: int = 10
    eval_every: int = 10
    bound_tol: float = 1e-2
    tolerance: float = 1e-3
    rounds: int = 1000
    time_limit: float | None = None
    seed: int = 1776
    fixed: dict[str, dict[str, float]] = field(default_factory=dict)
    rate_options: dict = field(default_factory=dict)


@dataclass
class Model:
    state: core.State
    transform: FeatureTransform
    genome: np.ndarray
    options: Options
    history: list[dict] = field(default_factory=list)


def log_shares(gamma: DataFrame, k: int) -> dict[str, tuple[int, np.ndarray]]:
    """By corpus, the number of samples of gamma (corpus, sample, gamma array of k) and their mean expected log shares."""
    total = F.aggregate("gamma", F.lit(0.0), lambda s, v: s + v)
    means = [F.avg(dirichlet_expectation(F.get("gamma", F.lit(i)), total)).alias(f"e{i}") for i in range(k)]
    rows = gamma.groupBy("corpus").agg(F.count("*").alias("n"), *means).collect()  # a row per corpus
    return {r["corpus"]: (r["n"], np.array([r[f"e{i}"] for i in range(k)])) for r in rows}


def update_alpha(alpha: np.ndarray, gamma: np.ndarray, floor: float = 0.01, rounds: int = 100) -> np.ndarray:
    """fit_alpha() to the rows of gamma."""
    return fit_alpha(alpha, len(gamma), np_dirichlet_expectation(gamma).mean(axis=0), floor, rounds)


def fit_alpha(alpha: np.ndarray, n: int, logp: np.ndarray, floor: float = 0.01, rounds: int = 100) -> np.ndarray:
    """The Dirichlet prior that fits n samples of mean expected log shares logp best: Newton steps with a line search; the old one if none improves."""

    def value(a):
        from ..functions.special import np_lgamma

        return n * (np_lgamma(a.sum()) - np_lgamma(a).sum() + ((a - 1) * logp).sum())

    best, best_value = alpha, value(alpha)
    for start in (alpha, np.maximum(floor, floor * np.exp(logp - logp.max()))):
        a = start.copy()
        for _ in range(rounds):
            g = n * (np_digamma(a.sum()) - np_digamma(a) + logp)
            q, z = -n * np_trigamma(a), n * np_trigamma(a.sum())
            b = (g / q).sum() / (1 / z + (1 / q).sum())
            step, size, now = -(g - b) / q, 1.0, value(a)
            while size > 1e-4 and value(np.maximum(a + size * step, floor)) < now:
                size /= 2
            new = np.maximum(a + size * step, floor)
            moved, a = np.abs(new - a).sum(), new
            if moved < 1e-3:
                break
        if value(a) > best_value + 1e-9:
            best, best_value = a, value(a)
            break
    return best


def feature_groups(transform: FeatureTransform) -> list[list[int]] | None:
    """The columns of each group of features, which trees keep apart; None if all are in one."""
    at = {n: i for i, n in enumerate(transform.names())}
    groups = transform.group_columns()
    return [[at[n] for n in names] for names in groups.values()] if len(groups) > 1 else None


def initial_state(o: Options, corpora: list[str], genome: np.ndarray, width: int, groups: list[list[int]] | None = None) -> core.State:
    """omega and delta from Gamma(100, 1/100) draws; fixed signatures as strong counts for the first components."""
    kind = extension.observation(o.observation or "sbs")
    if o.fixed and kind.matrix is None:
        raise ValueError(f"signatures of {kind.name} can't be fixed")
    rng = np.random.default_rng(o.seed)
    draw = lambda *s: rng.gamma(100, 1 / 100, s)
    omega, delta = draw(o.k, kind.contexts, kind.mutations), draw(o.k, kind.contexts)
    names = [f"component_{k}" for k in range(o.k)]
    for k, (name, sig) in enumerate(o.fixed.items()):
        if k >= o.k:
            raise ValueError("more fixed signatures than components")
        m = kind.matrix(sig)
        omega[k], delta[k], names[k] = m * 10_000 + 1, m.sum(axis=1) * 10_000 / np.maximum(genome, 1e-12) + 1, name
        delta[k] /= delta[k].mean()
    rate = extension.make_rate(o.model_type, o.k, width, corpora, groups, o.rate_options)
    return core.State(omega, delta, {c: np.full(o.k, float(o.pi_prior)) for c in corpora}, names, rate, corpora)


def genome_frequencies(trinucs: DataFrame, contexts: int = core.CONTEXTS) -> np.ndarray:
    out = np.zeros(contexts)
    for r in co.context_share(trinucs).collect():  # a row per context
        out[r["context"]] = r["share"]
    return out


def rate_targets(rated: DataFrame, stats: DataFrame, state: core.State) -> DataFrame:
    """(corpus, locus, x, target, eta, logmu): responsibilities and exposure x delta . n of each locus, as arrays of K, and its log rates."""
    sums = core.summed(stats, "locus", "corpus", "key", k=state.k).select("corpus", F.col("key").alias("locus"), F.col("value").alias("target"))
    own = core.masses(rated, state.delta, "eta").select("corpus", "locus", "x", "eta", "logmu")
    return own.join(sums, ["corpus", "locus"], "left").select("corpus", "locus", "x", F.coalesce("target", F.array(*[F.lit(0.0)] * state.k)).alias("target"), "eta", "logmu")


def update_delta(state: core.State, eta: dict[str, np.ndarray], signature: dict[tuple[str, int], np.ndarray], rounds: int = 50) -> np.ndarray:
    """delta where each corpus' contexts are a Poisson of delta x corpus effect x context exposure (eta).

    With one corpus that is the ratio of counts to exposure; several corpora alternate both factors.
    """
    out = np.zeros_like(state.delta)
    corpora = sorted(eta)
    for k in range(state.k):
        t = np.stack([signature.get((c, k), np.zeros(state.delta.shape[1])) for c in corpora])
        e = np.stack([eta[c][k] for c in corpora])
        effect = np.ones(len(corpora))
        for _ in range(rounds if len(corpora) > 1 else 1):
            d = (t.sum(axis=0) + 1e-9) / ((effect[:, None] * e).sum(axis=0) + 1e-9)
            effect = (t.sum(axis=1) + 1e-9) / ((d * e).sum(axis=1) + 1e-9)
            effect /= effect.mean()
        out[k] = d / d.mean()
    return out


def fitted_transform(corpus: co.Corpus, transform: FeatureTransform, o: Options) -> FeatureTransform:
    """transform fitted to the corpus' features unless it is already, with categories as the rate model takes them."""
    if transform.constants or not transform.types:
        return transform
    return replace(transform, ordinal=transform.ordinal or extension.rate_kind(o.model_type).ordinal, constants={}).fit(corpus.features)


def train(corpus: co.Corpus, transform: FeatureTransform, o: Options, evaluated: Callable[[Model], bool] | None = None) -> Model:
    """A fitted model. Tables are cut once per epoch, so lost executors cost one epoch at most.

    An epoch infers all samples, sums what the M-step needs from one cut of its result, and rates the
    loci once: without subsampling the next epoch goes on with those rates. evaluated is called with
    the model at each evaluation and ends the training by returning True.
    """
    corpora, kind = corpus.names(), extension.observation(o.observation or corpus.observation())
    extension.check_observations(kind, corpus.mutations, corpus.trinucs)
    o, transform = replace(o, observation=kind.name), fitted_transform(corpus, transform, o)
    loci = cut(core.locus_table(corpus, transform, corpora, kind.contexts))
    full = o.batch_size is None and o.locus_subsample is None
    genome, width = genome_frequencies(corpus.trinucs, kind.contexts), len(transform.names()) + len(corpora)
    state = initial_state(o, corpora, genome, width, feature_groups(transform))
    model, began = Model(state, transform, genome, o), time.time()
    if full and core.stays_with_cells(state.rate_model, width):
        all_cells, hot, packed = core.together(corpus.mutations, loci, kind.mutations)
        packed = cut(packed)  # nothing is dealt out again in an epoch
    else:
        all_cells, packed = cut(core.cells(corpus.mutations)), None
        hot = split.hot_samples(all_cells)
    gamma: DataFrame | None = None
    scores: list[float] = []
    rated, eta = None, {}
    for epoch in range(o.epochs):
        rate = learning_rate(epoch, o.tau, o.kappa, full)
        here, sample_cells = loci, all_cells
        if o.locus_subsample:
            keep = F.pmod(F.xxhash64(F.lit(o.seed + epoch), "locus"), F.lit(100_000)) < int(o.locus_subsample * 100_000)
            here, sample_cells = here.where(keep), sample_cells.where(keep)
        batch_rate = 1.0
        if o.batch_size is not None:
            everyone = all_cells.select("corpus", "sample").distinct()
            n = everyone.count()
            if o.batch_size < n:
                batch_rate = o.batch_size / n
                chosen = co.sample_exactly(everyone, o.batch_size, "corpus", "sample", seed=o.seed + epoch)
                sample_cells = sample_cells.join(F.broadcast(chosen), ["corpus", "sample"], "left_semi")  # batch_size rows
        if rated is None or o.locus_subsample:
            rated = core.log_rates(here, state)
            eta = core.context_exposure(rated, state)
        log_z = core.log_masses(eta, state.delta)
        stats = cut(core.infer(sample_cells, rated, log_z, state, gamma, rate, o.locus_subsample or 1.0, o.tolerance, o.rounds, o.seed, hot, packed))
        new_gamma = stats.where("kind = 'gamma'").select("corpus", "sample", F.col("value").alias("gamma"))
        # with all samples at hand the new ones are those of stats, which are cut already
        gamma = new_gamma if gamma is None or full else cut(new_gamma.unionByName(gamma.join(new_gamma, ["corpus", "sample"], "left_anti")))
        # M-step: rates, context rates, mutation signatures
        scaled = stats.withColumn("value", F.transform("value", lambda v: v / batch_rate)) if batch_rate < 1 else stats
        state.rate_model = extension.fit_rate(state.rate_model, cut(rate_targets(rated, scaled, state)), rate, width)
        omega, per_context = np.zeros_like(state.omega), {}
        for r in core.summed(scaled, "signature", "corpus", "key", k=state.k).collect():  # a row per corpus, context and mutation
            c, m = divmod(r["key"], kind.mutations)
            omega[:, c, m] += r["value"]
            for k in range(state.k):
                per_context.setdefault((r["corpus"], k), np.zeros(kind.contexts))[c] += r["value"][k]
        rated = core.log_rates(rated, state)
        eta = core.context_exposure(rated, state)
        state.delta = blend(state.delta, update_delta(state, eta, per_context), rate)
        state.omega = blend(state.omega, omega + 1e-9, rate)
        if o.empirical_bayes and epoch >= o.begin_prior_updates:
            for c, (n, logp) in log_shares(gamma, state.k).items():
                state.alpha[c] = blend(state.alpha[c], fit_alpha(state.alpha[c], n, logp), rate)
        state.trained_epochs = epoch + 1
        if epoch % o.eval_every == o.eval_every - 1 or epoch == o.epochs - 1:
            p = perplexity(stats) if full else score(model, corpus)["perplexity"]
            scores.append(p)
            model.history.append({"epoch": epoch, "perplexity": p})
            if evaluated is not None and evaluated(model):
                break
            if full and len(scores) > 1 and abs(scores[-2] - scores[-1]) < o.bound_tol * 1e-2 * abs(scores[-2]):
                break
        if o.time_limit and time.time() - began > o.time_limit:
            break
    return model


def perplexity(stats: DataFrame) -> float:
    r = stats.where("kind = 'gamma'").agg(F.sum("bound").alias("b"), F.sum("weight").alias("w")).first()
    return float(np.exp(-r["b"] / r["w"])) if r["w"] else float("nan")


def posterior(model: Model, corpus: co.Corpus, gamma: DataFrame | None = None, rated: DataFrame | None = None, kinds: tuple[str, ...] = core.KINDS) -> DataFrame:
    """infer()'s rows for corpus under a trained model, or those of some kinds; unknown corpora take the mean prior and the intercept of the first."""
    rated, log_z = rates_for(model, corpus, rated)
    o, state = model.options, model.state
    told = (o.tolerance, o.rounds, o.seed)
    if gamma is None and "x" in rated.columns and core.stays_with_cells(state.rate_model, len(model.transform.names()) + len(state.corpora)):
        cells, hot, packed = core.together(corpus.mutations, rated, state.omega.shape[2])
        return core.infer(cells, rated, log_z, state, None, 1.0, 1.0, *told, hot, packed, kinds)
    return core.infer(core.cells(corpus.mutations), rated, log_z, state, gamma, 0.0 if gamma is not None else 1.0, 1.0, *told, kinds=kinds)


def rates_for(model: Model, corpus: co.Corpus, rated: DataFrame | None = None) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The loci of corpus with their log rates under the model, and the log of each component's total mass. rated: those loci, if they are known already."""
    if rated is not None:
        return rated, core.log_masses(core.context_exposure(rated, model.state), model.state.delta)
    return core.with_log_rates(cut(core.locus_table(corpus, model.transform, model.state.corpora, model.state.delta.shape[1])), model.state)


def rate_digest(model: Model) -> str:
    """A digest of what log rates depend on: rate model, transform and the corpora's order."""
    d = json.loads(to_json(model))
    return hashlib.sha256(json.dumps([d["rate"], d["transform"], d["corpora"]], sort_keys=True).encode()).hexdigest()[:24]


def score(model: Model, corpus: co.Corpus, gamma: DataFrame | None = None, rated: DataFrame | None = None) -> dict[str, float]:
    """Bound and perplexity of corpus; with gamma (corpus, sample, gamma) compositions are taken, not inferred."""
    stats = cut(posterior(model, corpus, gamma, rated, ("gamma",)))
    r = stats.where("kind = 'gamma'").agg(F.sum("bound").alias("b")).first()
    return {"bound": float(r["b"] or 0.0), "perplexity": perplexity(stats)}


def predict(model: Model, corpus: co.Corpus, rated: DataFrame | None = None) -> DataFrame:
    """(corpus, sample, one column per component): each sample's composition gamma."""
    g = posterior(model, corpus, rated=rated, kinds=("gamma",)).where("kind = 'gamma'")
    return g.select("corpus", "sample", *[F.get("value", F.lit(i)).alias(n) for i, n in enumerate(model.state.names)])


def component_rates(model: Model, corpus: co.Corpus) -> DataFrame:
    """(corpus, locus, one column per component): the mutations of each locus by the components that they are laid to."""
    sums = core.summed(posterior(model, corpus, kinds=("locus",)), "locus", "corpus", "key", k=model.state.k)
    return sums.select("corpus", F.col("key").alias("locus"), *[F.get("value", F.lit(i)).alias(n) for i, n in enumerate(model.state.names)])


def marginal_model(corpus: co.Corpus, transform: FeatureTransform, o: Options | None = None) -> Model:
    """One component with the corpora's own signature, its rate boosted on the features in a single fit.

    Context rates are mutations over occurrences, mutations within a context their shares; nothing is inferred.
    """
    o = o or Options()
    o = Options(**vars(o) | {"k": 1, "model_type": "gbt"})
    corpora, kind = corpus.names(), extension.observation(o.observation or corpus.observation())
    extension.check_observations(kind, corpus.mutations, corpus.trinucs)
    o, transform = replace(o, observation=kind.name), fitted_transform(corpus, transform, o)
    genome, width = genome_frequencies(corpus.trinucs, kind.contexts), len(transform.names()) + len(corpora)
    state = initial_state(o, corpora, genome, width, feature_groups(transform))
    state.omega = np.full_like(state.omega, 1e-9)
    for r in corpus.mutations.groupBy("context", "mutation").agg(F.sum("weight").alias("w")).collect():  # a row per context and mutation
        state.omega[0, r["context"], r["mutation"]] += r["w"]
    state.delta = np.full_like(state.delta, 1e-12)
    for r in marginal_signature(corpus.mutations, corpus.trinucs).collect():  # a row per context
        state.delta[0, r["context"]] += r["rate"]
    state.delta /= state.delta.mean()
    rated = core.log_rates(cut(core.locus_table(corpus, transform, corpora, kind.contexts)), state)
    sums = corpus.mutations.groupBy("corpus", "locus").agg(F.array(F.sum("weight")).alias("value"))
    stats = sums.select("corpus", F.lit("locus").alias("kind"), F.col("locus").alias("key"), "value")
    state.rate_model = extension.fit_rate(state.rate_model, cut(rate_targets(rated, stats, state)), 1.0, width)
    state.trained_epochs = 1
    return Model(state, transform, genome, o)


def rate_tables(model: Model, corpus: co.Corpus, rated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(corpus, component, locus, logmu) and (component, context, delta), for the plans of operators.rates. rated: the loci with their log rates, if they are known already."""
    rated = rates_for(model, corpus)[0] if rated is None else rated
    rates = rated.select("corpus", "locus", F.posexplode("logmu").alias("component", "logmu"))
    spark = rated.sparkSession
    delta = spark.createDataFrame([(k, c, float(model.state.delta[k, c])) for k in range(model.state.k) for c in range(model.state.delta.shape[1])], "component int, context int, delta double")
    return rates, delta


def locus_rates(model: Model, corpus: co.Corpus, rated: DataFrame | None = None) -> DataFrame:
    """(corpus, locus, one column per component): the share of each component's mutations that the model puts on a locus. A projection of the rated loci."""
    rated, log_z = rates_for(model, corpus, rated)
    z = F.create_map(*[x for c, v in sorted(log_z.items()) for x in (F.lit(c), F.array(*[F.lit(float(y)) for y in v]))])
    own = lambda k: F.array(*[F.lit(float(d)) for d in model.state.delta[k]])
    mass = lambda k: F.aggregate(F.zip_with(own(k), F.col("n"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    at = lambda c, k: F.get(c, F.lit(k))
    out = rated.withColumn("_z", z[F.col("corpus")])
    return out.select("corpus", "locus", *[(F.col("exposure") * mass(k) * F.exp(at("logmu", k) - at("_z", k))).alias(n) for k, n in enumerate(model.state.names)])


def mutation_rate_r2(model: Model, corpus: co.Corpus) -> DataFrame:
    """One row, r2: the pseudo R-squared of the model's marginal rate against context counts."""
    from ..operators import rates as rt

    rated, _ = rates_for(model, corpus)
    rates, delta = rate_tables(model, corpus, rated)
    g = predict(model, corpus, rated)
    w = g.agg(*[F.sum(n).alias(n) for n in model.state.names]).first()
    weights = corpus.mutations.sparkSession.createDataFrame([(k, float(w[n])) for k, n in enumerate(model.state.names)], "component int, w double")
    y = co.empirical_rate(corpus.mutations).select("corpus", "locus", "context", F.col("weight").alias("y"))
    cells = rt.mixed_rates(rates, corpus.trinucs, delta, corpus.loci.select("corpus", "locus", "exposure"), weights, ("corpus",), y)
    return rt.pseudo_r2(cells.withColumn("rate", F.exp("log_rate")), "y", "rate", "n")


def signatures(model: Model, spark: SparkSession) -> DataFrame:
    """(component, label, p): the probabilities of each component over the genome's context frequencies, by the labels of what the model observes."""
    labels = extension.observation(model.options.observation or "sbs").labels
    rows = [(n, label, p) for k, n in enumerate(model.state.names) for label, p in labels(model.state.signature(k, model.genome)).items()]
    return spark.createDataFrame(rows, "component string, label string, p double")


def to_json(model: Model) -> str:
    """A model as text: parameters only, so that loading runs no code."""
    s = model.state
    rate = extension.dump_rate(s.rate_model, len(model.transform.names()) + len(s.corpora))
    t = model.transform
    return json.dumps({
        "omega": s.omega.tolist(), "delta": s.delta.tolist(), "alpha": {c: a.tolist() for c, a in s.alpha.items()}, "names": s.names, "corpora": s.corpora, "epochs": s.trained_epochs, "rate": rate,
        "transform": {"types": t.types, "groups": t.groups, "ordinal": t.ordinal, "constants": t.constants}, "genome": model.genome.tolist(), "options": vars(model.options), "history": model.history,
    })


def from_json(text: str) -> Model:
    d = json.loads(text)
    rate = extension.load_rate(d["rate"])
    state = core.State(np.array(d["omega"]), np.array(d["delta"]), {c: np.array(a) for c, a in d["alpha"].items()}, d["names"], rate, d["corpora"], d["epochs"])
    return Model(state, FeatureTransform(**d["transform"]), np.array(d["genome"]), Options(**d["options"]), d["history"])


def save(model: Model, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(to_json(model),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    return from_json(spark.read.text(path, wholetext=True).first()[0])
