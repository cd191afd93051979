"""Simulated corpora, from parameters or from a fitted model, and how well a model recovers them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.sequence import signature_matrix
from ..operators.corpora import Corpus
from ..operators.durable import cut
from . import core
from .linear import stacked


@dataclass
class SimulationConfig:
    corpus_name: str = "simulated"
    seed: int = 0
    n_cells: int = 50
    log_mean_mutations: float = 5.0
    log_std_mutations: float = 1.0
    n_loci: int = 1000
    mutation_rate_noise: float = 0.1
    pi_prior: np.ndarray | None = None
    transition: np.ndarray | None = None
    beta: np.ndarray | None = None
    trinucleotide_priors: np.ndarray | None = None
    signal_means: np.ndarray | None = None
    signal_std: np.ndarray | None = None
    exposures: np.ndarray | DataFrame | None = None
    signatures: dict[str, dict[str, float]] = field(default_factory=dict)
    rate_function: object = None


def synthetic_signatures(k: int, seed: int = 0, sharpness: float = 0.1) -> dict[str, dict[str, float]]:
    """k signatures drawn from a sparse Dirichlet over the 96 labels."""
    from ..functions.sequence import cosmic_order

    rng = np.random.default_rng(seed)
    return {f"S{i + 1}": dict(zip(cosmic_order(), rng.dirichlet(np.full(96, sharpness)).tolist(), strict=True)) for i in range(k)}


#: Loci that one task simulates at a time, a power of two.
BLOCK_STATES = 4096


def ladder(transition: np.ndarray, size: int) -> list[np.ndarray]:
    """The transition matrix to the powers 1, 2, 4, ..., size, which is a power of two."""
    out = [np.asarray(transition, float)]
    while 1 << (len(out) - 1) < size:
        out.append(out[-1] @ out[-1])
    return out


def _chosen(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row of p, weights, the index that u, uniform draws, fall on."""
    cum = np.cumsum(p, axis=-1)
    return (cum <= u[..., None] * cum[..., -1:]).sum(axis=-1).clip(max=p.shape[-1] - 1)


def block_ends(step: np.ndarray, blocks: int, rng: np.random.Generator) -> np.ndarray:
    """blocks + 1 states: that of the chain, which starts in 0, at each block's begin and at the last one's end. step is the transition over a block."""
    out, u = np.zeros(blocks + 1, np.int64), rng.random(blocks)
    for i in range(blocks):
        out[i + 1] = _chosen(step[out[i]], u[i : i + 1])[0]
    return out


def bridge(powers: list[np.ndarray], first: int, last: int, rng: np.random.Generator) -> np.ndarray:
    """The states of a block that begins in first, given that the next one begins in last: middles between what is known, until all are."""
    size = 1 << (len(powers) - 1)
    path = np.zeros(size + 1, np.int64)
    path[0], path[size] = first, last
    for level in range(len(powers) - 2, -1, -1):
        half = 1 << level
        left, right = path[: -1 : 2 * half], path[2 * half :: 2 * half]
        path[half :: 2 * half] = _chosen(powers[level][left] * powers[level][:, right].T, rng.random(len(left)))
    return path[:-1]


def simulate(spark: SparkSession, c: SimulationConfig, cohort: DataFrame | None = None) -> tuple[Corpus, dict]:
    """A corpus and the parameters behind it. Loci are simulated in blocks where they lie, mutations by resample()'s draws.

    The driver draws the state at each block's end, by the transition over a block; a block draws the
    states between, and its loci's signals and context counts, from a seed of its own. cohort
    (sample, n) says how many mutations each sample has; without it n_cells samples of log-normal
    sizes are drawn. truth has arrays of the size of components and contexts, and the table ``states``.
    """
    rng = np.random.default_rng(c.seed)
    sigs = c.signatures or synthetic_signatures(3, c.seed)
    k = len(sigs)
    transition = np.array([[0.9, 0.1], [0.1, 0.9]]) if c.transition is None else np.asarray(c.transition, float)
    s = len(transition)
    means = np.full(s, 2.0) if c.signal_means is None else np.asarray(c.signal_means, float)
    stds = np.full(s, 1.0) if c.signal_std is None else np.asarray(c.signal_std, float)
    beta = rng.normal(0, 0.5, (k, s)) if c.beta is None else np.asarray(c.beta, float)
    priors = np.full((s, 64), 10.0) if c.trinucleotide_priors is None else np.asarray(c.trinucleotide_priors, float)
    if priors.shape != (s, 64):
        raise ValueError(f"trinucleotide priors must be {s} x 64, not {priors.shape}")
    exposures, c = c.exposures, replace(c, exposures=None)  # tasks get c
    powers = ladder(transition, BLOCK_STATES)
    size, blocks = BLOCK_STATES, -(-c.n_loci // BLOCK_STATES)
    shared = spark.sparkContext.broadcast((powers, block_ends(powers[-1], blocks, rng)))

    def loci_of(batches):
        ladder_, ends = shared.value
        for pdf in batches:
            for b in pdf["id"]:
                r = np.random.default_rng([c.seed, 1, int(b)])
                states = bridge(ladder_, ends[b], ends[b + 1], r)
                signals = means * (states[:, None] == np.arange(s)) + stds * r.normal(size=(size, s))
                share = r.gamma(priors[states])
                counts = r.poisson(share / share.sum(axis=1, keepdims=True) * 1000)
                here = slice(0, min(size, c.n_loci - int(b) * size))
                yield pd.DataFrame({"locus": int(b) * size + np.arange(size)[here], "state": states[here], "signals": list(signals[here]), "n": list(counts[here].astype(float)), "noise": c.mutation_rate_noise * r.normal(size=size)[here]})

    parts = min(max(1, blocks), int(spark.conf.get("spark.sql.shuffle.partitions")))
    raw = cut(spark.range(0, blocks, 1, parts).mapInPandas(loci_of, "locus long, state int, signals array<double>, n array<double>, noise double"))
    of = lambda column, i: F.get(column, F.lit(i))
    told = raw.agg(*[F.avg(of("signals", i)).alias(f"m{i}") for i in range(s)], *[F.stddev_pop(of("signals", i)).alias(f"d{i}") for i in range(s)], *[F.sum(of("n", x)).alias(f"n{x}") for x in range(64)]).first()
    centre, spread = (np.array([told[f"{x}{i}"] or 0.0 for i in range(s)]) for x in "md")
    omega = np.stack([signature_matrix(x) for x in sigs.values()])
    delta = omega.sum(axis=2) / np.maximum([told[f"n{x}"] or 0.0 for x in range(64)], 1)
    name = F.lit(c.corpus_name).alias("corpus")
    known = raw.withColumn("signals", F.array(*[(of("signals", i) - F.lit(float(centre[i]))) / F.lit(float(max(spread[i], 1e-12))) for i in range(s)]))
    if exposures is None:
        known = known.withColumn("exposure", F.lit(1.0))
    else:
        given = exposures if isinstance(exposures, DataFrame) else spark.createDataFrame(pd.DataFrame({"locus": np.arange(c.n_loci), "exposure": np.asarray(exposures, float)}))
        known = known.join(given.select("locus", F.col("exposure").cast("double")), "locus")

    def rates_of(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["signals"].to_list())
                log_rate = c.rate_function(x) if c.rate_function else beta @ x.T + pdf["noise"].to_numpy()
                yield pdf[["locus", "exposure", "n"]].assign(logmu=list(np.ascontiguousarray(np.asarray(log_rate).T)))

    rated = known.select("locus", "exposure", "n", "signals", "noise").mapInPandas(rates_of, "locus long, exposure double, n array<double>, logmu array<double>").select(name, "*")
    prior = np.ones(k) if c.pi_prior is None else np.asarray(c.pi_prior, float)

    def people(batches):
        for pdf in batches:
            out = []
            for sample, n in zip(pdf["sample"], pdf["n"], strict=True):
                r = np.random.default_rng([c.seed, *str(sample).encode()])
                pi = r.dirichlet(prior)
                out.append([sample, max(1, int(r.lognormal(c.log_mean_mutations, c.log_std_mutations))) if n < 0 else n, *pi])
            if out:
                yield pd.DataFrame(out, columns=["sample", "n", *[f"g{i}" for i in range(k)]])

    cohort = spark.range(c.n_cells).select(F.col("id").alias("sample"), F.lit(-1.0).alias("n")) if cohort is None else cohort.select("sample", F.col("n").cast("double").alias("n"))
    kind = cohort.schema["sample"].dataType.simpleString()
    cohort = cohort.mapInPandas(people, f"sample {kind}, n double, " + ", ".join(f"g{i} double" for i in range(k))).select(name, "*")
    m = drawn(rated, cohort, delta, omega / omega.sum(axis=2, keepdims=True), c.n_loci, c.seed)
    tri = known.select(name, "locus", F.posexplode("n").alias("context", "n"))
    feats = known.select(name, "locus", *[of("signals", i).alias(f"signal_{i}") for i in range(s)])
    truth = {"omega": omega, "delta": delta, "beta": beta, "states": raw.select("locus", "state"), "names": list(sigs)}
    return Corpus(placed(m), known.select(name, "locus", "exposure"), tri, feats), truth


def placed(m: DataFrame) -> DataFrame:
    """Draws (corpus, sample, component, locus, context, mutation) as mutations, each at its locus' first base."""
    return m.select("corpus", "sample", F.lit("chr1").alias("chrom"), (F.col("locus") * 10_000).alias("pos"), "locus", "context", "mutation", F.lit(0).alias("attribute"), F.lit(1.0).alias("weight"), "component")


#: Loci whose masses one task of resampling holds, and draws that it makes, about.
BLOCK_LOCI, TASK_DRAWS = 4096, 500_000


def _pick(cum: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each u in [0, 1) the index of cum, running sums, that it falls on; never one without mass."""
    i = np.searchsorted(cum, u * cum[-1], side="right")
    return np.minimum(i, np.searchsorted(cum, cum[-1]))


def _shares(rng: np.random.Generator, n: int, mass: np.ndarray) -> np.ndarray:
    """How many of n draws fall on each entry of mass; none on one without mass."""
    out, some = np.zeros(len(mass), np.int64), np.flatnonzero(mass > 0)
    if len(some):
        out[some] = rng.multinomial(n, mass[some] / mass[some].sum())
    else:
        out[0] = n
    return out


def _ordered(rng: np.random.Generator, n: int) -> np.ndarray:
    """n uniform draws in ascending order, from the gaps between them."""
    u = np.cumsum(rng.standard_exponential(n + 1))
    return u[:-1] / u[-1]


def drawn(rated: DataFrame, cohort: DataFrame, delta: np.ndarray, rho: np.ndarray, n_loci: int, seed: int = 0) -> DataFrame:
    """(corpus, sample, component, locus, context, mutation): n draws of each row of cohort (corpus, sample, n, g0, g1, ...), g being weights of components.

    How many mutations fall on each component and block of loci is drawn where the sample is, from masses summed by
    block; their loci, contexts and mutations where the block's loci (rated: corpus, locus, exposure, n,
    logmu) are. So the driver holds K sums per block, a task one block or about TASK_DRAWS draws, and what goes
    between them are counts by sample, component and block.
    """
    spark, k = rated.sparkSession, len(delta)
    blocks = max(1, -(-n_loci // BLOCK_LOCI))
    rated = rated.select("corpus", "locus", "exposure", "n", "logmu", F.pmod(F.xxhash64("locus"), F.lit(blocks)).cast("int").alias("block"))

    def weigh(batches):
        for rows in batches:
            if len(rows):
                m = (stacked(rows.column("n")) @ delta.T) * np.exp(stacked(rows.column("logmu"))) * rows.column("exposure").to_numpy()[:, None]
                yield pa.RecordBatch.from_pydict({"corpus": rows.column("corpus"), "block": rows.column("block")} | {f"m{i}": np.ascontiguousarray(v) for i, v in enumerate(m.T)})

    masses = rated.mapInArrow(weigh, "corpus string, block int, " + ", ".join(f"m{i} double" for i in range(k)))
    masses = masses.groupBy("corpus", "block").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(k)]).toPandas()  # a row per block
    sizes = {r["corpus"]: r["n"] for r in cohort.groupBy("corpus").agg(F.sum("n").alias("n")).collect()}  # a row per corpus
    table, split = {}, []
    for c, own in masses.sort_values("block").groupby("corpus"):
        m = own[[f"m{i}" for i in range(k)]].to_numpy()
        # a block with more draws than a task makes is held by several tasks, so hot loci are spread
        most = (m / np.maximum(m.sum(axis=0), core.TINY)).max(axis=1) * float(sizes.get(c, 0))
        tasks = np.maximum(1, np.ceil(most / TASK_DRAWS)).astype(int)
        table[c] = (own["block"].to_numpy(), m, tasks)
        split += [(c, int(x), int(t)) for x, t in zip(own["block"], tasks, strict=True) if t > 1]
    shared = spark.sparkContext.broadcast(table)

    def draw(batches):
        for rows in batches:
            for i in range(len(rows)):
                r = {c: rows.column(c)[i].as_py() for c in rows.schema.names if c != "sample"}
                sample = rows.column("sample")[i]
                ids, mass, tasks = shared.value[r["corpus"]]
                rng, out = np.random.default_rng([seed, *([int(r["part"])] if r["part"] else []), *str(sample.as_py()).encode()]), []
                for j, n in enumerate(_shares(rng, int(r["draws"]), np.array([r[f"g{i}"] for i in range(k)], float))):
                    times = _shares(rng, n, mass[:, j])
                    at = np.flatnonzero(times)
                    out.append((np.full(len(at), j, np.int32), ids[at].astype(np.int32), rng.integers(tasks[at]).astype(np.int32), times[at]))
                component, block, task, times = (np.concatenate(x) for x in zip(*out, strict=True))
                same = {"corpus": pa.repeat(rows.column("corpus")[i], len(times)), "sample": pa.repeat(sample, len(times)), "part": pa.repeat(rows.column("part")[i], len(times))}
                yield pa.RecordBatch.from_pydict(same | {"component": component, "block": block, "task": task, "times": times})

    def place(key, draws, loci):  # of tables; Spark refuses hints on some of the arguments
        if not len(draws):
            return pa.table({c: pa.array([], t) for c, t in fields.items()})
        draws = draws.sort_by([(c, "ascending") for c in ("component", "sample", "part")])
        loci = loci.sort_by("locus")
        ids, n = loci["locus"].to_numpy(), stacked(loci["n"].combine_chunks())
        rates = np.exp(stacked(loci["logmu"].combine_chunks())) * loci["exposure"].to_numpy()[:, None]
        rng = np.random.default_rng([seed, 1, key[1].as_py(), key[2].as_py(), *key[0].as_py().encode()])
        component, times, out = draws["component"].to_numpy(), draws["times"].to_numpy(), []
        for j in np.unique(component):
            own = np.flatnonzero(component == j)
            # whose a draw is doesn't tell where it falls: places come in order, samples are shuffled
            who = rng.permutation(np.repeat(own, times[own]))
            at, context = np.divmod(_pick(np.cumsum(n * delta[j] * rates[:, [j]]), _ordered(rng, len(who))), n.shape[1])
            cum, u = np.cumsum(rho[j], axis=1), rng.random(len(who))
            u *= cum[context, -1]
            mutation = sum(((cum[:, i][context] <= u).astype(np.int32) for i in range(cum.shape[1] - 1)), np.zeros(len(who), np.int32))
            out.append((who, np.full(len(who), j, np.int32), ids[at].astype(np.int64), context.astype(np.int32), mutation))
        who, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"corpus": pa.repeat(key[0], len(who)), "sample": draws["sample"].combine_chunks().take(pa.array(who))} | dict(zip(("component", "locus", "context", "mutation"), rest, strict=True)))

    # a sample of more draws than a task makes is drawn by several: they don't depend on each other
    n = F.round("n").cast("long")
    parts = F.greatest(F.lit(1), F.ceil(n / TASK_DRAWS)).cast("int")
    dealt = cohort.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("draws", F.floor(n / parts) + (F.col("part") < F.pmod(n, parts)).cast("long"))
    kind = cohort.schema["sample"].dataType.simpleString()
    fields = {"corpus": pa.string(), "sample": to_arrow_type(cohort.schema["sample"].dataType), "component": pa.int32(), "locus": pa.int64(), "context": pa.int32(), "mutation": pa.int32()}
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "corpus", "sample", "part")
    by_block = dealt.mapInArrow(draw, f"corpus string, sample {kind}, part int, component int, block int, task int, times long")
    tasks = spark.createDataFrame(split, "corpus string, block int, tasks int")
    held = rated.join(F.broadcast(tasks), ["corpus", "block"], "left").withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    key = ("corpus", "block", "task")
    # dealt out by number, which AQE keeps: counts are few for the draws that they stand for
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(int(t.sum()) for _, _, t in table.values()) // 4)
    by_block, held = by_block.repartition(parts, *key), held.repartition(parts, *key)
    return by_block.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(place, f"corpus string, sample {kind}, component int, locus long, context int, mutation int")


def resample(model, corpus: Corpus, seed: int = 0, components: list[str] | None = None) -> Corpus:
    """A corpus as large as corpus, drawn sample by sample from the fitted model with each sample's composition, of the components named."""
    from .trainer import predict, rates_for

    rated, _ = rates_for(model, corpus)
    names = model.state.names
    total = corpus.mutations.groupBy("corpus", "sample").agg(F.sum("weight").alias("n"))
    weights = [(F.col(f"`{n}`") if components is None or n in components else F.lit(0.0)).alias(f"g{i}") for i, n in enumerate(names)]
    cohort = cut(predict(model, corpus, rated).join(total, ["corpus", "sample"]).select("corpus", "sample", "n", *weights))  # a row a sample, read twice
    m = drawn(rated, cohort, model.state.delta, model.state.rho(), rated.count(), seed)
    return Corpus(placed(m), corpus.loci, corpus.trinucs, corpus.features)


def recovery(model, truth: dict) -> dict[str, float]:
    """Mean best cosine of true signatures, and mean best L1 distance of true coefficients (linear models)."""
    found = np.stack([model.state.signature(k, model.genome).ravel() for k in range(model.state.k)])
    true = truth["omega"].reshape(len(truth["omega"]), -1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit(true) @ unit(found).T
    out = {"signature_cosine": float(cos.max(axis=1).mean())}
    if model.state.rate_model.kind == "linear":
        b = model.state.rate_model.beta[:, : truth["beta"].shape[1]]
        out["coefficient_l1"] = float(np.abs(truth["beta"][:, None, :] - b[None]).sum(axis=2).min(axis=1).mean())
    return out
