"""Tables and per-sample inference of the mixed-membership model.

The parameters fit in one driver array each: omega K x 64 x 3, delta K x 64 (or what else a kind of
observation declares), alpha K per corpus. What
grows with the genome or the cohort stays in tables: a row per locus holds its context counts,
transformed features and log rates as arrays; a row per cell of a sample (locus, context, mutation)
holds its summed weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.special import dirichlet_bound, np_dirichlet_expectation
from ..operators.corpora import Corpus, packed
from ..operators.durable import cut, dealt, small_or_shuffled
from ..operators.scaling import FeatureTransform
from . import split
from .linear import stacked

CONTEXTS = 64
TINY = 1e-30
#: The kinds of rows that inference yields.
KINDS = ("gamma", "signature", "locus")


@dataclass
class State:
    """The parameters of a model; names of components; beta belongs to the rate model."""

    omega: np.ndarray
    delta: np.ndarray
    alpha: dict[str, np.ndarray]
    names: list[str]
    rate_model: object = None
    corpora: list[str] = field(default_factory=list)
    trained_epochs: int = 0

    @property
    def k(self) -> int:
        return len(self.omega)

    def rho(self) -> np.ndarray:
        return self.omega / self.omega.sum(axis=2, keepdims=True)

    def component(self, name: str | int) -> int:
        """The number of a component, by name or number."""
        if isinstance(name, int) or str(name).isdigit() and name not in self.names:
            if not 0 <= int(name) < self.k:
                raise ValueError(f"component {name} is out of range")
            return int(name)
        if name not in self.names:
            raise ValueError(f"no component {name}; there are {self.names}")
        return self.names.index(name)

    def signature(self, k: int, genome: np.ndarray | None = None) -> np.ndarray:
        """64 x 3 probabilities of component k over the genome's context frequencies."""
        share = self.delta[k] * (genome if genome is not None else 1.0)
        return (share / share.sum())[:, None] * self.rho()[k]


def locus_table(corpus: Corpus, transform: FeatureTransform, corpora: list[str], contexts: int = CONTEXTS) -> DataFrame:
    """(corpus, locus, exposure, n array of contexts, x array of features and corpus indicators)."""
    if packed(corpus.trinucs):
        # n isn't named in the function: what makes it would be put there, and made again for each context
        told = F.transform("n", lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
        n = corpus.trinucs.select("corpus", "locus", F.slice(F.concat(told, F.array_repeat(F.lit(0.0), contexts)), 1, contexts).alias("n"))
    else:
        every = F.sequence(F.lit(0), F.lit(contexts - 1))
        entries = F.map_from_entries(F.collect_list(F.struct("context", F.col("n").cast("double"))))
        n = corpus.trinucs.groupBy("corpus", "locus").agg(entries.alias("_m"))
        n = n.select("corpus", "locus", F.transform(every, lambda c: F.coalesce(F.col("_m")[c], F.lit(0.0))).alias("n"))
    dummies = [(F.col("corpus") == c).cast("double") for c in corpora]
    columns = transform.columns()
    x = corpus.features.select("corpus", "locus", F.array(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in columns], *dummies).alias("x"))
    return corpus.loci.select("corpus", "locus", F.col("exposure").cast("double").alias("exposure")).join(n, ["corpus", "locus"]).join(x, ["corpus", "locus"])


def cells(mutations: DataFrame) -> DataFrame:
    """(corpus, sample, locus, context, mutation, weight), summed: equal mutations have equal likelihoods."""
    return mutations.groupBy("corpus", "sample", "locus", "context", "mutation").agg(F.sum("weight").alias("weight"))


def log_rates(loci: DataFrame, state: State) -> DataFrame:
    """loci with logmu (array of K) under the rate model. Where loci have one, it is that before the rate model's last fit.

    A rate model that is a projection of x (``columns``) is left to Spark; others are evaluated in Python, and their result is cut unless
    they are cheap enough for each cell (``by_cell``).
    """
    if hasattr(state.rate_model, "columns"):
        return loci.withColumn("logmu", state.rate_model.columns(F.col("x")))
    rate = state.rate_model  # goes with the function: classes of a notebook or a test don't pass a broadcast

    # only these columns go to Python, the counts by context stay
    cheap = bool(getattr(rate, "by_cell", False))
    if "logmu" in loci.columns and hasattr(rate, "grown") and not cheap:

        @F.arrow_udf("array<double>")
        def told(x: pa.Array, logmu: pa.Array) -> pa.Array:
            return listed(rate.grown(stacked(x), stacked(logmu)))

        return cut(loci.withColumn("logmu", told("x", "logmu")))

    @F.arrow_udf("array<double>")
    def afresh(x: pa.Array) -> pa.Array:
        return listed(rate.log_rate(stacked(x)))

    told_all = loci.withColumn("logmu", afresh("x"))
    return told_all if cheap else cut(told_all)


def context_exposure(rated: DataFrame, state: State) -> dict[str, np.ndarray]:
    """By corpus, K x contexts: contexts x exposure x rate summed over its loci. Corpora x K rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows in batches:
            if len(rows):
                names, at = np.unique(rows.column("corpus").to_numpy(zero_copy_only=False), return_inverse=True)
                n, mu = stacked(rows.column("n")), np.exp(stacked(rows.column("logmu"))) * rows.column("exposure").to_numpy()[:, None]
                for i, name in enumerate(names):
                    sums[name] = sums.get(name, 0.0) + (mu[at == i].T @ n[at == i] if len(names) > 1 else mu.T @ n)
        for name, eta in sums.items():
            yield pa.RecordBatch.from_pydict({"corpus": pa.repeat(name, len(eta)), "component": np.arange(len(eta), dtype=np.int32), "eta": listed(eta)})

    rows = rated.select("corpus", "n", "exposure", "logmu").mapInArrow(run, "corpus string, component int, eta array<double>")
    rows = rows.groupBy("corpus", "component").agg(F.array(*[F.sum(F.get("eta", F.lit(c))) for c in range(state.delta.shape[1])]).alias("eta"))
    out: dict[str, np.ndarray] = {}
    for r in rows.collect():
        out.setdefault(r["corpus"], np.zeros(state.delta.shape))[r["component"]] = r["eta"]
    return out


def log_masses(eta: dict[str, np.ndarray], delta: np.ndarray) -> dict[str, np.ndarray]:
    """The log of each component's total mass by corpus, from context_exposure() and the context rates."""
    return {c: np.log((e * delta).sum(axis=1) + TINY) for c, e in eta.items()}


def with_log_rates(loci: DataFrame, state: State) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """loci with logmu, and the log of each component's total mass by corpus."""
    rated = log_rates(loci, state)
    return rated, log_masses(context_exposure(rated, state), state.delta)


def listed(m: np.ndarray) -> pa.Array:
    """The rows of m as lists."""
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], np.ascontiguousarray(m, float).ravel())


def masses(rated: DataFrame, delta: np.ndarray, name: str) -> DataFrame:
    """rated with name, an array of K: each component's occurrences at a locus, exposure x delta . n."""

    @F.arrow_udf("array<double>")
    def told(exposure: pa.Array, n: pa.Array) -> pa.Array:
        return listed(exposure.to_numpy(zero_copy_only=False)[:, None] * (stacked(n) @ delta.T))

    return rated.withColumn(name, told("exposure", "n"))


def likelihood(part: pd.DataFrame, rho: np.ndarray, delta: np.ndarray, log_z: np.ndarray) -> np.ndarray:
    """K x cells: the probability of each cell of one sample under each component; NaN counts as zero."""
    c, m, exposure, n = (part[x].to_numpy() for x in ("context", "mutation", "exposure", "n_context"))
    return likelihood_of(c, m, exposure, n, np.stack(part["logmu"].to_list()), rho, delta, log_z)


def likelihood_of(c: np.ndarray, m: np.ndarray, exposure: np.ndarray, n: np.ndarray, logmu: np.ndarray, rho: np.ndarray, delta: np.ndarray, log_z: np.ndarray) -> np.ndarray:
    """likelihood() of cells as arrays; logmu is cells x K."""
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(rho)[:, c, m] + np.log(delta)[:, c] + np.log(exposure) + np.log(n) + logmu.T - log_z[:, None]
    return np.nan_to_num(np.exp(logs), nan=0.0)


def summed_by(keys: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the rows of r summed by them."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, weights=x, minlength=len(found)) for x in r.T], axis=1)


def fixed_point(phi: np.ndarray, weight: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, tolerance: float, rounds: int) -> np.ndarray:
    """gamma of one sample: alpha plus its cells' responsibilities, until the mean change is below tolerance; at most rounds evaluations."""
    return split.found(phi, weight, np.array([len(weight)]), alpha[None, :], gamma[None, :], tolerance, rounds)[0]


def bound(phi: np.ndarray, weight: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> float:
    """The evidence lower bound of one sample."""
    _, mass = split.responsibilities(gamma[None, :], phi, np.array([len(weight)]))
    return float(split.log_sums(weight, mass, np.array([0]))[0] + dirichlet_bound(alpha, gamma[None, :])[0])


def gathered(sample_cells: DataFrame, rated: DataFrame) -> DataFrame:
    """Cells with what their likelihood needs of their locus: exposure, logmu and the count of their own context."""
    own = rated.select("corpus", "locus", "exposure", "logmu", "n")
    j = sample_cells.join(own, ["corpus", "locus"])
    return j.withColumn("n_context", F.get("n", F.col("context"))).drop("n")


#: Columns of the design from which on it isn't kept with the cells, and cells that are inferred side by side, or summed by locus, about.
WIDE, SIDE_CELLS, SUM_CELLS = 64, 30_000, 1_000_000


def stays_with_cells(rate_model: object, width: int) -> bool:
    """Whether a cell's log rates may be had from its locus' design in each epoch, so that loci and cells meet once."""
    return width <= WIDE and bool(getattr(rate_model, "by_cell", False))


def together(mutations: DataFrame, loci: DataFrame, alternatives: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What infer() takes of mutations whose cells stay with their sample: cells of hot samples alone, those samples, and the others' cohort().

    Equal mutations aren't summed but where a sample is hot.
    """
    hot = split.hot_samples(mutations)
    if hot.isEmpty():
        return cells(mutations), hot, cohort(mutations, loci, alternatives)
    own = lambda how: mutations.join(F.broadcast(hot), ["corpus", "sample"], how)
    return cut(cells(own("left_semi"))), hot, cohort(own("left_anti"), loci, alternatives)


def cohort(mutations: DataFrame, loci: DataFrame, alternatives: int) -> DataFrame:
    """(corpus, sample, place, kind, weight, base, x): a row a sample, its cells' loci, context x mutations + mutation, weights, exposure x count of the context, and designs as bytes.

    It holds all that the likelihood needs and that training doesn't change. Samples are dealt to tasks by their cells.
    """
    own = loci.select("corpus", "locus", "exposure", "n", "x")
    j = mutations.select("corpus", "sample", "locus", "context", "mutation", "weight").join(own, ["corpus", "locus"])
    base = F.col("exposure") * F.get("n", F.col("context"))
    j = j.select("corpus", "sample", "locus", (F.col("context") * alternatives + F.col("mutation")).cast("int").alias("kind"), F.col("weight").cast("double").alias("weight"), base.alias("base"), "x")

    types = {"locus": np.int64, "kind": np.int32, "weight": float, "base": float, "x": float}
    sample_type = to_arrow_type(mutations.schema["sample"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each stretch of rows of one sample, which may go on in the next batch."""
        key, parts = None, []

        def row() -> dict:
            whole = [np.concatenate(p) for p in zip(*parts, strict=True)]
            return {"corpus": key[0], "sample": key[1]} | {c: v.tobytes() for c, v in zip(("place", "kind", "weight", "base", "x"), whole, strict=True)}

        def batch(rows: list[dict]) -> pa.RecordBatch:
            kinds = {"corpus": pa.string(), "sample": sample_type}
            return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in rows[0]})

        for rows in batches:
            if not len(rows):
                continue
            flat = [rows.column(c).flatten() if c == "x" else rows.column(c) for c in types]
            flat = [np.ascontiguousarray(v.to_numpy(zero_copy_only=False), t) for v, t in zip(flat, types.values(), strict=True)]
            sizes = [len(v) // len(rows) for v in flat]
            same = np.ones(len(rows) - 1, bool)
            for c in ("corpus", "sample"):
                same &= pc.fill_null(pc.equal(rows.column(c)[1:], rows.column(c)[:-1]), False).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(rows)]])
            out = []
            for a, z in zip(starts, starts[1:], strict=False):
                own = (rows.column("corpus")[int(a)].as_py(), rows.column("sample")[int(a)].as_py())
                if key is not None and own != key:
                    out.append(row())
                    parts = []
                key = own
                parts.append([v[a * n : z * n] for v, n in zip(flat, sizes, strict=True)])
            if out:
                yield batch(out)
        if parts:
            yield batch([row()])

    kind = mutations.schema["sample"].dataType.simpleString()
    schema = f"corpus string, sample {kind}, place binary, kind binary, weight binary, base binary, x binary"
    return dealt(j, "corpus", "sample", rows=mutations.count()).sortWithinPartitions("corpus", "sample").mapInArrow(pack, schema)


def inferred(packed: DataFrame, log_z: dict[str, np.ndarray], state: State, old: DataFrame | None, tolerance: float, rounds: int, seed: int, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """infer()'s rows of the samples of a cohort(), summed: those for signatures and loci are the corpus', without a sample.

    Many samples are inferred side by side, and what they imply for signatures and loci leaves a task summed.
    """
    shared = packed.sparkSession.sparkContext.broadcast((state.rho() * state.delta[:, :, None], log_z, state.alpha))
    rate_model, size = state.rate_model, state.k  # goes with the function: classes of a notebook or a test don't pass a broadcast
    before = old.select("corpus", "sample", F.col("gamma").alias("old")) if old is not None else None
    packed = packed.join(small_or_shuffled(before), ["corpus", "sample"], "left") if before is not None else packed.withColumn("old", F.lit(None).cast("array<double>"))
    sample_type = to_arrow_type(packed.schema["sample"].dataType)
    values = [f"v{i}" for i in range(size)]

    def batch(corpus, sample, kind: str, key, value, bound=0.0, weight=0.0) -> pa.RecordBatch:
        n = len(key)
        of = lambda v: np.broadcast_to(np.asarray(v, float), n)
        columns = {"corpus": corpus if isinstance(corpus, pa.Array) else pa.repeat(corpus, n), "sample": pa.nulls(n, sample_type) if sample is None else sample, "kind": pa.repeat(kind, n), "key": np.asarray(key, np.int64)}
        return pa.RecordBatch.from_pydict(columns | dict(zip(values, np.ascontiguousarray(value.T), strict=True)) | {"bound": of(bound), "weight": of(weight)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, z, alphas = shared.value
        table, mean = table.reshape(size, -1), np.mean(list(alphas.values()), axis=0)
        signature: dict[str, np.ndarray] = {}
        places: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def loci_of(corpus: str) -> pa.RecordBatch:
            keys, r = (np.concatenate(x) for x in zip(*places.pop(corpus), strict=True))
            return batch(corpus, None, "locus", *summed_by(keys, r))

        def infer_some(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            place, kind, weight, base, x = (np.concatenate([np.frombuffer(r[c].as_buffer(), t) for r in rows]) for c, t in (("place", np.int64), ("kind", np.int32), ("weight", float), ("base", float), ("x", float)))
            sizes = np.array([len(r["weight"].as_buffer()) // 8 for r in rows])
            names = [r["corpus"].as_py() for r in rows]
            logmu = np.asarray(rate_model.log_rate(x.reshape(len(place), -1)), float)
            with np.errstate(all="ignore"):
                phi = np.exp(logmu.T - np.repeat(np.stack([z[c] for c in names]).T, sizes, axis=1)) * table[:, kind] * base
            phi = np.nan_to_num(phi, nan=0.0)
            alpha = np.stack([alphas.get(c, mean) for c in names])
            start = np.stack([first_composition(seed, r["sample"].as_py(), size) if r["old"].as_py() is None else np.array(r["old"].as_py()) for r in rows])
            gamma = split.found(phi, weight, sizes, alpha, start, tolerance, rounds)
            r, mass = split.responsibilities(gamma, phi, sizes)
            starts = np.cumsum(sizes) - sizes
            r *= weight
            bound = split.log_sums(weight, mass, starts) + np.array([dirichlet_bound(a, g[None, :])[0] for a, g in zip(alpha, gamma, strict=True)])
            yield batch(pa.array(names), pa.array([x["sample"].as_py() for x in rows], sample_type), "gamma", np.zeros(len(rows)), gamma, bound, np.add.reduceat(weight, starts))
            for corpus in set(names) if kinds != ("gamma",) else ():
                own = np.repeat(np.array([c == corpus for c in names]), sizes)
                own = slice(None) if own.all() else own
                if "signature" in kinds:
                    sums = np.stack([np.bincount(kind[own], weights=v[own], minlength=table.shape[1]) for v in r], axis=1)
                    signature[corpus] = signature.get(corpus, 0.0) + sums
                if "locus" in kinds:
                    places.setdefault(corpus, []).append((place[own], r[:, own].T))

        def waiting(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            held += sum(len(r["weight"].as_buffer()) // 8 for r in rows)
            yield from infer_some(rows)
            if held >= SUM_CELLS:
                held = 0
                yield from [loci_of(c) for c in list(places)]

        for rows in batches:
            some, cells_of_some = [], 0
            for i in range(len(rows)):
                some.append({c: rows.column(c)[i] for c in rows.schema.names})
                cells_of_some += len(some[-1]["weight"].as_buffer()) // 8
                if cells_of_some >= SIDE_CELLS:
                    yield from waiting(some)
                    some, cells_of_some = [], 0
            if some:
                yield from waiting(some)
        yield from [loci_of(c) for c in list(places)]
        for corpus, sums in signature.items():
            seen = np.flatnonzero(sums.any(axis=1))
            yield batch(corpus, None, "signature", seen, sums[seen])

    kind = packed.schema["sample"].dataType.simpleString()
    out = packed.mapInArrow(run, f"corpus string, sample {kind}, kind string, key long, " + ", ".join(f"{v} double" for v in values) + ", bound double, weight double")
    keys = ("corpus", "sample", "kind", "key")
    if kinds == ("gamma",):
        return out.select(*keys, F.array(*values).alias("value"), "bound", "weight")
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out before they are added up: a task's keys are few then
    sums = out.repartition(n, *keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*values, "bound", "weight")])
    return sums.select(*keys, F.array(*values).alias("value"), "bound", "weight")


def by_sample(df: DataFrame) -> DataFrame:
    """df dealt out by sample. Small tables aren't gathered in fewer tasks: a sample's work is long, its rows are few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "corpus", "sample")


def first_composition(seed: int, sample: object, k: int) -> np.ndarray:
    """Where a sample starts: Gamma(100, 1/100) draws of its own seed."""
    return np.random.default_rng([seed, *str(sample).encode()]).gamma(100, 1 / 100, k)


def infer(sample_cells: DataFrame, rated: DataFrame, log_z: dict[str, np.ndarray], state: State, old: DataFrame | None = None, rate: float = 1.0, locus_rate: float = 1.0, tolerance: float = 1e-3, rounds: int = 1000, seed: int = 0, hot: DataFrame | None = None, packed: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The E-step: rows (corpus, sample, kind, key, value array of K, bound, weight).

    kind "gamma" is a sample's composition, with its bound and weight; "signature" sums
    responsibilities by context x mutations + mutation, "locus" by locus. old (corpus, sample, gamma) is
    blended in by 1 - rate; without it samples start from first_composition(). A sample is a group,
    but the ones in hot (split.hot_samples() unless given) lie in chunks and may have several rows a key.
    Where packed has the other samples' cohort(), rate is one and its rows are those of inferred(). Rows of kinds that aren't asked for may be left out.
    """
    shared = sample_cells.sparkSession.sparkContext.broadcast((state.rho(), state.delta, log_z, state.alpha))
    hot = split.hot_samples(sample_cells) if hot is None else hot
    alone = hot.isEmpty()
    before = old.select("corpus", "sample", F.col("gamma").alias("old")) if old is not None else None
    alpha_of = lambda alphas, corpus: alphas[corpus] if corpus in alphas else np.mean(list(alphas.values()), axis=0)
    kind = sample_cells.schema["sample"].dataType.simpleString()
    schema = f"corpus string, sample {kind}, kind string, key long, value array<double>, bound double, weight double"

    def one(key, part):  # of tables, as above
        rho, delta, z, alphas = shared.value
        corpus, sample = (v.as_py() for v in key)
        alpha = alpha_of(alphas, corpus)
        c, m, exposure, n_context, locus = (part[x].to_numpy() for x in ("context", "mutation", "exposure", "n_context", "locus"))
        logmu = part["logmu"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(alpha))
        phi, weight = likelihood_of(c, m, exposure, n_context, logmu, rho, delta, z[corpus]), part["weight"].to_numpy().astype(float)
        before = part["old"][0].as_py()
        if before is None:
            before = first_composition(seed, sample, len(alpha))
        gamma = fixed_point(phi, weight / locus_rate, alpha, np.array(before, float), tolerance, rounds)
        gamma = (1 - rate) * np.array(before, float) + rate * gamma
        e = np.exp(np_dirichlet_expectation(gamma))
        r = (e[:, None] * phi / (phi.T @ e + TINY) * (weight / locus_rate)).T
        nothing = (np.zeros(0, np.int64), np.zeros((0, len(alpha))))
        (places, sig) = summed_by(c.astype(np.int64) * len(rho[0, 0]) + m, r) if "signature" in kinds else nothing
        (loci, loc) = summed_by(locus, r) if "locus" in kinds else nothing
        n = 1 + len(places) + len(loci)
        first = lambda v: np.concatenate([[v], np.zeros(n - 1)])
        values = np.concatenate([gamma[None, :], sig, loc])
        names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(3, dtype=np.int8), [1, len(places), len(loci)]), list(KINDS)).cast(pa.string())
        columns = {
            "corpus": pa.repeat(key[0], n), "sample": pa.repeat(key[1], n), "kind": names, "key": np.concatenate([[0], places, loci]).astype(np.int64),
            "value": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(alpha), values.ravel()), "bound": first(bound(phi, weight, alpha, gamma)), "weight": first(weight.sum()),
        }
        return pa.table(columns)

    if packed is not None:
        out = inferred(packed, log_z, state, old, tolerance, rounds, seed, kinds)
    else:
        j = gathered(sample_cells if alone else sample_cells.join(F.broadcast(hot), ["corpus", "sample"], "left_anti"), rated)
        j = j.join(before, ["corpus", "sample"], "left") if before is not None else j.withColumn("old", F.lit(None).cast("array<double>"))
        out = by_sample(j).groupBy("corpus", "sample").applyInArrow(one, schema)
    if alone:
        return out

    def phi_of(corpus: str, part: pd.DataFrame) -> np.ndarray:
        rho, delta, z, _ = shared.value
        return likelihood(part, rho, delta, z[corpus])

    held = split.chunks(gathered(sample_cells.join(F.broadcast(hot), ["corpus", "sample"], "left_semi"), rated), hot, phi_of, state.omega.shape[2])
    keys = held.select("corpus", "sample").distinct()
    known = keys.join(before, ["corpus", "sample"], "left") if before is not None else keys.withColumn("old", F.lit(None).cast("array<double>"))
    start = {(r["corpus"], r["sample"]): first_composition(seed, r["sample"], state.k) if r["old"] is None else np.array(r["old"]) for r in known.collect()}  # a row per hot sample
    alpha = lambda corpus: alpha_of(state.alpha, corpus)
    gamma = split.compositions(held, start, alpha, 1 / locus_rate, tolerance, rounds) if rate else start
    gamma = {k: (1 - rate) * start[k] + rate * g for k, g in gamma.items()}
    return out.unionByName(split.statistics(held, gamma, alpha, 1 / locus_rate)) if gamma else out


def summed(stats: DataFrame, kind: str, *keys: str, k: int) -> DataFrame:
    """stats of one kind with the arrays added up per keys."""
    return stats.where(F.col("kind") == kind).groupBy(*keys).agg(F.array(*[F.sum(F.get("value", F.lit(i))) for i in range(k)]).alias("value"))
