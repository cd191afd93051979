"""Inference for samples whose cells don't fit one task: their cells lie in chunks, and only sums over chunks meet.

The likelihood of a cell doesn't change while a composition is looked for, so it is computed once and
kept with the cell's weight as the bytes of a chunk. A round sends each such sample's composition out
and gets back what its chunks add to it, its slope and the cells' bound: K x K + K + 1 numbers a sample. What a composition implies for
signatures and loci is emitted by chunk at the end and summed by those who read it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import dirichlet_bound, np_dirichlet_expectation, np_digamma, np_lgamma, np_trigamma
from ..operators.durable import cut

TINY = 1e-30
#: The largest part of an entry of a composition that a leap may take away.
FARTHEST = 0.9
#: Cells of a sample from which on it is cut up, and cells of a chunk, about.
HOT_CELLS, CHUNK_CELLS = 2_000_000, 100_000

Key = tuple[str, object]


class Search:
    """Compositions of samples, a row each, by Newton's method: where alpha and a sample's responsibilities add up to its composition again.

    ``at`` is where spread() is to be evaluated next, for the samples that are still ``open``; told() takes what it
    gives there. Where a leap lowers the evidence bound, the plain step, which never does, is taken in its place.
    Plain steps alone, which converge slowly where components are alike, need up to a hundred times as many evaluations.
    """

    def __init__(self, start: np.ndarray, alpha: np.ndarray):
        self.at, self.alpha = np.array(start, float), np.broadcast_to(alpha, np.shape(start))
        self.open, self.leapt = np.arange(len(self.at)), np.zeros(len(self.at), bool)
        self.safe, self.best = self.at.copy(), np.full(len(self.at), -np.inf)
        self.reach = np.full(len(self.at), FARTHEST)  # by how much a leap may shrink an entry

    def told(self, added: np.ndarray, scatter: np.ndarray, log: np.ndarray, tolerance: float) -> None:
        """Moves the open samples, of which these are the sums; those that a plain step moves by less than tolerance in the mean are done."""
        i, value = self.open, self.alpha[self.open] + added
        step = value - self.at[i]
        done = np.abs(step).mean(axis=1) < tolerance
        self.at[i[done]] = value[done]
        bound = log + dirichlet_part(self.alpha[i], self.at[i])
        astray = ~done & self.leapt[i] & ~(bound >= self.best[i] - 1e-12 * np.abs(self.best[i]))
        self.reach[i] = np.where(astray, self.reach[i] / 4, np.minimum(FARTHEST, np.where(self.leapt[i], self.reach[i] * 2, self.reach[i])))
        self.at[i[astray]], self.leapt[i[astray]] = self.safe[i[astray]], False
        go = np.flatnonzero(~done & ~astray)
        if len(go):
            j = i[go]
            leap, ok = leaps(self.at[j], step[go], scatter[go], self.reach[j])
            self.best[j], self.safe[j], self.leapt[j] = bound[go], value[go], ok
            self.at[j] = np.where(ok[:, None], leap, value[go])
        self.open = i[~done]


def leaps(at: np.ndarray, step: np.ndarray, scatter: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where Newton's steps end, turned uphill where the bound isn't concave and shortened to shrink no entry by more than reach; and whether they are of use."""
    root = np.sqrt(np_trigamma(at))
    slope = root[:, :, None] * scatter * root[:, None, :]
    ok = np.isfinite(slope).all(axis=(1, 2))
    sizes, axes = np.linalg.eigh(np.where(ok[:, None, None], slope, 0.0))
    turned = (axes * ((step * root)[:, :, None] * axes).sum(axis=1, keepdims=True) / np.maximum(np.abs(1 - sizes), 1e-9)[:, None, :]).sum(axis=2) / root
    shrink = (-turned / at).max(axis=1)
    out = at + turned * (reach / np.maximum(shrink, reach))[:, None]
    return out, ok & (np.isfinite(out) & (out > 0)).all(axis=1)


def dirichlet_part(alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """dirichlet_bound() of rows with an alpha each, less what alpha alone adds."""
    both = np.concatenate([gamma, gamma.sum(axis=1, keepdims=True)], axis=1)
    logs, psi = np_lgamma(both), np_digamma(both)
    return logs[:, :-1].sum(axis=1) - logs[:, -1] + ((alpha - gamma) * (psi[:, :-1] - psi[:, -1:])).sum(axis=1)


def responsibilities(gamma: np.ndarray, phi: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """K x cells shares of the components of each cell, of samples of these numbers of cells, and the cells' masses; phi is K x cells."""
    r = np.repeat(np.exp(np_dirichlet_expectation(gamma)).T, sizes, axis=1)
    r *= phi
    mass = r.sum(axis=0)
    r /= mass + TINY
    return r, mass


def spread(gamma: np.ndarray, weight: np.ndarray, phi: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a sample's cells add to its composition, K x K by how much the shares of a cell vary together, and their log masses, all by weight.

    The slope of the first is the second times the trigamma function of gamma, by columns.
    """
    r, mass = responsibilities(gamma, phi, sizes)
    ends = np.cumsum(sizes)
    starts, heavy = ends - sizes, r * weight
    added = np.add.reduceat(heavy, starts, axis=1).T
    scatter = -np.stack([heavy[:, a:z] @ r[:, a:z].T for a, z in zip(starts, ends, strict=True)])
    each = np.arange(len(phi))
    scatter[:, each, each] += added
    return added, scatter, log_sums(weight, mass, starts)


def log_sums(weight: np.ndarray, mass: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The cells' part of the evidence bound of each sample: logs of masses by weight; cells without mass count none."""
    return np.add.reduceat(weight * np.log(np.where(mass > 0, mass, 1.0)), starts)


def found(phi: np.ndarray, weight: np.ndarray, sizes: np.ndarray, alpha: np.ndarray, start: np.ndarray, tolerance: float, rounds: int) -> np.ndarray:
    """The compositions of samples whose cells lie side by side, sizes of them each; at most rounds evaluations."""
    search, ends, known = Search(start, alpha), np.cumsum(sizes), len(sizes)
    for _ in range(rounds):
        if not len(search.open):
            break
        if len(search.open) < known:
            cells = np.repeat(np.isin(np.arange(len(sizes)), search.open), sizes)
            own_phi, own_weight, known = phi[:, cells], weight[cells], len(search.open)
        elif known == len(ends):
            own_phi, own_weight = phi, weight
        search.told(*spread(search.at[search.open], own_weight, own_phi, sizes[search.open]), tolerance)
    return search.at


def hot_samples(cells: DataFrame, limit: int = HOT_CELLS, chunk: int = CHUNK_CELLS) -> DataFrame:
    """(corpus, sample, chunks) of the samples with more cells than limit; at most one for each limit cells, cut."""
    n = cells.groupBy("corpus", "sample").count().where(F.col("count") > limit)
    return cut(n.select("corpus", "sample", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))


def chunks(gathered: DataFrame, hot: DataFrame, likelihood: Callable[[str, pd.DataFrame], np.ndarray], mutations: int = 3) -> DataFrame:
    """(corpus, sample, chunk, place, kind, weight, phi) of the hot samples' cells, cut: loci, context x mutations + mutation, weights and K x n likelihoods as bytes."""
    dealt = gathered.join(F.broadcast(hot), ["corpus", "sample"])
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("locus", "context", "mutation"), F.col("chunks")).cast("int"))
    n = int(gathered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = gathered.schema["sample"].dataType.simpleString()

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["locus", "context", "mutation"])
        of = lambda x, t: np.ascontiguousarray(x, t).tobytes()
        row = {"place": of(part["locus"], np.int64), "kind": of(part["context"] * mutations + part["mutation"], np.int32), "weight": of(part["weight"], float), "phi": of(likelihood(key[0], part), float)}
        return pd.DataFrame({"corpus": [key[0]], "sample": [key[1]], "chunk": [key[2]], **{k: [v] for k, v in row.items()}})

    schema = f"corpus string, sample {kind}, chunk int, place binary, kind binary, weight binary, phi binary"
    return cut(dealt.drop("chunks").repartition(n, "corpus", "sample", "chunk").groupBy("corpus", "sample", "chunk").applyInPandas(pack, schema))


def _numbers(row) -> tuple[np.ndarray, np.ndarray]:
    weight = np.frombuffer(row.weight, float)
    return weight, np.frombuffer(row.phi, float).reshape(-1, len(weight))


def _sums(packed: DataFrame, gamma: dict[Key, np.ndarray], of_chunk: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> dict[Key, np.ndarray]:
    """of_chunk(gamma, weight, phi) added up over each sample's chunks; a row per sample comes back."""
    shared = packed.sparkSession.sparkContext.broadcast(gamma)
    kind = packed.schema["sample"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            mine = [r for r in pdf.itertuples() if (r.corpus, r.sample) in known]
            if mine:
                yield pd.DataFrame({"corpus": [r.corpus for r in mine], "sample": [r.sample for r in mine], "value": [of_chunk(known[r.corpus, r.sample], *_numbers(r)) for r in mine]})

    rows = packed.select("corpus", "sample", "weight", "phi").mapInPandas(run, f"corpus string, sample {kind}, value array<double>")
    size = len(of_chunk(next(iter(gamma.values())), np.ones(1), np.ones((len(next(iter(gamma.values()))), 1))))
    total = rows.groupBy("corpus", "sample").agg(F.array(*[F.sum(F.get("value", F.lit(i))) for i in range(size)]).alias("value"))
    out = {(r["corpus"], r["sample"]): np.array(r["value"]) for r in total.collect()}
    shared.unpersist()
    return out


def _step(gamma: np.ndarray, weight: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """spread() of a chunk as one row of numbers."""
    return np.concatenate([x.ravel() for x in spread(gamma[None, :], weight, phi, np.array([len(weight)]))])


def _bound(gamma: np.ndarray, weight: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """A chunk's part of the evidence lower bound, and its weight."""
    _, mass = responsibilities(gamma[None, :], phi, np.array([len(weight)]))
    return np.array([log_sums(weight, mass, np.array([0]))[0], weight.sum()])


def compositions(packed: DataFrame, start: dict[Key, np.ndarray], alpha: Callable[[str], np.ndarray], scale: float, tolerance: float, rounds: int) -> dict[Key, np.ndarray]:
    """The fixed point of each sample's composition, by rounds over the chunks of those that still move. scale multiplies the weights."""
    keys = list(start)
    search = Search(np.stack([start[k] for k in keys]), np.stack([alpha(c) for c, _ in keys]))
    size = search.at.shape[1]
    for _ in range(rounds):
        if not len(search.open):
            break
        sums = _sums(packed, {keys[i]: search.at[i] for i in search.open}, lambda g, w, phi: _step(g, w * scale, phi))
        told = np.stack([sums[keys[i]] for i in search.open])
        search.told(told[:, :size], told[:, size:-1].reshape(-1, size, size), told[:, -1], tolerance)
    return dict(zip(keys, search.at, strict=True))


def statistics(packed: DataFrame, gamma: dict[Key, np.ndarray], alpha: Callable[[str], np.ndarray], scale: float) -> DataFrame:
    """infer()'s rows of the hot samples: one for gamma with bound and weight, and by chunk those for signatures and loci."""
    spark = packed.sparkSession
    shared = spark.sparkContext.broadcast(gamma)
    kind = packed.schema["sample"].dataType.simpleString()
    schema = f"corpus string, sample {kind}, kind string, key long, value array<double>, bound double, weight double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                weight, phi = _numbers(row)
                e = np.exp(np_dirichlet_expectation(shared.value[row.corpus, row.sample]))
                r = (e[:, None] * phi / (phi.T @ e + TINY) * (weight * scale)).T
                for name, keys in (("signature", np.frombuffer(row.kind, np.int32)), ("locus", np.frombuffer(row.place, np.int64))):
                    by = pd.DataFrame(r).groupby(keys).sum()
                    yield pd.DataFrame({"corpus": row.corpus, "sample": row.sample, "kind": name, "key": by.index, "value": list(by.to_numpy()), "bound": 0.0, "weight": 0.0})

    told = _sums(packed, gamma, _bound)
    own = [(c, s, "gamma", 0, g.tolist(), float(told[c, s][0] + dirichlet_bound(alpha(c), g[None, :])[0]), float(told[c, s][1])) for (c, s), g in gamma.items()]
    return packed.mapInPandas(run, schema).unionByName(spark.createDataFrame(own, schema))
