"""Which component made which mutation: Gibbs sampling per sample."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpora import Corpus
from ..operators.durable import dealt
from . import core
from .linear import stacked
from .trainer import Model, rates_for


#: Mutations whose labels are drawn side by side, and draws that are made ahead, about.
SIDE, AHEAD = 16_000, 200_000


def gibbs(phi: np.ndarray, weight: np.ndarray, alpha: np.ndarray, rng: np.random.Generator, warm_up: int = 300, sweeps: int = 5000) -> np.ndarray:
    """K x n shares of labels after an annealed warm-up; a sweep draws all labels given the counts before it."""
    return gibbs_side_by_side([phi], [weight], [alpha], [rng], warm_up, sweeps)[0]


def gibbs_side_by_side(phi: list[np.ndarray], weight: list[np.ndarray], alpha: list[np.ndarray], rngs: list[np.random.Generator], warm_up: int = 300, sweeps: int = 5000) -> list[np.ndarray]:
    """gibbs() of several samples: each draws from its own generator what it draws alone, so labels don't depend on who stands beside.

    Samples are rows as long as the longest; what stands in for missing mutations weighs nothing.
    """
    k, sizes = len(phi[0]), np.array([len(w) for w in weight])
    shape = (len(sizes), sizes.max())
    logs, w, a = np.zeros((k, *shape)), np.zeros(shape), np.stack(alpha).astype(float)
    sums = np.zeros((len(sizes), k))
    for i, (n, rng) in enumerate(zip(sizes, rngs, strict=True)):
        with np.errstate(divide="ignore"):
            logs[:, i, :n] = np.log(phi[i])
        w[i, :n] = weight[i]
        sums[i] = np.bincount(rng.choice(k, n, p=a[i] / a[i].sum()), weights=weight[i], minlength=k)
    with np.errstate(invalid="ignore"):
        logs -= logs.max(axis=0)
    below, total = np.maximum(sizes[:, None] - 1 + a, 1e-12), w.sum(axis=1)
    # with all of the likelihood a sweep takes neither logs nor powers; a label is the number of partial sums that the draw reaches
    scaled, p, reached, scratch = np.exp(logs), np.empty_like(logs), np.zeros(shape, bool), np.empty(shape)
    tally = np.zeros((k - 1, *shape), np.int32)
    u = np.zeros((max(1, min(warm_up + sweeps, AHEAD // w.size)), *shape))
    for t in range(warm_up + sweeps):
        if t % len(u) == 0:
            for i, (n, rng) in enumerate(zip(sizes, rngs, strict=True)):
                m = min(len(u), warm_up + sweeps - t)
                u[:m, i, :n] = rng.random((m, n))
        share = ((sums + a) / below).T[:, :, None]
        if t < warm_up:
            np.multiply(logs, (t + 1) / warm_up, out=p)
            np.exp(p, out=p)
            p *= share
        else:
            np.multiply(scaled, share, out=p)
        for i in range(1, k):
            p[i] += p[i - 1]
        draw, edges = u[t % len(u)], [total]
        draw *= p[-1]
        for i in range(k - 1):
            np.greater_equal(draw, p[i], out=reached)
            edges.append(np.multiply(w, reached, out=scratch).sum(axis=1))
            if t >= warm_up:
                tally[i] += reached
        sums = -np.diff(np.stack([*edges, np.zeros(len(sizes))]), axis=0).T
    counts = -np.diff(np.concatenate([np.full((1, *shape), sweeps), tally, np.zeros((1, *shape), int)]), axis=0)
    return [counts[:, i, :n] / sweeps for i, n in enumerate(sizes)]


def evidence(phi: np.ndarray, weight: np.ndarray, alpha: np.ndarray, rng: np.random.Generator, steps: int = 100, runs: int = 10, warm_up: int = 200) -> tuple[float, float, float]:
    """(lower, estimate, upper) of a sample's log marginal likelihood, shares and labels integrated out, by annealing both ways.

    Labels have a Dirichlet-multinomial prior; the likelihood phi is turned on in steps. Runs from the
    prior give weights whose mean log is below the evidence, runs back from the posterior (labels
    after warm_up sweeps) ones whose mean log is above; the closer both, the better the estimate, the
    log of the mean weight of the runs from the prior. A step draws shares given the labels, then
    labels given the shares. A cell of weight w counts as round(w) mutations with a label each.
    """
    k = len(phi)
    logs = np.repeat(np.log(np.maximum(phi, 1e-300)), np.rint(weight).astype(int), axis=1)
    n = logs.shape[1]
    heat = (np.arange(steps + 1) / steps) ** 2
    at = np.arange(n)

    def prior() -> np.ndarray:
        return rng.choice(k, n, p=rng.dirichlet(alpha))

    def step(z: np.ndarray, t: float) -> np.ndarray:
        shares = rng.gamma(alpha + np.bincount(z, minlength=k))
        q = t * logs + np.log(np.maximum(shares, 1e-300))[:, None]
        p = np.exp(q - q.max(axis=0))
        return (np.cumsum(p, axis=0) > rng.random(n) * p.sum(axis=0)).argmax(axis=0)

    up, down = np.zeros(runs), np.zeros(runs)
    for r in range(runs):
        z = prior()
        for a, b in zip(heat, heat[1:], strict=False):
            up[r] += (b - a) * logs[z, at].sum()
            z = step(z, b)
        for _ in range(warm_up):
            z = step(z, 1.0)
        for a, b in zip(heat[-2::-1], heat[:0:-1], strict=True):
            z = step(z, b)
            down[r] += (b - a) * logs[z, at].sum()
    return float(up.mean()), float(up.max() + np.log(np.mean(np.exp(up - up.max())))), float(down.mean())


def assign(model: Model, corpus: Corpus, warm_up: int = 300, sweeps: int = 5000, seed: int = 0, rated: DataFrame | None = None) -> DataFrame:
    """(corpus, sample, chrom, pos, logp_<component>): log shares of labels per mutation; minus infinity for none.

    Each sample is a group of its own with a seed from its name, so the result doesn't depend on the partitioning.
    """
    rated, log_z = rates_for(model, corpus, rated)
    m = corpus.mutations.select("corpus", "sample", "chrom", "pos", "locus", "context", "mutation", "weight")
    state = model.state
    shared = m.sparkSession.sparkContext.broadcast((state.rho(), state.delta, log_z, state.alpha))
    names = [f"logp_{n}" for n in state.names]

    def some(part: pa.Table) -> pa.RecordBatch:
        """The rows of whole samples, which lie side by side, with their shares."""
        rho, delta, z, alphas = shared.value
        mean, k = np.mean(list(alphas.values()), axis=0), len(rho)
        c, mutation, exposure, n_context, weight = (part[x].to_numpy() for x in ("context", "mutation", "exposure", "n_context", "weight"))
        logmu, weight = stacked(part["logmu"].combine_chunks()), weight.astype(float)
        starts = edges(part)
        keys = [(part["corpus"][int(a)].as_py(), part["sample"][int(a)].as_py()) for a in starts[:-1]]
        of = lambda i: slice(starts[i], starts[i + 1])
        phi = lambda i: core.likelihood_of(c[of(i)], mutation[of(i)], exposure[of(i)], n_context[of(i)], logmu[of(i)], rho, delta, z[keys[i][0]])
        shares, sizes = np.zeros((k, len(part))), np.diff(starts)
        waiting = list(np.argsort(sizes, kind="stable"))
        while waiting:
            # of like lengths, as many as fit beside the longest
            group = waiting[-max(1, SIDE // sizes[waiting[-1]]) :]
            del waiting[-len(group) :]
            rngs = [np.random.default_rng([seed, *str(keys[i][1]).encode()]) for i in group]
            told = gibbs_side_by_side([phi(i) for i in group], [weight[of(i)] for i in group], [alphas.get(keys[i][0], mean) for i in group], rngs, warm_up, sweeps)
            for i, share in zip(group, told, strict=True):
                shares[:, of(i)] = share
        with np.errstate(divide="ignore"):
            logs = np.log(shares)
        kept = {x: part[x].combine_chunks() for x in ("corpus", "sample", "chrom", "pos")}
        return pa.RecordBatch.from_pydict(kept | dict(zip(names, logs, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for rows in batches:
            if not len(rows):
                continue
            starts, first = edges(pa.Table.from_batches([rows])), tuple(rows.column(x)[0] for x in ("corpus", "sample"))
            # the last sample may go on in the next batch, and the first one be that of the batch before
            end = int(starts[-2]) if len(starts) > 2 or last is not None and first != last else None
            if end is not None and n + end >= 4 * SIDE:
                yield some(pa.Table.from_batches([*held, rows.slice(0, end)]))
                held, n, rows = [], 0, rows.slice(end)
            held.append(rows)
            n, last = n + len(rows), tuple(rows.column(x)[len(rows) - 1] for x in ("corpus", "sample"))
        if held:
            yield some(pa.Table.from_batches(held))

    kinds = {c: m.schema[c].dataType.simpleString() for c in ("sample", "chrom", "pos")}
    schema = f"corpus string, sample {kinds['sample']}, chrom {kinds['chrom']}, pos {kinds['pos']}, " + ", ".join(f"`{n}` double" for n in names)
    dealt_out = dealt(core.gathered(m, rated), "corpus", "sample", rows=m.count())
    return dealt_out.sortWithinPartitions("corpus", "sample", "chrom", "pos", "context", "mutation", "weight").mapInArrow(run, schema)


def edges(part: pa.Table) -> np.ndarray:
    """Where the samples of rows sorted by sample begin, and the number of rows."""
    new = np.ones(len(part), bool)
    same = [pc.fill_null(pc.equal(part[c][1:], part[c][:-1]), False).to_numpy() for c in ("corpus", "sample")]
    new[1:] = ~(same[0] & same[1])
    return np.append(np.flatnonzero(new), len(part))


def marginal_likelihood(model: Model, corpus: Corpus, steps: int = 100, runs: int = 10, seed: int = 0) -> DataFrame:
    """(corpus, sample, lower, log_likelihood, upper) of each sample's cells, by evidence()."""
    rated, log_z = rates_for(model, corpus)
    return evidence_of_cells(core.gathered(core.cells(corpus.mutations), rated), log_z, model.state, steps, runs, seed)


def evidence_of_cells(gathered: DataFrame, log_z: dict[str, np.ndarray], state: core.State, steps: int = 100, runs: int = 10, seed: int = 0) -> DataFrame:
    shared = gathered.sparkSession.sparkContext.broadcast((state.rho(), state.delta, log_z, state.alpha))

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        rho, delta, z, alphas = shared.value
        alpha = alphas.get(key[0], np.mean(list(alphas.values()), axis=0))
        part = part.sort_values(["locus", "context", "mutation"])
        told = evidence(core.likelihood(part, rho, delta, z[key[0]]), part["weight"].to_numpy(float), alpha, np.random.default_rng([seed, *str(key[1]).encode()]), steps, runs)
        return pd.DataFrame([[*key, *told]], columns=["corpus", "sample", "lower", "log_likelihood", "upper"])

    kind = gathered.schema["sample"].dataType.simpleString()
    return core.by_sample(gathered).groupBy("corpus", "sample").applyInPandas(one, f"corpus string, sample {kind}, lower double, log_likelihood double, upper double")


def explain(model: Model, corpus: Corpus, component: str | int, background: int = 500) -> DataFrame:
    """(corpus, locus, feature, value): each feature's Shapley value in a component's log rate at a locus.

    Values are exact, against the mean of all loci for linear models, and for trees against
    ``background`` loci, those that hash lowest: absent features take those loci's values. They add up
    to the log rate less its mean over the background.
    """
    from .core import locus_table

    k, state = model.state.component(component), model.state
    if state.rate_model.kind not in ("linear", "gbt"):
        raise ValueError(f"there is no exact explanation of rates of kind {state.rate_model.kind}")
    loci = locus_table(corpus, model.transform, state.corpora)
    names = [*model.transform.names(), *[f"corpus={c}" for c in state.corpora]]
    mean = loci.agg(*[F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(len(names))]).first()
    means, tables = np.array([mean[f"m{j}"] or 0.0 for j in range(len(names))]), []
    if state.rate_model.kind != "linear":
        rows = loci.orderBy(F.xxhash64("corpus", "locus"), "corpus", "locus").limit(background).select("x").collect()
        if rows:
            x = np.array([r["x"] for r in rows])
            means, b = x.mean(axis=0), state.rate_model.binned(x)
            tables = [(w, shapley_tables(t, b)) for w, t in state.rate_model.trees[k]]
    shared = loci.sparkSession.sparkContext.broadcast((state.rate_model, means, tables))

    def run(batches):
        rate, m, by_tree = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_list())
            if rate.kind == "linear":
                v = (x - m) * rate.beta[k]
            else:
                v = np.zeros((len(x), len(m)))
                v[:, rate.n_features :] = (x - m)[:, rate.n_features :] * rate.bias[k]
                b = rate.binned(x)
                for w, leaves in by_tree:
                    for features, low, high, table in leaves:
                        inside = (b[:, features] > low) & (b[:, features] <= high)
                        v[:, features] += w * table[inside @ (1 << np.arange(len(features)))]
            yield pd.DataFrame({"corpus": np.repeat(pdf["corpus"].to_numpy(), len(m)), "locus": np.repeat(pdf["locus"].to_numpy(), len(m)), "feature": np.tile(names, len(x)), "value": v.ravel()})

    return loci.select("corpus", "locus", "x").mapInPandas(run, f"corpus string, locus {loci.schema['locus'].dataType.simpleString()}, feature string, value double")


def shapley_tables(tree, background: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each leaf (features, low, high, table): a row's share of the leaf's value by which of its bins lie in (low, high].

    A row reaches the leaf with a set of features taken from it, the others from a background row, if
    all bins taken lie inside. Averaging over orders of the features leaves, for u features that only
    the row has inside and n that only the other has, (u - 1)! n! / (u + n)! for each of the first
    and -u! (n - 1)! / (u + n)! for each of the second; none if a feature is outside for both. A leaf
    has at most as many features as the tree is deep, so the table holds all cases.
    """
    out = []

    def walk(node: int, ranges: dict[int, tuple[float, float]]) -> None:
        j = tree.feature[node]
        if j >= 0:
            low, high = ranges.get(j, (-np.inf, np.inf))
            walk(tree.left[node], ranges | {j: (low, min(high, tree.bin[node]))})
            walk(tree.right[node], ranges | {j: (max(low, tree.bin[node]), high)})
        elif ranges:
            features, d = np.array(sorted(ranges)), len(ranges)
            low, high = (np.array([ranges[f][i] for f in features]) for i in (0, 1))
            inside = (background[:, features] > low) & (background[:, features] <= high)
            share = np.bincount(inside @ (1 << np.arange(d)), minlength=1 << d) / max(1, len(background))
            bits = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
            table = np.zeros((1 << d, d))
            for own in range(1 << d):
                for other in np.flatnonzero(share):
                    if (own | other) + 1 == 1 << d:
                        mine, theirs = bits[own] & ~bits[other], bits[other] & ~bits[own]
                        u, n = int(mine.sum()), int(theirs.sum())
                        if u:
                            table[own] += share[other] * mine * (factorial(u - 1) * factorial(n) / factorial(u + n))
                        if n:
                            table[own] -= share[other] * theirs * (factorial(u) * factorial(n - 1) / factorial(u + n))
            out.append((features, low, high, table * tree.value[node]))

    walk(0, {})
    return out
