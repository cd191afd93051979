"""Poisson gradient boosting of rates on binned features; histograms are summed where the loci lie.

Loci of the same bins and corpus have the same rate under any trees, so a fit first adds them up: its
some 100 passes read a row for each such group that occurs, never more rows than there are loci.
A tree grows level by level: every partition sums gradients and curvatures by node, feature and bin,
the driver picks the splits. Feature groups are interaction constraints: a path uses features of
one group only. A share of loci, chosen by hash, is held out to stop early. Targets carry the log rate
of all earlier trees (logmu), so a fit evaluates its own new trees only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import values_below
from ..operators.durable import cut
from .linear import added, stacked

#: Log rates are kept within this of zero.
FARTHEST = 30
#: Combinations of bins up to which rows are rated by combination.
FEW_BINS = 50_000


class Tree:
    """Arrays of nodes: feature (-1 in a leaf), bin that goes left, children, value."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, n, n + 1
        for _ in range(2):
            for a, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                a.append(v)
        return n, n + 1

    def leaves(self, b: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), int)
        f, s, left, right = map(np.array, (self.feature, self.bin, self.left, self.right))
        while (inner := f[node] >= 0).any():
            i = np.flatnonzero(inner)
            go = b[i, f[node[i]]] <= s[node[i]]
            node[i] = np.where(go, left[node[i]], right[node[i]])
        return node

    def predict(self, b: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(b)]


class BoostedRate:
    """log rate = sum of trees + a bias per corpus (the last columns of x are corpus indicators)."""

    kind = "gbt"

    def __init__(self, k: int, width: int, n_corpora: int, bins: int = 32, depth: int = 3, learning_rate: float = 0.1, rounds: int = 20, patience: int = 3, least: float = 5.0, l2: float = 1.0, groups: list[list[int]] | None = None, held_out: float = 0.2):
        self.n_features, self.n_corpora, self.bins, self.depth = width - n_corpora, n_corpora, bins, depth
        self.learning_rate, self.rounds, self.patience, self.least, self.l2, self.groups, self.held_out = learning_rate, rounds, patience, least, l2, groups, held_out
        self.edges: list[np.ndarray] | None = None
        self.trees: list[list[tuple[float, Tree]]] = [[] for _ in range(k)]
        self.bias = np.zeros((k, n_corpora))
        #: The number of trees and the bias before the last fit.
        self.first, self.old_bias = [0] * k, self.bias

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    @property
    def by_cell(self) -> bool:
        """Whether bins are few enough to rate many rows by what differs among them."""
        return (self.bins + 1) ** self.n_features <= FEW_BINS

    def log_rate(self, x: np.ndarray) -> np.ndarray:
        out = x[:, self.n_features :] @ self.bias.T
        if self.edges is not None and self.n_features:
            b, at = self.binned(x), None
            if self.by_cell:
                # rows of the same bins have the same trees' values
                _, first, at = np.unique(b @ (self.bins + 1) ** np.arange(self.n_features), return_index=True, return_inverse=True)
                b = b[first]
            told = np.zeros((len(b), len(self.trees)))
            for k, trees in enumerate(self.trees):
                for r, t in trees:
                    told[:, k] += r * t.predict(b)
            out += told if at is None else told[at]
        return out

    def grown(self, x: np.ndarray, logmu: np.ndarray) -> np.ndarray:
        """The log rate from logmu, the one before the last fit: only trees since then are evaluated."""
        new = self.edges is not None and self.n_features and any(len(t) > n for t, n in zip(self.trees, self.first, strict=True))
        return self._grown(self.binned(x) if new else None, x[:, self.n_features :], logmu)

    def _grown(self, b: np.ndarray | None, who: np.ndarray, logmu: np.ndarray) -> np.ndarray:
        """grown() from bins and corpus indicators."""
        out = logmu + who @ (self.bias - self.old_bias).T
        for k, trees in enumerate(self.trees if b is not None else []):
            for r, t in trees[self.first[k] :]:
                out[:, k] += r * t.predict(b)
        return out

    def grouped(self, targets: DataFrame) -> DataFrame:
        """(held, b, who, target, eta, logmu): targets added up by bins and corpus, and the held-out ones apart.

        A group's rate is that of its summed exposure, so what the trees do to it is what they do to its loci;
        the held-out loss differs by a constant from that of the loci.
        """
        k = len(self.trees)
        held = F.pmod(F.xxhash64("corpus", "locus"), F.lit(1000)) < int(1000 * self.held_out)
        b = F.array(*[values_below(e, F.get("x", F.lit(j))) for j, e in enumerate(self.edges or [])]).cast("array<int>")
        at = lambda c, i: F.get(c, F.lit(i))
        near = lambda c: F.least(F.greatest(c, F.lit(-float(FARTHEST))), F.lit(float(FARTHEST)))
        sums = lambda f: F.array(*[F.sum(f(i)) for i in range(k)])
        rows = targets.select(held.alias("held"), b.alias("b"), F.slice("x", self.n_features + 1, self.n_corpora).alias("who"), "target", "eta", "logmu")
        mass = sums(lambda i: at("eta", i) * F.exp(near(at("logmu", i)))).alias("mass")
        g = rows.groupBy("held", "b", "who").agg(sums(lambda i: at("target", i)).alias("target"), sums(lambda i: at("eta", i)).alias("eta"), mass)
        logmu = lambda m, e: F.when(e > 0, F.log(m / e)).otherwise(0.0)
        return g.select("held", "b", "who", "target", "eta", F.zip_with("mass", "eta", logmu).alias("logmu"))

    def fit(self, targets: DataFrame, rate: float = 1.0, **_) -> BoostedRate:
        """More trees on targets (corpus, locus, x, target, eta, logmu), each shrunk by rate; earlier trees stay (warm start).

        targets is read once or twice, its groups some 100 times; logmu is this model's own log rate.
        """
        new = BoostedRate(len(self.trees), self.n_features + self.n_corpora, self.n_corpora, self.bins, self.depth, self.learning_rate, self.rounds, self.patience, self.least, self.l2, self.groups, self.held_out)
        new.edges, new.trees, new.bias = self.edges, [list(t) for t in self.trees], self.bias.copy()
        first = new.first = [len(t) for t in new.trees]
        new.old_bias = self.bias
        if new.edges is None and self.n_features:
            q = [i / self.bins for i in range(1, self.bins)]
            row = targets.agg(*[F.percentile_approx(F.get("x", F.lit(j)), q, 1000).alias(f"q{j}") for j in range(self.n_features)]).first()
            new.edges = [np.unique(np.array(row[f"q{j}"] or [0.0], float)) for j in range(self.n_features)]
        data = cut(new.grouped(targets))
        new.bias, best = new._settle(data)
        stale = np.zeros(len(new.trees), int)
        keep = [len(t) for t in new.trees]
        for _ in range(self.rounds if self.n_features else 0):
            active = stale < self.patience
            if not active.any():
                break
            new._grow(data, active)
            new.bias, loss = new._settle(data)
            for k in np.flatnonzero(active):
                if loss[k] < best[k] - 1e-9:
                    best[k], stale[k], keep[k] = loss[k], 0, len(new.trees[k])
                else:
                    stale[k] += 1
        for k in range(len(new.trees)):
            new.trees[k] = new.trees[k][: first[k]] + [(r * rate, t) for r, t in new.trees[k][first[k] : keep[k]]]
        new.bias = (1 - rate) * self.bias + rate * new._settle(data)[0]
        return new

    def _sums(self, data: DataFrame, f, size: int, where: str = "true") -> np.ndarray:
        shared = data.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, model = np.zeros(size), shared.value
            for rows in batches:
                if len(rows):
                    b, who, t, e, before = (stacked(rows.column(c)) for c in ("b", "who", "target", "eta", "logmu"))
                    lr = np.clip(model._grown(b if model.n_features else None, who, before), -FARTHEST, FARTHEST)
                    out += f(model, b, who, t, e, lr, rows.column("held").to_numpy(zero_copy_only=False)).ravel()
            yield pa.RecordBatch.from_pydict({"s": pa.array([out], pa.list_(pa.float64()))})

        (s,) = added(data.where(where).mapInArrow(run, "s array<double>"), "s")
        shared.unpersist()
        return s if len(s) else np.zeros(size)

    def _settle(self, data: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Per corpus the log of the weighted targets over the weighted predictions without bias; and the loss of the loci held out under that bias."""

        def f(model, b, who, t, e, lr, held):
            plain = np.clip(lr - who @ model.bias.T, -FARTHEST, FARTHEST)
            mass, out = e * np.exp(plain), []
            for rows in (~held, held):
                out += [who[rows].T @ t[rows], who[rows].T @ mass[rows], who[rows].T @ (t * plain)[rows]]
            return np.stack(out)

        k = len(self.trees)
        s = self._sums(data, f, 6 * self.n_corpora * k).reshape(6, self.n_corpora, k)
        bias = np.log((s[0] + 1e-9) / (s[1] + 1e-9))
        loss = (np.exp(bias) * s[4] - s[5] - bias * s[3]).sum(axis=0)
        return bias.T, loss

    def _grow(self, data: DataFrame, active: np.ndarray) -> None:
        """One more tree for each active component."""
        k, p, nb = len(self.trees), self.n_features, self.bins + 1
        grown = [Tree() for _ in range(k)]
        open_nodes = [[0] if a else [] for a in active]
        paths: list[dict[int, set[int]]] = [{0: set()} for _ in range(k)]
        for level in range(max(1, self.depth)):
            slots = {(c, n): i for i, (c, n) in enumerate((c, n) for c in range(k) for n in open_nodes[c])}
            if not slots:
                break

            def f(model, b, who, t, e, lr, held, slots=slots, trees=grown):
                mu = e * np.exp(lr)
                out = np.zeros((len(slots), p, nb, 2))
                for c in {c for c, _ in slots}:
                    leaf = trees[c].leaves(b)
                    for n in {n for d, n in slots if d == c}:
                        i = np.flatnonzero(leaf == n)
                        for j in range(p):
                            out[slots[c, n], j, :, 0] = np.bincount(b[i, j], weights=(t - mu)[i, c], minlength=nb)[:nb]
                            out[slots[c, n], j, :, 1] = np.bincount(b[i, j], weights=mu[i, c], minlength=nb)[:nb]
                return out

            h = self._sums(data, f, len(slots) * p * nb * 2, "NOT held").reshape(len(slots), p, nb, 2)
            upcoming: list[list[int]] = [[] for _ in range(k)]
            for (c, n), i in slots.items():
                g, w = h[i, 0, :, 0].sum(), h[i, 0, :, 1].sum()
                if not level:
                    grown[c].value[n] = self.learning_rate * g / (w + self.l2)
                split = self._best(h[i], g, w, paths[c][n]) if self.depth else None
                if split:
                    gl, wl = h[i, split[0], : split[1] + 1].sum(axis=0)
                    for child, (gc, wc) in zip(grown[c].split(n, *split), ((gl, wl), (g - gl, w - wl)), strict=True):
                        grown[c].value[child] = self.learning_rate * gc / (wc + self.l2)
                        paths[c][child] = paths[c][n] | {split[0]}
                        upcoming[c].append(child)
            open_nodes = upcoming
        for c in np.flatnonzero(active):
            self.trees[c].append((1.0, grown[c]))

    def _best(self, h: np.ndarray, g: float, w: float, used: set[int]) -> tuple[int, int] | None:
        allowed = set(range(self.n_features))
        if self.groups and used:
            allowed = set().union(*[set(x) for x in self.groups if used <= set(x)] or [set()])
        best, gain = None, 1e-9
        for j in allowed:
            gl, wl = np.cumsum(h[j, :, 0])[:-1], np.cumsum(h[j, :, 1])[:-1]
            gr, wr = g - gl, w - wl
            value = gl**2 / (wl + self.l2) + gr**2 / (wr + self.l2) - g**2 / (w + self.l2)
            value[(wl < self.least) | (wr < self.least)] = -np.inf
            at = int(np.argmax(value))
            if value[at] > gain:
                best, gain = (j, at), value[at]
        return best
