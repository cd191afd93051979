"""Poisson regression of rates on features, for all components in one pass over the loci per step."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest change of a coefficient in one step.
LONGEST = 20.0


class LinearRate:
    """log rate = x . beta[k]; beta is K x features, the last columns being corpus indicators."""

    kind = "linear"
    #: A product of few numbers: loci needn't be rated before cells are.
    by_cell = True

    def __init__(self, k: int, width: int):
        self.beta = np.zeros((k, width))

    def log_rate(self, x: np.ndarray) -> np.ndarray:
        return x @ self.beta.T

    def grown(self, x: np.ndarray, logmu: np.ndarray) -> np.ndarray:
        """The log rate after a fit; logmu, the one before, is of no use here."""
        return self.log_rate(x)

    def columns(self, x: Column) -> Column:
        """log_rate() as an array Column of K over the array Column x: rates of a linear model are a projection of the loci."""
        rows = [[float(b) for b in row] for row in self.beta]
        if self.beta.size <= 256:
            return F.array(*[reduce(lambda a, b: a + b, (F.get(x, F.lit(j)) * F.lit(b) for j, b in enumerate(row))) for row in rows])
        beta = F.array(*[F.array(*map(F.lit, row)) for row in rows])
        return F.transform(beta, lambda b: F.aggregate(F.zip_with(b, x, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))

    def fit(self, targets: DataFrame, rate: float = 1.0, steps: int = 8, tolerance: float = 1e-6, ridge: float = 1e-8) -> LinearRate:
        """Newton's method on targets (x, target array of K, eta array of K), blended in by rate.

        Weighted deviance of y = target / (eta m) with weight eta m has the gradient of a Poisson model of
        target with exposure eta m, m = mean(target / eta); loci of exposure zero take no part.
        """
        new = LinearRate(*self.beta.shape)
        new.beta = self.beta.copy()
        scale = _means(targets, len(self.beta))
        best = np.full(len(self.beta), -np.inf)
        kept, step = new.beta.copy(), np.zeros_like(new.beta)
        for _ in range(steps):
            like, grad, hess = _moments(targets, new.beta, scale)
            worse = like < best - 1e-9 * np.abs(best)
            for k in range(len(new.beta)):
                if worse[k]:
                    step[k] /= 2  # back half way
                else:
                    best[k], kept[k] = like[k], new.beta[k]
                    h = hess[k] + np.eye(len(grad[k])) * (ridge * max(1.0, np.trace(hess[k])))
                    step[k] = np.linalg.lstsq(h, grad[k], rcond=None)[0]
                    # shortened as a whole: it stays an ascent
                    step[k] *= min(1.0, LONGEST / max(np.abs(step[k]).max(), 1e-300))
            if np.abs(step).max() < tolerance:
                break
            new.beta = kept + step
        like, _, _ = _moments(targets, new.beta, scale)
        new.beta = np.where((like >= best)[:, None], new.beta, kept)
        new.beta = (1 - rate) * self.beta + rate * new.beta
        return new


def stacked(lists: pa.Array) -> np.ndarray:
    """A matrix of lists of equal length, without an object for each."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // max(1, len(lists)))


def one_row(**columns: np.ndarray) -> pa.RecordBatch:
    """A batch of one row of arrays of numbers."""
    return pa.RecordBatch.from_pydict({c: pa.array([np.asarray(v, float)], pa.list_(pa.float64())) for c, v in columns.items()})


def added(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    """The sums over rows (one a task) of columns that are arrays of equal length, entry by entry.

    Spark adds them up, so the driver gets as many numbers as the arrays have entries, whatever the number of tasks.
    """
    sizes = [F.size(c).alias(c) for c in columns]
    entries = rows.select(F.posexplode(F.concat(F.transform(F.array(*sizes), lambda n: n.cast("double")), *columns)).alias("at", "v"))
    got = entries.groupBy("at").agg(F.sum("v").alias("v"), F.count("*").alias("n")).collect()
    flat = np.array([r["v"] for r in sorted(got, key=lambda r: r["at"])])
    if not len(flat):
        return [np.zeros(0) for _ in columns]
    ends = np.cumsum([0, *np.rint(flat[: len(columns)] / max(r["n"] for r in got)).astype(int)]) + len(columns)
    return [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def _means(targets: DataFrame, k: int) -> np.ndarray:
    """Mean of target / eta per component over loci with exposure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not len(rows):
                continue
            t, e = stacked(rows.column("target")), stacked(rows.column("eta"))
            if ((e <= 0) & (t > 1e-9)).any():
                raise ValueError("a target where the exposure is zero")
            ok = e > 0
            yield one_row(s=np.where(ok, t / np.where(ok, e, 1), 0).sum(axis=0), n=ok.sum(axis=0))

    s, n = added(targets.select("target", "eta").mapInArrow(run, "s array<double>, n array<double>"), "s", "n")
    return np.maximum(s / np.maximum(n, 1), 1e-12) if len(s) else np.full(k, 1e-12)


def _moments(targets: DataFrame, beta: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information of every component."""
    shared = targets.sparkSession.sparkContext.broadcast((beta, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, m = shared.value
        k, p = b.shape
        like, grad, hess = np.zeros(k), np.zeros((k, p)), np.zeros((k, p, p))
        for rows in batches:
            if not len(rows):
                continue
            x, t, e = (stacked(rows.column(c)) for c in ("x", "target", "eta"))
            f = np.clip(x @ b.T, -30, 30)
            mu = e * m * np.exp(f)
            like += (t * f - mu).sum(axis=0)
            grad += (t - mu).T @ x
            hess += np.stack([(x * v[:, None]).T @ x for v in mu.T])
        yield one_row(like=like, grad=grad.ravel(), hess=hess.ravel())

    k, p = beta.shape
    like, grad, hess = added(targets.select("x", "target", "eta").mapInArrow(run, "like array<double>, grad array<double>, hess array<double>"), "like", "grad", "hess")
    shared.unpersist()
    return like, grad.reshape(k, p), hess.reshape(k, p, p)
