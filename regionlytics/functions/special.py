"""Gamma-family functions and log-sums, as Columns and for numpy."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arguments below this are shifted up by the recurrence before the asymptotic series is used.
SHIFT = 8
STEPS = np.arange(SHIFT)
HALF_LOG_2PI = 0.9189385332046727


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def values_below(grid, x: Column, equal: bool = False) -> Column:
    """How many of the ascending values in grid are below x, or with equal not above it: a search by halves. NaN is above all, null has none."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(grid).bit_length()))]).cast("array<int>")
    values = F.array(*[F.lit(float(v)) for v in grid]).cast("array<double>")
    fits = (lambda v: v <= x) if equal else (lambda v: v < x)
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(fits(F.get(values, n + s - 1)), n + s).otherwise(n))


def digamma(x: Column | str) -> Column:
    """psi(x) for x > 0: the recurrence up to x + SHIFT, then the asymptotic series."""
    x = _c(x)
    y = x + SHIFT
    r = 1 / (y * y)
    series = F.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    for i in range(SHIFT):
        series = series - 1 / (x + i)
    return series


def trigamma(x: Column | str) -> Column:
    """psi'(x) for x > 0."""
    x = _c(x)
    y = x + SHIFT
    r = 1 / (y * y)
    series = 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))
    for i in range(SHIFT):
        series = series + 1 / ((x + i) * (x + i))
    return series


def lgamma(x: Column | str) -> Column:
    """log Gamma(x) for x > 0."""
    x = _c(x)
    y = x + SHIFT
    r = 1 / (y * y)
    series = (y - 0.5) * F.log(y) - y + HALF_LOG_2PI + 1 / y * (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680)))
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    return series - F.log(product)


def xlogy(x: Column | str, y: Column | str) -> Column:
    """x log y, zero where x is."""
    return F.when(_c(x) == 0, F.lit(0.0)).otherwise(_c(x) * F.log(_c(y)))


def logsumexp(df: DataFrame, value: str, *keys: str, alias: str = "logsumexp") -> DataFrame:
    """(keys, alias): log of the sum of exponentials per key, in two aggregations; null and NaN count as -inf."""
    clean = df.withColumn("_v", F.when(F.col(value).isNull() | F.isnan(value), F.lit(float("-inf"))).otherwise(F.col(value)))
    top = clean.groupBy(*keys).agg(F.max("_v").alias("_m"))
    joined = clean.join(top, list(keys)) if keys else clean.crossJoin(F.broadcast(top))  # without keys top is one row
    shifted = F.when(F.col("_m") == float("-inf"), F.lit(0.0)).otherwise(F.exp(F.col("_v") - F.col("_m")))
    return joined.groupBy(*keys, "_m").agg(F.sum(shifted).alias("_s")).select(*keys, (F.log("_s") + F.col("_m")).alias(alias))


def np_digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = -(1 / (x[..., None] + STEPS)).sum(axis=-1)
    y = x + SHIFT
    r = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def np_trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = (1 / (x[..., None] + STEPS) ** 2).sum(axis=-1)
    y = x + SHIFT
    r = 1 / (y * y)
    return out + 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def np_lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = x + SHIFT
    r = 1 / (y * y)
    product = x.copy()
    for i in range(1, SHIFT):
        product = product * (x + i)
    return (y - 0.5) * np.log(y) - y + HALF_LOG_2PI + 1 / y * (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) - np.log(product)


def np_logsumexp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    x = np.where(np.isnan(x), -np.inf, x)
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.squeeze(axis) if axis is not None else out.item()


def dirichlet_expectation(gamma: Column, total: Column) -> Column:
    """E[log p] under a Dirichlet with parameter gamma of sum total."""
    return digamma(gamma) - digamma(total)


def np_dirichlet_expectation(g: np.ndarray) -> np.ndarray:
    d = np_digamma(np.concatenate([g, g.sum(axis=-1, keepdims=True)], axis=-1))
    return d[..., :-1] - d[..., -1:]


def dirichlet_bound(alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """The Dirichlet part of the evidence bound, per row of gamma."""
    e = np_dirichlet_expectation(gamma)
    return np_lgamma(alpha.sum()) - np_lgamma(gamma.sum(axis=-1)) + (np_lgamma(gamma) - np_lgamma(alpha) + (alpha - gamma) * e).sum(axis=-1)


def dirichlet_multinomial_logprob(alpha: np.ndarray, counts: np.ndarray) -> float:
    """log P(counts) of a Dirichlet-multinomial, without the multinomial coefficient."""
    a, n = alpha.sum(), counts.sum()
    return float(np_lgamma(a) - np_lgamma(a + n) + (np_lgamma(alpha + counts) - np_lgamma(alpha)).sum())


def dirichlet_multinomial(alpha: list[float], counts: list[Column | str]) -> Column:
    """dirichlet_multinomial_logprob() as a Column, of one count for each entry of alpha."""
    total = reduce(lambda a, b: a + b, map(_c, counts))
    own = [lgamma(_c(c) + float(a)) - lgamma(F.lit(float(a))) for a, c in zip(alpha, counts, strict=True)]
    return lgamma(F.lit(float(sum(alpha)))) - lgamma(total + float(sum(alpha))) + reduce(lambda a, b: a + b, own)


def learning_rate(step: int | Column, tau: float = 16.0, kappa: float = 0.5, full_batch: bool = False) -> float | Column:
    """One for full batches, else (tau + step) ** -kappa; of a Column of steps a Column."""
    if full_batch:
        return 1.0
    rate = (tau + step) ** -kappa
    return rate if isinstance(rate, Column) else float(rate)


def blend(old, new, rate: float | Column):
    """(1 - rate) old + rate new, for numbers, arrays and Columns."""
    return (1 - rate) * old + rate * new
