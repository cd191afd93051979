"""Feature transforms fitted on all corpora stacked: power, minmax, quantile, standardize, robust, categorical.

fit() reads the table in a few aggregations and returns constants; transform() is Columns only, so
scoring needs no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import values_below
from .quantiles import percentiles, values_at

#: The order of transformed columns, by type; any other type passes through behind them.
ORDER = ("power", "minmax", "quantile", "standardize", "robust", "categorical")
QUANTILES = 1000
MOST_LEVELS = 254


@dataclass
class FeatureTransform:
    """types: feature to type; constants: feature to what its type needs; ordinal: categories as codes, else dummies."""

    types: dict[str, str]
    groups: dict[str, list[str]] = field(default_factory=dict)
    ordinal: bool = False
    constants: dict[str, Any] = field(default_factory=dict)

    def order(self) -> list[str]:
        rank = {t: i for i, t in enumerate(ORDER)}
        return sorted(self.types, key=lambda f: rank.get(self.types[f], len(ORDER)))

    def names(self) -> list[str]:
        """Output columns, in order."""
        out = []
        for f in self.order():
            if self.types[f] == "categorical" and not self.ordinal:
                out += [f"{f}={level}" for level in self.constants[f][1:]]
            else:
                out.append(f)
        return out

    def group_columns(self) -> dict[str, list[str]]:
        """Group to output columns; a feature may be in several, and is in ``all`` if in none."""
        out: dict[str, list[str]] = {}
        for f in self.order():
            own = [n for n in self.names() if n == f or (self.types[f] == "categorical" and n.rpartition("=")[0] == f and n not in self.types)]
            for g in self.groups.get(f) or ["all"]:
                out.setdefault(g, []).extend(own)
        return out

    def fit(self, df: DataFrame) -> FeatureTransform:
        kinds: dict[str, list[str]] = {}
        for f, t in self.types.items():
            kinds.setdefault(t, []).append(f)
        clean = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
        aggs: list[Column] = []
        for f in kinds.get("minmax", []):
            aggs += [F.min(clean(f)).alias(f"{f}|min"), F.max(clean(f)).alias(f"{f}|max")]
        for f in kinds.get("standardize", []):
            aggs += [F.avg(clean(f)).alias(f"{f}|mean"), F.stddev_pop(clean(f)).alias(f"{f}|std")]
        for f in kinds.get("categorical", []):
            aggs.append(F.array_sort(F.collect_set(F.col(f).cast("string"))).alias(f"{f}|levels"))
        row = df.agg(*aggs).first().asDict() if aggs else {}
        for f in kinds.get("minmax", []):
            self.constants[f] = (row[f"{f}|min"], row[f"{f}|max"])
        for f in kinds.get("standardize", []):
            self.constants[f] = (row[f"{f}|mean"], row[f"{f}|std"])
        if robust := kinds.get("robust", []):
            self.constants |= percentiles(df, robust, [0.25, 0.5, 0.75])
        if ranked := kinds.get("quantile", []):
            self.constants |= values_at(df, ranked, QUANTILES)
        for f in kinds.get("categorical", []):
            self.constants[f] = list(row[f"{f}|levels"])
            if self.ordinal and len(self.constants[f]) > MOST_LEVELS:
                raise ValueError(f"{f} has more than {MOST_LEVELS} levels")
        if powers := kinds.get("power", []):
            self._fit_powers(df, powers)
        return self

    def _fit_powers(self, df: DataFrame, features: list[str]) -> None:
        """Yeo-Johnson exponents of largest likelihood: grids that narrow, all features and points of a grid in one aggregation."""
        centre, width = {f: 0.0 for f in features}, 3.0
        for _ in range(6):
            grid = {f: [centre[f] + width * k / 4 for k in range(-4, 5)] for f in features}
            aggs = [F.stddev_pop(yeo_johnson(F.col(f).cast("double"), lam)).alias(f"{f}|{k}") for f in features for k, lam in enumerate(grid[f])]
            aggs += [F.sum(F.signum(F.col(f)) * F.log1p(F.abs(F.col(f).cast("double")))).alias(f"{f}|log") for f in features]
            aggs += [F.count(F.col(f)).alias(f"{f}|n") for f in features]
            row = df.agg(*aggs).first().asDict()
            for f in features:
                n, logs = row[f"{f}|n"], row[f"{f}|log"]
                if not n:
                    continue
                like = [-n * math.log(s) + (lam - 1) * logs if (s := row[f"{f}|{k}"]) and s > 1e-150 else -math.inf for k, lam in enumerate(grid[f])]
                centre[f] = grid[f][int(np.argmax(like))]
            width /= 3
        moments = df.agg(*[x for f in features for x in (F.avg(yeo_johnson(F.col(f).cast("double"), centre[f])).alias(f"{f}|m"), F.stddev_pop(yeo_johnson(F.col(f).cast("double"), centre[f])).alias(f"{f}|s"))]).first().asDict()
        for f in features:
            self.constants[f] = (centre[f], moments[f"{f}|m"], moments[f"{f}|s"])

    def columns(self) -> list[Column]:
        out: list[Column] = []
        for f in self.order():
            kind, c, x = self.types[f], self.constants.get(f), F.col(f).cast("double")
            if kind == "power":
                out.append(_scaled(yeo_johnson(x, c[0]), c[1], c[2]).alias(f))
            elif kind == "minmax":
                out.append(_scaled(x, c[0], c[1] - c[0]).alias(f))
            elif kind == "standardize":
                out.append(_scaled(x, c[0], c[1]).alias(f))
            elif kind == "robust":
                out.append(_scaled(x, c[1], c[2] - c[0]).alias(f))
            elif kind == "quantile":
                out.append(quantile_rank(x, c).alias(f))
            elif kind == "categorical" and self.ordinal:
                out.append((F.array_position(F.array(*[F.lit(v) for v in c]), F.col(f).cast("string")) - 1).cast("double").alias(f))
            elif kind == "categorical":
                out += [(F.col(f).cast("string") == F.lit(v)).cast("double").alias(f"{f}={v}") for v in c[1:]]
            else:
                out.append(x.alias(f))
        return out

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """keep and the transformed columns; df must have the features that were fitted."""
        if missing := set(self.types) - set(df.columns):
            raise ValueError(f"features are missing: {sorted(missing)}")
        return df.select(*keep, *self.columns())


def _scaled(x: Column, centre: float, scale: float) -> Column:
    """(x - centre) / scale; a constant column becomes zero."""
    return (x - F.lit(centre)) / F.lit(scale if scale else 1.0)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def quantile_rank(x: Column, grid: list[float]) -> Column:
    """Where x lies among the quantiles in grid, from 0 to 1, interpolated; the middle of a run of equal ones."""
    g = F.array(*[F.lit(float(v)) for v in grid])
    n = len(grid) - 1
    # the places are looked up once: what an element of an array is made of isn't made again where it is used
    found = F.array(F.struct(values_below(grid, x).alias("below"), values_below(grid, x, equal=True).alias("upto")))

    def inside(at: Column) -> Column:
        below, upto = at["below"], at["upto"]
        lo, hi = F.get(g, below - 1), F.get(g, below)
        between = (below - 1 + (x - lo) / (hi - lo)) / n
        return F.when(upto > below, (below + upto - 1) / 2 / n).otherwise(between)

    return F.when(x <= grid[0], F.lit(0.0)).when(x >= grid[-1], F.lit(1.0)).otherwise(F.get(F.transform(found, inside), F.lit(0)))


def corpus_dummies(df: DataFrame, corpora: list[str]) -> list[Column]:
    """One indicator per corpus, none dropped."""
    return [(F.col("corpus") == c).cast("double").alias(f"corpus={c}") for c in corpora]


def second_degree(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """keep, the features, and all their squares and products."""
    products = [(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}*{b}") for i, a in enumerate(features) for b in features[i:]]
    return df.select(*keep, *[F.col(f"`{f}`") for f in features], *products)
