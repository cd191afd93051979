"""Tables that a plot shows as they are: rate tracks and matrices at a fixed number of bins, and matrices by segment."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import moving_average
from .durable import numbered


def binned(rows: DataFrame, n: int, bins: int, values: list[str], ordinal: str = "ordinal") -> DataFrame:
    """(bin, first, last, n, and of each value its mean, min and max): rows numbered 0 to n - 1 in at most bins stretches of equal length, give or take a row.

    The partial sums of a task are a row per bin, so what is shuffled depends on bins, not on rows.
    """
    at = F.floor(F.col(ordinal) * min(bins, max(n, 1)) / max(n, 1)).cast("int")
    told = [f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return rows.groupBy(at.alias("bin")).agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count("*").alias("n"), *told)


def rate_track(rates: DataFrame, value: str, order: list[str], bins: int, width: int) -> DataFrame:
    """A rate along the genome: shares of its total, raw and averaged over a centred window of width loci, in bins.

    Columns: bin, first, last, n, raw_mean, raw_min, raw_max, smooth_mean, smooth_min, smooth_max. Raw values add up to
    one over all loci, so do smoothed ones. A rate of null counts as zero. order must be total.
    """
    at = rates.select(*order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    smooth = numbered(moving_average(at, "_v", order, width, name="_s"), *order)
    told = smooth.agg(F.count("*").alias("n"), F.sum("_v").alias("v"), F.sum("_s").alias("s")).first()
    share = lambda c, total: (F.col(c) / F.lit(total)) if total else F.lit(0.0)
    rows = smooth.select("ordinal", share("_v", told["v"]).alias("raw"), share("_s", told["s"]).alias("smooth"))
    return binned(rows, told["n"], bins, ["raw", "smooth"])


def rate_matrix(rates: DataFrame, columns: list[str], order: list[str], bins: int) -> DataFrame:
    """(name, position, bin, first, last, share): each column as shares of its total along the genome, in bins; position puts like columns side by side.

    Means of shares over a bin's loci. One pass numbers the loci, one sums all columns by bin.
    """
    at = rates.select(*order, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = numbered(at, *order)
    told = rows.agg(F.count("*").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(len(columns))]).first()
    means = binned(rows, told["n"], bins, [f"v{i}" for i in range(len(columns))])
    at = dict(zip(columns, (f"v{i}" for i in range(len(columns))), strict=True))
    back = {v: c for c, v in at.items()}
    place = {back[v]: p for p, v in enumerate(column_order(rows, list(at.values())))}  # from the rows that are numbered, which are cut
    shares = [F.struct(F.lit(c).alias("name"), F.lit(place[c]).alias("position"), ((F.col(f"v{i}_mean") / F.lit(told[f"v{i}"])) if told[f"v{i}"] else F.lit(0.0)).alias("share")) for i, c in enumerate(columns)]
    return means.select("bin", "first", "last", F.explode(F.array(*shares)).alias("s")).select("s.name", "s.position", "bin", "first", "last", "s.share")


def cosine_distances(df: DataFrame, columns: list[str]) -> np.ndarray:
    """1 - the cosine of each two columns over all rows: one aggregation of their products, nulls as zeros. For some hundreds of columns."""
    v = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]
    row = df.agg(*[F.sum(v[i] * v[j]).alias(f"{i},{j}") for i in range(len(v)) for j in range(i, len(v))]).first()
    dot = np.array([[row[f"{min(i, j)},{max(i, j)}"] or 0.0 for j in range(len(v))] for i in range(len(v))])
    norm = np.sqrt(np.maximum(np.diag(dot), 1e-24))
    return 1 - dot / norm[:, None] / norm


def column_order(df: DataFrame, columns: list[str]) -> list[str]:
    """columns in the order of an average-linkage tree on cosine distance whose neighbours are least apart; of an order and its reverse, the one that starts with the column named first."""
    if not columns:
        return []
    at = distance_order(cosine_distances(df, columns))
    return [columns[i] for i in (at if at[0] <= at[-1] else at[::-1])]


def matrix_by_segment(matrix: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of a matrix keyed by locus, once per segment of the locus and by place: chrom, start, end, the matrix' columns. Loci of one table only have no rows."""
    columns = [c for c in matrix.columns if c != "locus"]
    placed = segments.select("locus", "chrom", "start", "end").join(matrix, "locus")
    return placed.select("chrom", "start", "end", *[f"`{c}`" for c in columns]).orderBy("chrom", "start", "end")


def total(columns: list[str]):
    """The sum of columns, nulls as zeros."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns))


def leaf_order(vectors: np.ndarray) -> list[int]:
    """Rows in the order of an average-linkage tree on cosine distance whose neighbours are least apart in sum; for at most some hundreds."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return distance_order(1 - v @ v.T)


def distance_order(d: np.ndarray) -> list[int]:
    """leaf_order() from the distances of each two rows.

    Of all orders that flip branches of the tree the best is found from the leaves up: a branch keeps
    the least sum for each pair of its outer leaves.
    """
    # a branch: its leaves, the least sum by first and last leaf, and how it is made
    branches = [([i], np.zeros((1, 1)), None) for i in range(len(d))]
    while len(branches) > 1:
        _, i, j = min((d[np.ix_(a[0], b[0])].mean(), i, j) for i, a in enumerate(branches) for j, b in enumerate(branches) if i < j)
        a, b = branches[i], branches[j]
        gap = d[np.ix_(a[0], b[0])]
        to_b = a[1][:, :, None] + gap[None]  # first of a, last of a, first of b
        step = to_b.min(axis=1)
        whole = step[:, :, None] + b[1][None]  # first of a, first of b, last of b
        least = whole.min(axis=1)
        none = lambda x: np.full((len(x[0]), len(x[0])), np.inf)
        made = np.block([[none(a), least], [least.T, none(b)]])
        branches = [x for n, x in enumerate(branches) if n not in (i, j)] + [(a[0] + b[0], made, (a, b, to_b.argmin(axis=1), whole.argmin(axis=1)))]

    def order(branch, first: int, last: int) -> list[int]:
        leaves, _, made = branch
        if made is None:
            return leaves
        a, b, end, begin = made
        if first >= len(a[0]):
            return order(branch, last, first)[::-1]
        start = begin[first, last - len(a[0])]
        return order(a, first, end[first, start]) + order(b, start, last - len(a[0]))

    if not branches:
        return []
    best = np.unravel_index(branches[0][1].argmin(), branches[0][1].shape)
    return order(branches[0], *map(int, best))
