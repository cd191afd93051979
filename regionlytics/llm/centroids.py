"""Centroid clustering: plain Lloyd rounds in exact integer arithmetic.

Components become integers once and are kept as bytes. A round broadcasts the centroids (k times
``width`` integers), takes in each partition every vector's squared differences to each centroid,
gives it to the nearest one, and hands on one row of integer sums for each centroid and partition;
groupBy merges these. So the driver gets k rows a round, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Scaled components below this keep a squared distance of 64 components below 2**60.
TOO_FAR = 1 << 26
#: Vectors whose differences are held at once.
BLOCK = 8192


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row of integers as bytes whose order is that of the rows."""
    return [v.tobytes() for v in (x.astype(np.int64) + (1 << 31)).astype(">u4")]


def _matrix(data: list[bytes] | pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), ">u4").reshape(len(data), width).astype(np.int64) - (1 << 31)


def _integers(scale: int, width: int):
    """Rows (id, vec) as (id, data), those that aren't usable left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[np.array([v is not None and len(v) == width for v in pdf["vec"]], bool)]
            x = np.array([np.asarray(v, np.float64) for v in pdf["vec"]], np.float64).reshape(len(pdf), width)
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
            good = (np.abs(x) < TOO_FAR).all(axis=1)  # false for NaN, which nulls are here
            yield pd.DataFrame({"id": pdf["id"][good], "data": _packed(x[good])})

    return run


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the number of the nearest centroid, the lowest of equally near ones, and the squared distance."""
    far = np.stack([np.square(x - c).sum(axis=1) for c in centroids])
    number = far.argmin(axis=0)
    return number, far[number, np.arange(len(x))]


def _blocks(batches: Iterator[pd.DataFrame], width: int, centroids: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    for pdf in batches:
        for at in range(0, len(pdf), BLOCK):
            part = pdf.iloc[at : at + BLOCK]
            x = _matrix(part["data"], width)
            yield part, x, *nearest(x, centroids)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, x, number, _ in _blocks(batches, width, shared.value):
            count += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += x[number == c].sum(axis=0)
        used = np.flatnonzero(count)
        if len(used):
            yield pd.DataFrame({"cluster": used, "n": count[used], "total": list(total[used])})

    parts = rows.select("data").mapInPandas(sums, "cluster int, n long, total array<long>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[exact(F.col("total")[i]) for i in range(width)]).alias("total")).collect()
    out = centroids.copy()
    for r in merged:
        out[r["cluster"]] = [int(s) // r["n"] for s in r["total"]]
    shared.unpersist()
    return out


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster int, distance long) of every usable row, and the final centroids.

    Usable are vectors of exactly ``width`` components, none null or non-finite; a component x counts
    as floor(scale * x), x in double precision. Vectors with one of 2**26 or more after that, either
    sign, don't fit 64-bit distances and are left out as well. The k usable rows with the smallest
    SHA-256 of "seed:id" are the first centroids, of equal ids those with the smaller components;
    fewer rows make fewer centroids. A round gives every vector to its nearest centroid, ties to the
    smaller number, and moves each centroid that has vectors to the floor of their mean; then vectors
    are assigned once more. Rows are vectors, so repeated ids stay; a null id is hashed as no digits.
    An empty table gives no rows and no centroids. Other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
    rows = cut(rows.mapInPandas(_integers(scale, width), f"id {kind}, data binary"))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = rows.select(F.sha2(text, 256).alias("sha"), "data").orderBy("sha", "data").limit(k).collect()
    centroids = _matrix([bytes(r["data"]) for r in first], width)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(rows, centroids)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if len(shared.value):
            for part, _, number, far in _blocks(batches, width, shared.value):
                yield pd.DataFrame({"id": part["id"], "cluster": number, "distance": far})

    out = rows.mapInPandas(assign, f"id {kind}, cluster int, distance long")
    return out.withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned (cluster, distance, ...) with cluster_inertia and inertia, the distances summed over the cluster and over all, and centroid_sha256.

    Sums beyond 64 bits are null. The sums are a row for each centroid.
    """
    spark = assigned.sparkSession
    assigned = cut(assigned)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fit = lambda n: n if n < 1 << 63 else None
    sha = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    known = [(c, fit(s), fit(sum(sums.values())), sha(centroids[c])) for c, s in sums.items()]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster")
