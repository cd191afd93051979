"""Near-duplicate vectors by cosine: an exact metric range join over pivot cells.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so the join is a range join in a metric space.
A bounded sample of vectors are the pivots; a vector's home is the cell of its nearest pivot. By the
triangle inequality a vector within the radius r of another cell's vectors lies within r of the
bisector between both pivots, and within r of that cell's ball; only there it is copied, and for two
cells only from the one to the other. Each cell joins its own vectors with all that it holds,
independently of the others and in blocks of bounded size; large cells are cut into tasks of bounded
size, each pair of cells being met in exactly one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

MOST_PIVOTS = 2048
#: Home vectors, and vectors held, of one task.
TASK_HOME, TASK_HELD = 16_384, 65_536
BLOCK_CELLS = 4_000_000


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the sets of a[i] and b[i] joined for all i; a set's label is its smallest index."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(nxt := label[label], label):
            label = nxt
    return label


def unit(data: pd.Series, kind: str) -> np.ndarray:
    """Rows of unit length in double precision from equally long vectors' bytes."""
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares of tiny and huge components in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kind = np.float32 if pdf["single"].any() else np.float64
        good, data = [], []
        for v in pdf["vec"]:
            ok = v is not None and len(v) > 0
            if ok:
                a = np.array([np.nan if x is None else x for x in v], np.float64)
                ok = bool(np.isfinite(a).all() and (a != 0).any())
            good.append(ok)
            data.append((a + 0.0).astype(kind).tobytes() if ok else None)
        out = pd.DataFrame({"id": pdf["id"], "data": data})
        out["class"] = [hashlib.blake2b(d, digest_size=16).digest() if g else None for d, g in zip(data, good, strict=True)]
        yield out


def _geometry(pivots: np.ndarray, radius: float):
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells, distances to all pivots, and which cells the bisectors don't rule out."""
        dots = x @ pivots.T
        home = dots.argmax(axis=1)
        near = dots[np.arange(len(x)), home][:, None] - dots <= radius * gap[home] + 1e-9
        return home, np.sqrt(np.maximum(0.0, 2 - 2 * dots)), near

    return cells


def _crosses(home: np.ndarray, cell: int | np.ndarray) -> np.ndarray:
    """Whether vectors of other cells are copied to this one, and not the other way round: about half of the cells either way."""
    return (home != cell) & (((home + cell) % 2 == 0) == (cell < home))


def join_cell(x: np.ndarray, weight: np.ndarray, home_at: np.ndarray, held_at: np.ndarray, foreign: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights linked to each vector, and the labels of all vectors joined by links.

    Those at home_at meet those at held_at; a link counts for the first, and for the second where
    that is foreign (by place in x), since it is met here only. A vector that is both meets itself.
    Products are single precision first; those near the threshold are taken again in double.
    """
    home, held = x[home_at], x[held_at]
    h32, a32 = home.astype(np.float32), held.astype(np.float32)
    margin = max(1e-5, home.shape[1] * 2.4e-7) if home.size else 0
    total, label = np.zeros(len(x), np.int64), np.arange(len(x))
    step = max(1, BLOCK_CELLS // max(1, len(held)))
    for at in range(0, len(home), step):
        dots = h32[at : at + step] @ a32.T
        i, j = np.nonzero(dots >= cosine - margin)
        close = np.flatnonzero(dots[i, j] < cosine + margin)
        keep = np.ones(len(i), bool)
        for c in range(0, len(close), 65536):
            k = close[c : c + 65536]
            keep[k] = np.einsum("ij,ij->i", home[at + i[k]], held[j[k]]) >= cosine
        i, j = home_at[i[keep] + at], held_at[j[keep]]
        np.add.at(total, i, weight[j])
        other = foreign[j]
        np.add.at(total, j[other], weight[i[other]])
        label = union(label, i, j)
    return total, label


def range_join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id_col, n_links long, component_id, kept) of every row of vectors.

    Two vectors link when their cosine in double precision is at least ``cosine``; n_links counts
    the other rows linked directly, component_id is the smallest id reachable by links and kept
    says whether that is the row's own. Null and empty vectors, zero vectors and those with null or
    non-finite components link with nothing, as do vectors of different lengths with each other.
    Equal vectors are one class and count as often as they occur, also under one id. Rows with a
    null id link with nothing and aren't kept. Empty input: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    single = "float>" in vectors.schema[vector_col].dataType.simpleString()
    kind, dtype = vectors.schema[id_col].dataType.simpleString(), "<f4" if single else "<f8"
    radius = float(np.sqrt(2 - 2 * cosine))
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.lit(single).alias("single"))
    base = cut(base.mapInPandas(_valid, f"id {kind}, data binary, class binary"))
    classes = base.where("class IS NOT NULL AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("data").alias("data"))
    classes = cut(classes.withColumn("size", F.octet_length("data")))
    n = classes.count()
    n_pivots = min(MOST_PIVOTS, max(1, round(n**0.5 / 16)))
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(n_pivots).select("size", "data").collect()
    pivots = {s: unit(pd.Series([bytes(r["data"]) for r in sample if r["size"] == s]), dtype) for s in {r["size"] for r in sample}}
    first = {s: i * MOST_PIVOTS for i, s in enumerate(sorted(pivots))}
    shared = spark.sparkContext.broadcast((pivots, first))

    def homes(pdf: pd.DataFrame):
        """By length of vector: rows, units, home cells, distances, near cells; lengths without a pivot have one cell of their own."""
        known, base_cell = shared.value
        for size, part in pdf.groupby("size"):
            x = unit(part["data"], dtype)
            if size in known:
                home, far, near = _geometry(known[size], radius)(x)
                yield part, home, far, near, base_cell[size]
            else:
                yield part, np.zeros(len(x), np.int64), np.zeros((len(x), 1)), np.ones((len(x), 1), bool), -int(size)

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, home, far, near, cell in homes(pdf):
                k = near.shape[1]
                reach = np.zeros(k)
                np.maximum.at(reach, home, far[np.arange(len(home)), home])
                held = near & (_crosses(home[:, None], np.arange(k)) | (home[:, None] == np.arange(k)))
                yield pd.DataFrame({"cell": cell + np.arange(k), "home": np.bincount(home, minlength=k), "held": held.sum(axis=0), "reach": reach})

    rows = classes.select("size", "data").mapInPandas(survey, "cell long, home long, held long, reach double")
    seen = {r["cell"]: (r["home"], r["held"], r["reach"]) for r in rows.groupBy("cell").agg(F.sum("home").alias("home"), F.sum("held").alias("held"), F.max("reach").alias("reach")).collect()}
    cut_in = {c: (-(-a // TASK_HOME), -(-b // TASK_HELD), r) for c, (a, b, r) in seen.items() if a}
    plan = spark.sparkContext.broadcast(cut_in)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = plan.value
        for whole in batches:
            for at in range(0, len(whole), 2000):
                for part, home, far, near, offset in homes(whole.iloc[at : at + 2000]):
                    number = np.array([int.from_bytes(c[:6], "little") for c in part["class"]])
                    for q in range(near.shape[1]):
                        if offset + q not in cells:
                            continue
                        a, b, reach = cells[offset + q]
                        own, copied = np.flatnonzero(home == q), np.flatnonzero(near[:, q] & (far[:, q] <= reach + radius + 1e-9) & _crosses(home, q))
                        i, j = number % a, number // a % b
                        # a home vector goes to all tasks of its row, a held one to all of its column
                        as_home = np.repeat(own, b), np.repeat(i[own], b), np.tile(np.arange(b), len(own))
                        as_held = np.repeat(own, a), np.tile(np.arange(a), len(own)), np.repeat(j[own], a)
                        away = as_held[1] != i[as_held[0]]  # where it is not at home as well
                        as_foreign = np.repeat(copied, a), np.tile(np.arange(a), len(copied)), np.repeat(j[copied], a)
                        at_, row, column = (np.concatenate([x, y[away], w]) for x, y, w in zip(as_home, as_held, as_foreign, strict=True))
                        role = np.r_[1 + 2 * (as_home[2] == j[as_home[0]]), np.full(away.sum(), 2), np.full(len(as_foreign[0]), 6)]
                        if len(at_):
                            yield part[["id", "m", "data", "class"]].iloc[at_].assign(cell=offset + q, i=row, j=column, role=role)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, role = unit(pdf["data"], dtype), pdf["role"].to_numpy()
        at_home, at_held = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        ids = pdf["id"].to_numpy()
        links, label = join_cell(x, pdf["m"].to_numpy(), at_home, at_held, (role & 4) > 0, cosine)
        tell = (links > 0) | (label != np.arange(len(ids)))
        return pd.DataFrame({"class": pdf["class"].to_numpy()[tell], "id": ids[tell], "links": links[tell], "root": ids[label][tell]})

    columns = f"id {kind}, m long, data binary, class binary, cell long, i long, j long, role long"
    dealt = classes.select("class", "id", "m", "size", "data").mapInPandas(deal, columns)
    met = dealt.groupBy("cell", "i", "j").applyInPandas(joined, f"class binary, id {kind}, links long, root {kind}")
    met = cut(met)
    found = connected_components(met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("class", F.col("id").alias("node")).join(links, "class", "left").join(found, "node", "left")
    known = known.select("class", "links", F.coalesce("component", "node").alias("comp"))
    out = base.select("id", "class").join(known, "class", "left")
    usable = F.col("id").isNotNull() & F.col("class").isNotNull()
    component = F.when(usable, F.col("comp")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(usable, F.col("links") - 1).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
