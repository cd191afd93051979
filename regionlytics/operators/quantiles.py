"""Exact order statistics of whole columns by histograms that refine, whatever the number of rows.

Doubles are taken as 64-bit keys of the same order. A pass counts the next bits of those keys that
begin like one of the wanted values, by partition, and the sums by bin come to the driver: the bin
that a rank falls in gives its value's next bits. When few enough values are left the last pass takes
them themselves. So a pass holds at most BINS counters a column in a task, and brings no more rows back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, bits that a pass takes at most, and values that may come back at the end, by column.
BINS, BITS, LAST = 1 << 18, 16, 50_000


def keys_of(x: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of doubles without NaN; both zeros have one."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def value_of(key: int) -> float:
    u = np.array([key], np.uint64)
    return float(np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u).view(np.float64)[0])


class _Search:
    """The wanted ranks of a column: by the bits of their values known so far (prefix), each rank and its place among those values."""

    def __init__(self, ranks: Callable[[int], set[int]]):
        self.ranks, self.n, self.bits, self.left = ranks, 0, 0, 0
        self.wanted: dict[int, list[tuple[int, int]]] = {0: []}
        self.found: dict[int, float] = {}

    def prefixes(self) -> np.ndarray:
        return np.array(sorted(self.wanted), np.uint64)

    def width(self) -> int:
        """The bits that the next pass takes."""
        return min(BITS, 64 - self.bits, max(1, (BINS // len(self.wanted)).bit_length() - 1))

    def narrow(self, width: int, counts: dict[int, int]) -> None:
        """counts: by a prefix's place x 2**width + the next bits, how many values there are."""
        if not self.bits:
            self.n = sum(counts.values())
            self.wanted = {0: [(r, r) for r in sorted(self.ranks(self.n))]} if self.n else {}
        new: dict[int, list[tuple[int, int]]] = {}
        self.left = 0
        own: dict[int, list[int]] = {}
        for b in sorted(counts):
            own.setdefault(b >> width, []).append(b)
        for place, prefix in enumerate(sorted(self.wanted)):
            bins = own.get(place, [])
            ends = np.cumsum([counts[b] for b in bins])
            for rank, rest in self.wanted[prefix]:
                i = int(np.searchsorted(ends, rest, "right"))
                at = (prefix << width) | (bins[i] & ((1 << width) - 1))
                if at not in new:
                    self.left += counts[bins[i]]
                new.setdefault(at, []).append((rank, rest - int(ends[i] - counts[bins[i]])))
        self.bits, self.wanted = self.bits + width, new
        if self.bits == 64:
            self.finish({prefix: 1 << 62 for prefix in new})

    def finish(self, values: dict[int, int]) -> None:
        """values: how often each key below the prefixes occurs."""
        own: dict[int, list[int]] = {}
        for k in sorted(values):
            own.setdefault(k >> (64 - self.bits), []).append(k)
        for prefix, ranks in self.wanted.items():
            ends = np.cumsum([values[k] for k in own[prefix]])
            for rank, rest in ranks:
                self.found[rank] = value_of(own[prefix][int(np.searchsorted(ends, rest, "right"))])
        self.wanted = {}


def _keys(pdf: pd.DataFrame, i: int) -> np.ndarray:
    x = pdf.iloc[:, i].to_numpy(np.float64)
    return keys_of(x[~np.isnan(x)])


def _count(columns: DataFrame, searches: dict[int, _Search]) -> None:
    """One pass: narrows the searches, by column, by the sizes of the bins below their prefixes."""
    asked = {i: (s.bits, s.width(), s.prefixes()) for i, s in searches.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {i: np.zeros(len(p) << w, np.int64) for i, (_, w, p) in asked.items()}
        for pdf in batches:
            for i, (bits, width, prefixes) in asked.items():
                key = _keys(pdf, i)
                place = np.zeros(len(key), np.int64)
                if bits:
                    head = key >> np.uint64(64 - bits)
                    place = np.minimum(np.searchsorted(prefixes, head), len(prefixes) - 1)
                    good = prefixes[place] == head
                    key, place = key[good], place[good]
                below = (key >> np.uint64(64 - bits - width)) & np.uint64((1 << width) - 1)
                totals[i] += np.bincount((place << width) + below.astype(np.int64), minlength=len(totals[i]))
        for i, t in totals.items():
            at = np.flatnonzero(t)
            if len(at):
                yield pd.DataFrame({"c": i, "bin": at, "n": t[at]})

    counts: dict[int, dict[int, int]] = {i: {} for i in searches}
    for r in columns.mapInPandas(run, "c int, bin long, n long").groupBy("c", "bin").agg(F.sum("n").alias("n")).collect():  # BINS rows a column
        counts[r["c"]][r["bin"]] = r["n"]
    for i, s in searches.items():
        s.narrow(asked[i][1], counts[i])


def _values(columns: DataFrame, searches: dict[int, _Search]) -> None:
    """One pass: ends the searches by the values below their prefixes."""
    asked = {i: (s.bits, s.prefixes()) for i, s in searches.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, (bits, prefixes) in asked.items():
                key = _keys(pdf, i)
                key, n = np.unique(key[np.isin(key >> np.uint64(64 - bits), prefixes)], return_counts=True)
                if len(key):
                    yield pd.DataFrame({"c": i, "key": key.view(np.int64), "n": n})

    values: dict[int, dict[int, int]] = {i: {} for i in searches}
    for r in columns.mapInPandas(run, "c int, key long, n long").groupBy("c", "key").agg(F.sum("n").alias("n")).collect():  # LAST rows a column
        values[r["c"]][r["key"] & (1 << 64) - 1] = r["n"]
    for i, s in searches.items():
        s.finish(values[i])


def order_statistics(df: DataFrame, features: list[str], ranks: Callable[[int], set[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    """For each feature n, its values that are neither null nor NaN, and the values at ranks(n), from 0, in their order."""
    columns = df.select(*[F.col(f"`{f}`").cast("double").alias(f"c{i}") for i, f in enumerate(features)])
    searches = {i: _Search(ranks) for i in range(len(features))}
    todo = searches
    while todo := {i: s for i, s in todo.items() if s.wanted}:
        # columns with few values left take the values themselves, the others go on by bits
        last = {i: s for i, s in todo.items() if s.left <= LAST and s.bits}
        if last:
            _values(columns, last)
        if len(last) < len(todo):
            _count(columns, {i: s for i, s in todo.items() if i not in last})
    return {f: (searches[i].n, searches[i].found) for i, f in enumerate(features)}


def percentiles(df: DataFrame, features: list[str], shares: list[float]) -> dict[str, list[float]]:
    """The values at shares of each feature's order, interpolated between neighbours; empty where it has no values."""
    places = lambda n: [(p * (n - 1), int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1)))) for p in shares]
    told = order_statistics(df, features, lambda n: {x for _, a, b in places(n) for x in (a, b)})
    return {f: [at[a] if a == b else (b - x) * at[a] + (x - a) * at[b] for x, a, b in places(n)] if n else [] for f, (n, at) in told.items()}


def values_at(df: DataFrame, features: list[str], parts: int) -> dict[str, list[float]]:
    """The parts + 1 values of each feature that cut its order into parts: the least one, then those of rank i / parts x n, rounded up in double precision."""
    places = lambda n: [max(0, int(np.ceil(i / parts * n)) - 1) for i in range(parts + 1)]
    return {f: [at[r] for r in places(n)] if n else [] for f, (n, at) in order_statistics(df, features, lambda n: set(places(n))).items()}
