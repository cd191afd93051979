"""Exact dedup through counting quotient filters.

Every input partition builds counting quotient filters over the 64-bit fingerprints of its texts:
the high bits of a fingerprint name a block (and the quotient inside it), the rest is the remainder,
and each distinct remainder carries a counter. Filters of the same block merge without loss, as a
merge of sorted remainders that adds counters. Only fingerprints whose merged count exceeds one
route their texts to a comparison of bytes; all others are unique without further work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_or_shuffled

#: Fingerprints that one merge task holds, about 16 bytes each.
BLOCK_FINGERPRINTS = 1_000_000


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints in sorted order, split into quotient and remainder.

    ``q_bits`` high bits address a slot; a run is the sorted remainders of one slot, kept in
    ``remainders`` from ``offsets[slot]`` to ``offsets[slot + 1]``; ``counts`` are their counters.
    """

    def __init__(self, q_bits: int, offsets: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q_bits, self.offsets, self.remainders, self.counts = q_bits, offsets, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, q_bits: int | None = None) -> CountingQuotientFilter:
        """From fingerprints in any order, repeated or not; counts default to one each."""
        fp = np.asarray(fingerprints, np.uint64)
        n = np.ones(len(fp), np.int64) if counts is None else np.asarray(counts, np.int64)
        order = np.argsort(fp, kind="stable")
        fp, n = fp[order], n[order]
        first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, first) if len(fp) else n
        fp = fp[first]
        q = max(1, int(len(fp)).bit_length() - 1) if q_bits is None else q_bits
        slots = (fp >> np.uint64(64 - q)).astype(np.int64)
        offsets = np.zeros((1 << q) + 1, np.int64)
        np.cumsum(np.bincount(slots, minlength=1 << q), out=offsets[1:])
        return cls(q, offsets, fp & np.uint64((1 << (64 - q)) - 1), n)

    def fingerprints(self) -> np.ndarray:
        slots = np.repeat(np.arange(len(self.offsets) - 1, dtype=np.uint64), np.diff(self.offsets))
        return (slots << np.uint64(64 - self.q_bits)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both multisets; no fingerprint and no count is lost."""
        return self.of(np.concatenate([self.fingerprints(), other.fingerprints()]), np.concatenate([self.counts, other.counts]))

    def count(self, fingerprint: int) -> int:
        s = int(fingerprint) >> (64 - self.q_bits)
        lo, hi = int(self.offsets[s]), int(self.offsets[s + 1])
        r = np.uint64(int(fingerprint) & ((1 << (64 - self.q_bits)) - 1))
        at = lo + int(np.searchsorted(self.remainders[lo:hi], r))
        return int(self.counts[at]) if at < hi and self.remainders[at] == r else 0

    def to_bytes(self) -> bytes:
        """Run lengths, remainders and counters, each in the narrowest whole-byte type that holds them."""
        runs = np.diff(self.offsets)
        parts = [np.array([self.q_bits, len(self.remainders)], np.int64).tobytes()]
        for a in (runs, self.remainders, self.counts):
            kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
            parts += [np.array([kind.itemsize], np.int64).tobytes(), a.astype(kind).tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, n = np.frombuffer(data, np.int64, 2).tolist()
        at, arrays = 16, []
        for size in (1 << q, n, n):
            kind = np.dtype(f"u{int(np.frombuffer(data, np.int64, 1, at)[0])}")
            arrays.append(np.frombuffer(data, kind, size, at + 8))
            at += 8 + size * kind.itemsize
        offsets = np.zeros((1 << q) + 1, np.int64)
        np.cumsum(arrays[0].astype(np.int64), out=offsets[1:])
        return cls(q, offsets, arrays[1].astype(np.uint64), arrays[2].astype(np.int64))


def _build(block_bits: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            fp = np.concatenate(held)
            blocks = (fp >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(fp), np.int64)
            order = np.argsort(blocks, kind="stable")
            blocks, fp = blocks[order], fp[order]
            ids, at = np.unique(blocks, return_index=True)
            # inside a block the leading block bits are all alike, so the quotient starts after them
            filters = [CountingQuotientFilter.of(x << np.uint64(block_bits)).to_bytes() for x in np.split(fp, at[1:])]
            return pd.DataFrame({"block": ids, "cqf": filters})

        for pdf in batches:
            held.append(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            size += len(pdf)
            if size >= BLOCK_FINGERPRINTS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return build


def _merge(block_bits: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [CountingQuotientFilter.from_bytes(x) for x in pdf["cqf"]]
        while len(parts) > 1:
            parts = [parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        f = parts[0]
        many = f.counts > 1
        head = np.uint64(int(pdf["block"].iloc[0])) << np.uint64(64 - block_bits) if block_bits else np.uint64(0)
        fp = (f.fingerprints()[many] >> np.uint64(block_bits)) | head
        return pd.DataFrame({"fp": fp.view(np.int64), "n": f.counts[many]})

    return merge


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints in prints (fp long) that occur more than once; rows: how many prints has.

    Blocks are chosen so that a merge task holds about BLOCK_FINGERPRINTS; a fingerprint with any
    number of copies is one entry of each partition's filter.
    """
    bits = max(4, (max(1, rows) // BLOCK_FINGERPRINTS).bit_length())
    built = prints.select("fp").mapInPandas(_build(bits), "block long, cqf binary")
    return built.groupBy("block").applyInPandas(_merge(bits), "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size (long), kept, text_sha256.

    Texts are equal when byte for byte the same; null counts as the empty text. Of equal texts the
    row with the largest id stays. Rows that repeat both id and text belong to one group, count
    each towards group_size and are kept or dropped alike; a null id is kept only if all ids of its
    group are null. Other columns of docs are neither read nor returned. Empty input: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("fp"))
    prints = cut(base.select("id", "fp", F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    repeated = cut(repeated_fingerprints(prints, prints.count())).select("fp")
    routed = base.join(small_or_shuffled(repeated), "fp", "left_semi")
    # Bytes are compared by the smallest and largest text of a fingerprint: one pass with partial
    # aggregation, however many copies there are. Where both agree, all texts between them do.
    spread = cut(
        routed.groupBy("fp").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("fp", (F.col("lo") == F.col("hi")).alias("same"), "keep_id", "group_size")
    )
    same = spread.where("same").select(F.col("fp").alias("g_fp"), F.lit(None).cast("string").alias("g_sha"), "keep_id", "group_size")
    if not spread.where("NOT same").isEmpty():
        # Fingerprints shared by different texts: group by the text itself.
        mixed = spread.where("NOT same").select("fp")
        split = routed.join(mixed, "fp", "left_semi").groupBy("fp", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        other = split.select(F.col("fp").alias("g_fp"), F.sha2(F.col("text").cast("binary"), 256).alias("g_sha"), "keep_id", "group_size")
        same = same.unionByName(other)
    out = prints.join(same, (F.col("fp") == F.col("g_fp")) & (F.col("g_sha").isNull() | (F.col("g_sha") == F.col("sha"))), "left")
    grouped = F.col("g_fp").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"),
    )
