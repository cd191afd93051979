"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule judges are the labelled sample. For the accepted and for the rejected ones a
smoothed variable-order Markov model counts the characters behind contexts of zero to four bytes;
an order's estimate is interpolated with the order below. Other URLs are judged by the difference
of the two log-likelihoods per byte against a threshold calibrated on labelled URLs held out.
Grams are counted by key, none shares a counter, so the models grow with the labelled URLs. URLs
meet them in passes over parts of the models of bounded size, one pass if all grams fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ORDERS = 5
#: Slots of a plain array of counters, which exact counts don't have.
SLOTS = 1 << 16
#: A gram's order stands above its five bytes.
TAG = 40
#: Grams of one pass: 24 bytes each and as much again at most for their contexts.
PASS_GRAMS = 2_000_000
#: Weight of the order below, in observations.
STRENGTH = 4.0


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of rules (host/path, verdict) that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


Counts = np.ndarray | tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all bytes of all texts: the byte (lowest) and the four before it in one number, and the sizes of the texts."""
    data = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(b"\0" * (ORDERS - 1) + d for d in data), np.uint8).astype(np.int64)
    own = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + ORDERS - 1) - sizes - (ORDERS - 1)
    for j in range(ORDERS - 1):
        own[starts + j] = False
    at = np.flatnonzero(own)
    key = np.zeros(len(at), np.int64)
    for o in range(ORDERS):
        key |= flat[at - o] << (8 * o)
    return key, sizes


def _gram(windows: np.ndarray, order: int) -> np.ndarray:
    """The last order + 1 bytes."""
    return windows & ((1 << (8 * (order + 1))) - 1)


def _part(windows: np.ndarray, parts: int) -> np.ndarray:
    """The pass of windows, by the two bytes before the last: grams and contexts of two bytes or more share it."""
    return ((windows >> 8) & 0xFFFF) % parts


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for cls in (0, 1):
            texts = pdf.loc[pdf["cls"] == cls, "text"].tolist()
            if not texts:
                continue
            windows, n = np.unique(_windows(texts)[0], return_counts=True)
            for o in range(ORDERS):
                gram, at = np.unique(_gram(windows, o), return_inverse=True)
                yield pd.DataFrame({"gram": gram | (o << TAG), "cls": cls, "n": np.bincount(at, weights=n, minlength=len(gram)).astype(np.int64)})


def train(labelled: DataFrame) -> DataFrame:
    """(gram, rejected, accepted): counts by order and gram from labelled (text, cls 0 rejected or 1 accepted)."""
    rows = labelled.mapInPandas(_count, "gram long, cls int, n long")
    of = lambda cls: F.sum(F.when(F.col("cls") == cls, F.col("n")).otherwise(0))
    return cut(rows.groupBy("gram").agg(of(0).alias("rejected"), of(1).alias("accepted")))


def counts_of(grams: DataFrame, part: int = 0, parts: int = 1) -> Counts:
    """Sorted keys and counts [class, key] of grams and of their contexts, in one part: orders 0 and 1, and the part's longer ones."""
    mine = (F.col("gram") < 2 << TAG) | (F.shiftright("gram", 8).bitwiseAND(0xFFFF) % parts == part)
    rows = grams.where(mine).toArrow()
    keys, n = rows["gram"].to_numpy(), np.stack([rows["rejected"].to_numpy(), rows["accepted"].to_numpy()])
    order = np.argsort(keys)
    keys, n = keys[order], n[:, order]
    context, first = np.unique((keys >> TAG << TAG) | ((keys & ((1 << TAG) - 1)) >> 8), return_index=True)
    return (keys, n), (context, np.add.reduceat(n, first, axis=1) if len(keys) else n)


def _found(counts: Counts, order: int, kind: int, keys: np.ndarray) -> np.ndarray:
    """Counts [class, key] of grams (kind 0) or contexts (1); of an array [class, order, kind, slot] those of the keys' slots."""
    if isinstance(counts, np.ndarray):
        return counts[:, order, kind][:, keys % counts.shape[-1]]
    known, n = counts[kind]
    if not len(known):
        return np.zeros((2, len(keys)))
    tagged = keys | (order << TAG)
    at = np.minimum(np.searchsorted(known, tagged), len(known) - 1)
    return np.where(known[at] == tagged, n[:, at], 0)


def scores(texts: list[str], counts: Counts, part: int = 0, parts: int = 1) -> np.ndarray:
    """Mean log-likelihood ratio per byte of accepted over rejected; zero for an empty text. With parts, the share of part."""
    windows, sizes = _windows(texts)
    distinct, at = np.unique(windows, return_inverse=True)
    p = np.full((2, len(distinct)), 1 / 256)
    for o in range(ORDERS):
        gram = _gram(distinct, o)
        p = (_found(counts, o, 0, gram) + STRENGTH * p) / (_found(counts, o, 1, gram >> 8) + STRENGTH)
    ratio = np.where(_part(distinct, parts) == part, np.log(p[1]) - np.log(p[0]), 0.0)[at]
    total = np.r_[0.0, np.cumsum(ratio)]
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, score) of every row of pages.

    rules: pairs of a rule such as ``example.com/en/`` and ``allow`` or ``block``. score is the
    model's, also where a rule decides. Null URLs and URLs without ``://`` have an empty host and
    path and are judged by the model; the null URL counts as empty and scores zero. If the rules
    label only URLs of one class, or none, the model allows all. Rows that repeat are judged alike.
    """
    spark = pages.sparkSession
    verdict_of = dict(rules)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "text": F.coalesce("url", F.lit(""))})
    base = base.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    allowed = [r for r, v in verdict_of.items() if v == "allow"]
    labelled = base.where("rule IS NOT NULL AND text <> ''").select("text", F.col("rule").isin(allowed).cast("int").alias("cls"))
    held = F.pmod(F.xxhash64("text"), F.lit(10)) == 0
    grams = train(labelled.where(~held))
    size, *seen = grams.agg(F.count("*"), F.sum("rejected"), F.sum("accepted")).first()
    usable = all(seen)
    parts = max(1, -(-size // PASS_GRAMS))
    kind = pages.schema[id_col].dataType.simpleString()
    out = base.select("id", "host", "path", "rule", "text", F.lit(0.0).alias("score"))
    for part in range(parts):
        shared = spark.sparkContext.broadcast(counts_of(grams, part, parts))

        def score(batches: Iterator[pd.DataFrame], part: int = part, shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                s = scores(pdf["text"].tolist(), shared.value, part, parts) if len(pdf) else np.zeros(0)
                yield pdf.assign(score=pdf["score"] + s)

        out = cut(out.mapInPandas(score, f"id {kind}, host string, path string, rule string, text string, score double"))
        shared.unpersist()

    threshold = 0.0
    if usable:
        judged = out.where(F.col("rule").isNotNull() & (F.col("text") != "") & held)
        bins = judged.groupBy(F.col("rule").isin(allowed).cast("int").alias("cls"), F.round(F.col("score") * 500).alias("bin")).count().toArrow()
        threshold = calibrated(bins["cls"].to_numpy(), bins["bin"].to_numpy() / 500, bins["count"].to_numpy())
    by_model = F.when(F.lit(not usable) | (F.col("score") >= threshold), "allow").otherwise("block")
    by_rule = F.when(F.col("rule").isin(allowed), "allow").otherwise("block")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_model)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def calibrated(cls: np.ndarray, score: np.ndarray, n: np.ndarray) -> float:
    """The threshold of best mean accuracy over both classes; zero if one is missing."""
    order = np.argsort(score)
    cls, score, n = cls[order], score[order], n[order].astype(float)
    good, bad = np.where(cls == 1, n, 0), np.where(cls == 0, n, 0)
    if not good.sum() or not bad.sum():
        return 0.0
    below_good, below_bad = np.r_[0, np.cumsum(good)] / good.sum(), np.r_[0, np.cumsum(bad)] / bad.sum()
    quality = (1 - below_good) + below_bad
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    edges = np.r_[score[0] - 0.002, (score[1:] + score[:-1]) / 2, score[-1] + 0.002]
    return float(edges[best[np.argmin(np.abs(edges[best]))]])
