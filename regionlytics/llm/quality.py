"""Quality classifier: document evidence within a hierarchy of sites.

A logistic model over byte and word statistics, fitted on a bounded sample of labelled rows, gives
each document's evidence. Hosts and paths of hosts have a rate of good documents of their own: its
prior is a Beta around the rate of the level above, whose strength is estimated from the spread of
the groups beyond chance (empirical Bayes), so sparse sites shrink towards the global rate. A
labelled document counts in them by its label, any other by its probability. The posterior of a
document moves its evidence by what the other documents of its path and host say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, small_or_shuffled

#: Most labelled rows that the model is fitted on.
TRAIN_ROWS = 20_000
ROWS = 256
STATISTICS = 16
WIDTH = STATISTICS + 97


def features(text: bytes | None) -> np.ndarray:
    """Byte shares, and shares of words and lines that repeat, shout or carry symbols; zeros for an empty text."""
    out = np.zeros(WIDTH, np.float32)
    words = (text or b"").split()
    n = len(words)
    if not n:
        return out
    data = np.frombuffer(text, np.uint8)
    count = np.bincount(data, minlength=256).astype(np.float64)
    size = count.sum()
    letters = count[65:91].sum() + count[97:123].sum()
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    _, times = np.unique(code, return_counts=True)
    pairs = code[1:] * np.uint64(31) + code[:-1]
    lines = text.split(b"\n")
    length = np.fromiter(map(len, words), np.int64, n)
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    letter_end = (last >= 128) | ((last | 32) >= 97) & ((last | 32) <= 122)
    out[:STATISTICS] = (
        1, np.log1p(n), length.mean(), length.std(), len(times) / n, times.max() / n, (code[1:] == code[:-1]).mean() if n > 1 else 0,
        len(np.unique(pairs)) / max(1, n - 1), count[65:91].sum() / max(1, letters), count[48:58].sum() / size, count[128:].sum() / size,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), 1 - letter_end.mean(), ((last == 46) | (last == 44)).mean(), letters / size,
    )
    out[STATISTICS : STATISTICS + 96] = np.sqrt(count[32:128] / size)
    out[-1] = np.sqrt(count[:32].sum() / size)
    return out


class Logistic:
    """Ridge logistic regression on standardised features, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.c_[np.ones(len(x)), self._scaled(x)]
        self.beta = np.zeros(z.shape[1])
        penalty = np.full(len(self.beta), ridge)
        penalty[0] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.beta)
            self.beta += step
            if np.abs(step).max() < 1e-6:
                break

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.beta[0] + self._scaled(x) @ self.beta[1:]


def train(texts: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int = TRAIN_ROWS) -> Logistic | None:
    """From at most rows labelled documents, those whose ids hash lowest; None unless both classes occur.

    texts has (id, text binary). Labels that are null are left out. An id counts once for each label
    that it has, however often either repeats; of its texts the one that hashes lowest is taken.
    """
    labelled = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    sample = cut(labelled.distinct().orderBy(F.xxhash64("id"), "id", "y").limit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = [features(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary()), part.column(2), part.column(3)], names=["id", "x", "y", "key"])

    asked = texts.join(F.broadcast(sample), "id").select("id", "text", "y", F.xxhash64("text").alias("key"))
    found = asked.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, x binary, y int, key long")
    got = found.groupBy("id", "y").agg(F.min_by("x", "key").alias("x")).select("x", "y").toArrow()
    y = got["y"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    return Logistic(np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64), y)


def _strength(groups: DataFrame, prior: Column) -> float:
    """How many observations the level above is worth, from the spread of (n, s = sum of p) around prior beyond chance."""
    r = groups.select(F.col("n"), (F.col("s") / F.col("n")).alias("r"), prior.alias("q")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("j"),
        F.sum(F.col("n") * (F.col("r") - F.col("q")) ** 2).alias("between"), F.sum(F.col("n") * F.col("q") * (1 - F.col("q"))).alias("chance"),
    ).first()
    if not r["n"] or r["j"] < 2:
        return 100.0
    chance = r["chance"] / r["n"]
    extra = (r["between"] - (r["j"] - 1) * chance) / max(1e-9, r["n"] - r["nn"] / r["n"])
    return float(np.clip(chance / extra - 1, 1.0, 1e6)) if extra > 1e-12 else 1e6


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    label_col: str = "quality", threshold: float = 0.5, train_rows: int = TRAIN_ROWS, row_col: str | None = None,
) -> DataFrame:
    """(id_col, evidence, site, posterior, kept) of every row of docs; with row_col (long) also that column.

    evidence is the document's logit, site the rate of good documents among the others of its path
    and host after shrinkage, posterior the combined probability; kept says posterior >= threshold.
    Null hosts and paths are groups of their own. Null and empty texts have no features and get the
    evidence that the model gives to none. Without labels of both classes all is kept. Rows that
    repeat are judged alike and count each; several labels of an id count by their mean. Very long
    texts are read whole. Other columns of docs and labels are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    extra = [] if row_col is None else [row_col]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(texts, labels, id_col, label_col, train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                if model.value is None:
                    logit = np.full(part.num_rows, 30.0)
                else:
                    logit = np.clip(model.value.logit(np.stack([features(t) for t in part.column(3).to_pylist()]).astype(np.float64)), -30, 30)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 2)), pa.array(logit), *(part.column(4 + i) for i in range(len(extra)))], names=["id", "host", "path", "evidence", *(["row"] * len(extra))])

    asked = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("binary").alias("text"), *[F.col(c).cast("long").alias("row") for c in extra])
    scored = cut(asked.mapInArrow(run, f"id {kind}, host string, path string, evidence double" + ", row long" * len(extra)))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg((F.col(label_col) > 0).cast("double")).alias("told"))
    scored = scored.join(small_or_shuffled(told.where("told IS NOT NULL")), "id", "left")
    # what the document says of its site: its label, or else its probability
    scored = scored.withColumn("p", F.coalesce("told", 1 / (1 + F.exp(-F.col("evidence"))))).drop("told")
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = float(np.clip(total[1] / total[0], 1e-6, 1 - 1e-6)) if total[0] else 0.5
    k_host = _strength(hosts, F.lit(rate))
    above = hosts.select(F.col("host").alias("h"), F.col("n").alias("n_host"), F.col("s").alias("s_host"))
    sites = cut(paths.join(above, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    k_path = _strength(sites, (F.col("s_host") + k_host * rate) / (F.col("n_host") + k_host))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("d"), "n", "s", "n_host", "s_host")
    out = scored.join(small_or_shuffled(sites, 200_000), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("d")))
    # a document's own share is taken out of its sites
    at_host = (F.col("s_host") - F.col("p") + k_host * rate) / (F.col("n_host") - 1 + k_host)
    at_path = (F.col("s") - F.col("p") + k_path * at_host) / (F.col("n") - 1 + k_path)
    site = F.least(F.greatest(at_path, F.lit(1e-6)), F.lit(1 - 1e-6))
    moved = F.col("evidence") + F.log(F.col("site") / (1 - F.col("site"))) - float(np.log(rate / (1 - rate)))
    out = out.withColumn("site", site).withColumn("posterior", 1 / (1 + F.exp(-moved)))
    return out.select(F.col("id").alias(id_col), *[F.col("row").alias(c) for c in extra], "evidence", "site", "posterior", (F.col("posterior") >= threshold).alias("kept"))
