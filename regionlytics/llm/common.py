"""Helpers that several operators share: durable cuts of the lineage, connected components, word rules."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but a blank or 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of two longs that may be broadcast: 1,000,000 rows are about 16 MB.
BROADCAST_ROWS = 1_000_000


BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where none is set, a folder of this machine, but only for a local master."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Lowers the bytes of a batch that goes to Python to BATCH_BYTES for the session, whose default is 64 MB.

    A worker holds several copies of its batch, as text, as hashes and as a result.
    """
    now = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(BATCH_CONF).lower())
    if not now or int(now[1]) << 10 * " kmgtp".index(now[2] or " ") > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """df with its rows kept in the checkpoint folder, so that lost executors don't make it run again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within limit; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node in edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until every node points at its component's smallest
    node. Each step is two aggregations with map-side partial minima and two equi-joins, so a hub
    with any number of neighbours is never gathered in one task. Nulls and loops are ignored;
    an empty input gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low2, F.col("u") == F.col("k")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")
        )
        e = cut(small.select("x.*").where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first())
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
