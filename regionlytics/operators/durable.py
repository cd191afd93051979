"""Cuts of the lineage in the shared checkpoint folder, joins by checked size, and global row numbers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows that a task should get at most of what is sorted or joined whole.
TASK_ROWS = 500_000


def cut(df: DataFrame) -> DataFrame:
    """df with its rows kept in spark.checkpoint.dir; where that is unset, in a temporary folder, but only for a local master."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within limit; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def tasks_for(df: DataFrame, rows: int, limit: int | None = None) -> int:
    """How many tasks rows fall to, a limit of TASK_ROWS each; no fewer than the session's shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (limit or TASK_ROWS)))


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt out by keys to as many tasks as its rows ask for, so that a task's memory doesn't grow with the table. rows: a bound on them, counted if not known."""
    return df.repartition(tasks_for(df, df.count() if rows is None else rows), *keys)


def numbered(df: DataFrame, *order: str | Column, name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """df with its rows numbered from 0 in the order given, which should be total.

    Rows are dealt out by range and sorted where they lie, so no task sees them all; only the
    number of rows of each partition goes to the driver.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    counts = {r["p"]: r["count"] for r in ranged.groupBy(F.shiftright("_m", 33).alias("p")).count().collect()}
    offsets, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(at)
        at += counts.get(p, 0)
    before = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets or [0]]), (F.shiftright("_m", 33) + 1).cast("int"))
    return ranged.withColumn(name, before + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")
