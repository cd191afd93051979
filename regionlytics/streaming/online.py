"""Structured Streaming over mutation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, keys: list[str], time: str, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(keys, start, end, n): events of a key that follow each other within gap, on a stream or a table.

    Gaps and islands in time: a session closes once the watermark, delay behind the latest event, has passed its gap.
    """
    e = events.withWatermark(time, delay) if events.isStreaming else events
    g = e.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_counts(mutations: DataFrame, keys: list[str], weight: str | Column = "weight") -> DataFrame:
    """Summed weights per keys, updated as mutations arrive."""
    return mutations.groupBy(*keys).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def score_batches(mutations: DataFrame, model, corpus, sink: str, checkpoint: str):
    """Starts a query that appends the composition of the samples of each micro-batch to the Parquet table sink.

    A sample must be whole within a batch; batches written before a failure are not written twice.
    """
    from dataclasses import replace

    from ..model.trainer import predict

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            got = predict(model, replace(corpus, mutations=batch))
            got.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch_id={number}")

    return mutations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
