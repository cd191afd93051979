"""Checks of input tables: order, contiguous ids, columns, values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def out_of_order(df: DataFrame, ordinal: str, columns: list[str], stretch: int = 1 << 16) -> DataFrame:
    """One row: rows, and how many have smaller columns than the row before by ordinal.

    Rows are compared within stretches of ordinals; each stretch's last row is handed to the next.
    """
    d = df.select(F.col(ordinal).alias("_o"), F.struct(*columns).alias("_k")).withColumn("_at", F.floor(F.col("_o") / stretch))
    last = d.groupBy("_at").agg(F.max_by("_k", "_o").alias("_last"))
    handed = last.withColumn("_before", F.lag("_last").over(W.orderBy("_at"))).drop("_last")  # a row per stretch
    inner = F.lag("_k").over(W.partitionBy("_at").orderBy("_o"))
    c = d.withColumn("_p", inner).join(handed, "_at").withColumn("_p", F.coalesce("_p", "_before"))
    return c.agg(F.count("*").alias("rows"), F.count(F.when(F.col("_p") > F.col("_k"), 1)).alias("out_of_order"))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df


def check_regions(regions: DataFrame, ordinal: str | None = None) -> DataFrame:
    """regions, if their loci are 0 to n - 1 once each, blocks lie inside, and the table is sorted by place; else an error."""
    r = regions.agg(F.count("*").alias("n"), F.count_distinct("locus").alias("d"), F.min("locus").alias("lo"), F.max("locus").alias("hi"), F.count(F.when(F.col("end") <= F.col("start"), 1)).alias("bad")).first()
    if r["n"] and (r["d"] != r["n"] or r["lo"] != 0 or r["hi"] != r["n"] - 1):
        raise ValueError("region names must be the whole numbers from 0, once each")
    if r["bad"]:
        raise ValueError(f"{r['bad']} regions end before they start")
    if ordinal and out_of_order(regions, ordinal, ["chrom", "start"]).first()["out_of_order"]:
        raise ValueError("regions must be sorted by chromosome and start")
    return regions


def check_exposures(exposures: DataFrame, n_loci: int) -> DataFrame:
    """exposures, if there is one per locus and none is negative; else an error."""
    r = exposures.agg(F.count("*").alias("n"), F.min("exposure").alias("lo")).first()
    if r["n"] != n_loci:
        raise ValueError(f"{r['n']} exposures for {n_loci} loci")
    if r["lo"] is not None and r["lo"] < 0:
        raise ValueError("exposures must not be negative")
    return exposures
