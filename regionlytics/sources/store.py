"""Corpora, studies and cached rates as folders of Parquet tables."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpora import Corpus, union

PARTS = ("mutations", "loci", "trinucs", "features")


def save_corpus(corpus: Corpus, path: str) -> None:
    """One table per part, divided by corpus; feature types and groups stay in the columns' metadata."""
    for part in PARTS:
        getattr(corpus, part).write.mode("overwrite").partitionBy("corpus").parquet(f"{path}/{part}")
    if corpus.metadata is not None:
        corpus.metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load_corpus(spark: SparkSession, path: str, eager: bool = False) -> Corpus:
    """The corpus at path; eager keeps its tables in memory and on disk after their first use."""
    tables = {p: spark.read.parquet(f"{path}/{p}").withColumn("corpus", F.col("corpus").cast("string")) for p in PARTS}
    if eager:
        tables = {p: t.persist() for p, t in tables.items()}
    try:
        meta = spark.read.parquet(f"{path}/metadata")
    except Exception as x:  # a corpus without metadata has no such folder
        if "PATH_NOT_FOUND" not in str(x):
            raise
        meta = None
    return Corpus(**tables, metadata=meta)


def load_dataset(spark: SparkSession, paths: list[str], eager: bool = False) -> Corpus:
    """One corpus, or the union of several."""
    corpora = [load_corpus(spark, p, eager) for p in paths]
    return corpora[0] if len(corpora) == 1 else union(corpora)


def write_matrix(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def pivoted(df: DataFrame, row: str, column: str, value: str, order: list[str]) -> DataFrame:
    """A matrix with a row per ``row`` and the columns in ``order``."""
    return df.groupBy(row).pivot(column, order).agg(F.first(value))


def folder_digest(spark: SparkSession, path: str) -> str:
    """A digest of which Parquet files a folder holds, of what size and from when: it changes when a table is written anew."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    told = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{told['n']}:{told['h']}".encode()).hexdigest()[:24]


def cached(spark: SparkSession, path: str, model_digest: str, data_digest: str) -> DataFrame | None:
    """The table that was written for this model and this state of the data; None if there is none."""
    try:
        return spark.read.parquet(f"{path}/model={model_digest}/data={data_digest}/table")
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
            raise
        return None


def write_cached(spark: SparkSession, path: str, model_digest: str, data_digest: str, make) -> bool:
    """Writes what make() gives for a model and a state of the data, unless it is there; says whether it was made."""
    if cached(spark, path, model_digest, data_digest) is not None:
        return False
    make().write.mode("overwrite").parquet(f"{path}/model={model_digest}/data={data_digest}/table")
    return True


def cached_rates(spark: SparkSession, path: str, model_digest: str, data_digest: str, make) -> DataFrame:
    """What make() gives for a model and a state of the data, from the cache; written there the first time."""
    write_cached(spark, path, model_digest, data_digest, make)
    return cached(spark, path, model_digest, data_digest)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
