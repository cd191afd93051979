"""From raw documents to token ids: quality, exact copies, near copies, mixture, tokens.

STAGES lists the stages in order. Each is a function of (spark, docs, sf_dir) whose result is
written as Parquet and read again as the next one's docs; all but the last return the columns of
documents. run() does that in the checkpoint folder. SQL can't express the stages.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlytics.llm.common import cut, ensure_checkpoint_dir, small_or_shuffled
from regionlytics.llm.exact_dedup import exact_dedup
from regionlytics.llm.mixing import mix
from regionlytics.llm.ngram_join import near_duplicates
from regionlytics.llm.pieces import ids_digest, round_trip
from regionlytics.llm.quality import classify

TOKENIZER = "piece_bpe_32k.model"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row, and that column's name. Numbers follow doc_id, null ids come last.

    The number is doc_id where that tells all rows apart; else rows are numbered and written once.
    """
    name = "_row"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and docs.where("doc_id IS NULL").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return cut(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())), name


def _without(rows: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """rows without those whose number is in gone, and without the number."""
    return rows.join(small_or_shuffled(gone.select(row)), row, "left_anti").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on labels, accepts; each row by its own text, also with a null or repeated id."""
    rows, row = _numbered(docs)
    judged = classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=row)
    return _without(rows, judged.where("NOT kept"), row).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id, and once if its row repeats."""
    groups = exact_dedup(docs)
    dropped = groups.where("NOT kept").select("doc_id", F.col("text_sha256").alias("gone_sha")).distinct()
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    gone = small_or_shuffled(dropped)
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (sha == gone["gone_sha"]), "left_anti")
    repeated = kept.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    repeated = small_or_shuffled(repeated.withColumnRenamed("doc_id", "r"))
    same = kept["doc_id"].eqNullSafe(F.col("r"))
    again = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(again)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows are documents, whatever their ids; null ids count as the largest.
    """
    rows, row = _numbered(docs)
    groups = near_duplicates(rows, id_col=row, width=5, percent=80)
    return _without(rows, groups.where(F.col(row) != F.col("component_id")), row).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: its words taken over its words, rounded, so up to twice; also with a null or repeated id."""
    rows, row = _numbered(docs)
    placed, pieces = mix(rows, row_col=row)
    taken = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    times = placed.join(taken, "row").select(F.col("row").alias(row), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times"))
    copies = rows.join(small_or_shuffled(times.where("times > 0").withColumnRenamed("times", f"{row}times")), row)
    return copies.withColumn(f"{row}copy", F.explode(F.sequence(F.lit(1), F.col(f"{row}times")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text that came so far, with digests of the ids and of their decoded text."""
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    out = round_trip(docs, path)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: No stage but the second can be expressed in SQL; tests/llm holds all against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to and read from the checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, stage) -> DataFrame:
        name, f = stage
        f(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
