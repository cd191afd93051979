"""Mixing sources to target weights with a low-discrepancy source schedule.

A source's documents, shuffled by a keyed hash, form one stream of words that is cut into blocks
of equal length. The schedule has one slot per block that the mix takes: slot k falls on the point
of the van der Corput sequence at k, and the point is mapped through the cumulative block counts of
the sources. So each source's slots are spread evenly over the mix. The n-th slot of a source takes
the n-th block of its stream, which starts again after its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 4096


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from sizes (source, size): one row per source, null last.

    The sources in code-point order get the weights in turn and share ``share`` of all words by
    weight; a target stops at ``most`` times its source, and the excess goes to the others by
    weight until none is above. That is a water level: sources are capped in the order of
    size by weight, and the level is what is left over the weights that are left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("r", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    w = ranked.withColumn("w", F.element_at(cycle, (F.col("r") % len(weights) + 1).cast("int")))
    order = W.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("r")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.withColumn("left_words", share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(order), F.lit(0)))
    w = w.withColumn("left_weight", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0)))
    w = w.withColumn("capped", F.col("left_words") * F.col("w") >= most * F.col("source_size") * F.col("left_weight"))
    # the level is set by the first source that isn't capped
    level = W.orderBy(F.col("capped").asc(), (F.col("source_size") / F.col("w")).asc(), F.col("r")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.withColumn("lw", F.first("left_words").over(level)).withColumn("lg", F.first("left_weight").over(level))
    target = F.when(F.col("capped"), most * F.col("source_size")).otherwise(F.col("lw") * F.col("w") / F.col("lg"))
    return w.select("source", F.col("source_size").cast("long"), target.cast("double").alias("target"), "r")


def schedule(blocks: DataFrame) -> DataFrame:
    """(slot, r, pick): the slots of the sources in blocks (r int, n_blocks long), pick-th of its source from 0.

    Slot k of 2**m maps to the bit-reversed k, the van der Corput point in units of 2**-m; points
    beyond the number of blocks are skipped. The point meets its source by an equi-join on coarse
    bins, and picks are ranked within chunks of slots plus the counts of the chunks before, so no
    source's slots meet in one task.
    """
    spark = blocks.sparkSession
    b = blocks.where("n_blocks > 0").withColumn("hi", F.sum("n_blocks").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, 0)))
    b = cut(b.withColumn("lo", F.col("hi") - F.col("n_blocks")).select("r", "lo", "hi"))
    total = b.agg(F.max("hi")).first()[0] or 0
    m = max(1, int(total - 1).bit_length()) if total else 1
    width = max(1, (1 << m) >> 12)
    k = spark.range(1 << m if total else 0).withColumnRenamed("id", "slot")
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), m, "0")), 2, 10).cast("long")
    k = k.select("slot", point.alias("point")).where(F.col("point") < total).withColumn("bin", F.floor(F.col("point") / width))
    bins = b.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    hit = k.join(bins, "bin").where("point >= lo AND point < hi").select("slot", "r", F.floor(F.col("slot") / 65536).alias("chunk"))
    hit = cut(hit)
    before = hit.groupBy("r", "chunk").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("r").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = hit.withColumn("i", F.row_number().over(W.partitionBy("r", "chunk").orderBy("slot")) - 1)
    return ranked.join(before.drop("count"), ["r", "chunk"]).select("slot", "r", (F.col("before") + F.col("i")).alias("pick"))


def streams(sizes: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Each document's place [start, start + size) in its source's shuffled stream of words.

    Running sums go over the 4,096 hash buckets of each source first and within a bucket then, so a
    source of any share is spread.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")))
    s = sizes.withColumn("key", key).join(targets.select(F.col("source").alias("t_source"), "r", "source_size", "target"), F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    s = s.withColumn("bucket", F.substring("key", 1, 3))
    total = s.groupBy("r", "bucket").agg(F.sum("size").alias("n"))
    base = total.select(F.col("r").alias("b_r"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("n").over(W.partitionBy("r").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("size").over(W.partitionBy("r", "bucket").orderBy("key", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("inner", inner).join(base, (F.col("r") == F.col("b_r")) & (F.col("bucket") == F.col("b_bucket")))
    return s.withColumn("start", F.col("base") + F.col("inner")).drop("b_r", "b_bucket", "base", "inner", "key", "bucket")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: str = "mix", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces). placed: one row per input row (row, id, size, source_size, target, start, r).

    pieces: what the mix takes, in the order of slot: (slot, pick, row, from_word, to_word), words
    counted from 0 within the document. A source's words come to its target rounded to whole
    words, its last block being cut there; no document is taken more than twice because no target
    exceeds twice its source. Documents without words (null, empty) are placed and never taken.
    A null source is a source of its own, ordered last. Rows that repeat an id are separate rows.
    row_col names a column of docs that numbers its rows (long); without it they are numbered here.
    """
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    sizes = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = cut(sizes)
    targets = cut(source_targets(sizes))
    placed = cut(streams(sizes, targets, seed))
    take = F.least(F.round("target"), 2 * F.col("source_size")).cast("long")
    blocks = targets.select("r", F.ceil(take / block_words).cast("long").alias("n_blocks"))
    slots = schedule(blocks).join(F.broadcast(targets.select("r", "source_size", take.alias("take"))) if targets.count() <= 100_000 else targets.select("r", "source_size", take.alias("take")), "r")
    # A slot's words in the endless stream, then its one or more stretches of the stream's passes.
    lo, hi = F.col("pick") * block_words, F.least((F.col("pick") + 1) * block_words, F.col("take"))
    passes = F.sequence(F.floor(lo / F.col("source_size")), F.floor((hi - 1) / F.col("source_size")))
    slots = slots.withColumn("pass", F.explode(passes)).select(
        "slot", "pick", "r", "pass",
        F.greatest(lo - F.col("pass") * F.col("source_size"), F.lit(0)).alias("lo"), F.least(hi - F.col("pass") * F.col("source_size"), F.col("source_size")).alias("hi"),
    )
    slots = slots.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words))))
    parts = placed.where("size > 0").select("row", "r", "start", "size").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    # A stretch and a document meet in each cell that both touch; each cell yields its own words only.
    c0, c1 = F.col("cell") * block_words, (F.col("cell") + 1) * block_words
    a, z = F.greatest("lo", "start", c0), F.least("hi", F.col("start") + F.col("size"), c1)
    met = slots.join(parts, ["r", "cell"]).select("slot", "pick", "row", (a - F.col("start")).alias("from_word"), (z - F.col("start")).alias("to_word"))
    return placed, met.where("from_word < to_word")
