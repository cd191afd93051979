"""Mutation preprocessing: background rates, critical distances, and clusters of close mutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import base_index
from .durable import dealt, numbered, small_or_shuffled
from .intervals import BIN, apportion, coverage_count, segments
from .nearest import STRETCH

REACH = 10_000
ALPHA = 0.005


def marginal_rate(regions: DataFrame, points: DataFrame, key: str = "locus", size: int = BIN) -> DataFrame:
    """(key, n, rate): each region's points, and its share of all points that lie in regions."""
    n = coverage_count(regions, points, key, size)
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("_t")).alias("rate"))  # one row


def rate_track(regions: DataFrame, points: DataFrame, size: int = BIN) -> DataFrame:
    """(chrom, start, end, value): the marginal rate of BED12 regions by block, split by the blocks' lengths."""
    segs = segments(regions)
    rates = marginal_rate(segs, points, "locus", size)
    return apportion(segs.join(rates.select("locus", F.col("rate").alias("value")), "locus"), "value").select("chrom", "start", "end", "value")


def window_sums(places: DataFrame, track: DataFrame, reach: int, size: int = 4 * BIN, stretch: int = STRETCH) -> DataFrame:
    """(chrom, pos, _v, _l): values and lengths summed over the track's intervals that the window pos - reach to pos + reach touches, for each distinct place with any.

    They are the intervals that start before the window's end, less those that end at its start or before. So both
    are running sums over the places and the track in order, and no pair is made. Numbers of intervals, of values and
    of those that aren't zero, finite or numbers are told apart, so that one interval's value shows in its own windows only.
    """
    t = track.where(F.col("end") > F.col("start")).select("chrom", "start", "end", F.col("value").cast("double").alias("value"))
    # bins in which a window may touch something; there may be none on most of a chromosome
    near = F.explode(F.sequence(F.floor((F.col("start") - reach) / size), F.floor((F.col("end") + reach) / size)))
    bins = small_or_shuffled(t.select("chrom", near.alias("_bin")).distinct())
    p = places.where("chrom IS NOT NULL AND pos IS NOT NULL").withColumn("_bin", F.floor(F.col("pos") / size))
    p = p.join(bins, ["chrom", "_bin"], "left_semi").select("chrom", "pos").distinct()
    v, inf = F.col("value"), float("inf")
    odd = F.isnan(v) | (v == inf) | (v == -inf)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    kinds = {
        "_n": F.lit(1).cast("long"), "_l": (F.col("end") - F.col("start")).cast("long"), "_known": v.isNotNull().cast("long"), "_some": flag((v != 0) & ~odd),
        "_nan": flag(F.isnan(v)), "_up": flag(v == inf), "_down": flag(v == -inf), "_v": F.when(odd | v.isNull(), 0.0).otherwise(v),
    }
    none = [F.lit(None).cast("double" if n == "_v" else "long").alias(n) for n in kinds]

    def side(first: bool) -> DataFrame:
        # at one place intervals that end come before the windows that start there, windows that end before the intervals that start
        edge, asked = ("start", F.col("pos") + reach) if first else ("end", F.greatest(F.col("pos") - reach, F.lit(0)))
        rows = t.select("chrom", F.col(edge).cast("long").alias("_p"), F.lit(None).cast("long").alias("_pos"), *[c.alias(n) for n, c in kinds.items()])
        rows = rows.groupBy("chrom", "_p", "_pos").agg(*[F.sum(n).alias(n) for n in kinds])
        return rows.unionByName(p.select("chrom", asked.cast("long").alias("_p"), F.col("pos").cast("long").alias("_pos"), *none)).withColumn("_first", F.lit(first))

    d = side(True).unionByName(side(False)).withColumn("_at", F.floor(F.col("_p") / stretch))
    part = ["_first", "chrom"]
    back = W.partitionBy(*part).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    whole = d.where("_n IS NOT NULL").groupBy(*part, "_at").agg(*[F.sum(n).alias(n) for n in kinds])  # a row per stretch
    asked = d.where("_pos IS NOT NULL").select(*part, "_at").distinct().join(whole, [*part, "_at"], "full")
    carried = asked.select(*part, "_at", *[F.sum(n).over(back).alias(f"{n}0") for n in kinds])
    asks = F.col("_pos").isNotNull()
    order = F.when(F.col("_first"), ~asks).otherwise(asks)
    within = W.partitionBy(*part, "_at").orderBy("_p", order).rowsBetween(W.unboundedPreceding, 0)
    run = d.select(*part, "_at", "_pos", *[F.sum(n).over(within).alias(n) for n in kinds]).where(asks)
    signed = lambda c: F.when(F.col("_first"), c).otherwise(-c)
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    told = run.join(carried, [*part, "_at"]).select("chrom", F.col("_pos").alias("pos"), *[signed(zero(n) + zero(f"{n}0")).alias(n) for n in kinds])
    s = told.groupBy("chrom", "pos").agg(*[F.sum(n).alias(n) for n in kinds]).where("_n > 0")
    nan = (F.col("_nan") > 0) | ((F.col("_up") > 0) & (F.col("_down") > 0))
    value = F.when(F.col("_known") == 0, F.lit(None)).when(nan, float("nan")).when(F.col("_up") > 0, inf).when(F.col("_down") > 0, -inf).when(F.col("_some") == 0, 0.0).otherwise(F.col("_v"))
    return s.select("chrom", F.col("pos").cast(places.schema["pos"].dataType).alias("pos"), value.alias("_v"), "_l")


def local_rate(points: DataFrame, rates: DataFrame, keys: tuple[str, ...] = ("sample",), reach: int = REACH, size: int = 4 * BIN) -> DataFrame:
    """(keys, chrom, pos, rate): the expected number of mutations per base around each distinct point.

    The rate is the sum of the track's values over the sum of its interval lengths, over all
    intervals that the window pos - reach to pos + reach touches, times the points of the sample
    that have any. Points without are left out.
    """
    p = points.select(*keys, "chrom", "pos")
    # Windows overlap a lot: sums over the track come once per distinct place, not per sample.
    sums = window_sums(p.select("chrom", "pos"), rates, reach, size)
    joined = p.join(sums, ["chrom", "pos"]).distinct()
    counted = joined.groupBy(*keys).agg(F.count("*").alias("_m")) if keys else joined.agg(F.count("*").alias("_m"))
    out = joined.join(F.broadcast(counted), list(keys)) if keys else joined.crossJoin(F.broadcast(counted))  # a row per sample
    return out.select(*keys, "chrom", "pos", (F.col("_v") / F.col("_l") * F.col("_m")).alias("rate"))


def critical_distance(rate, alpha: float = ALPHA):
    """The distance that a share alpha of neighbours at this rate stay below."""
    return -math.log1p(-alpha) / rate


def mutation_type(ref, alt):
    """``C>A`` and so on, on the pyrimidine strand."""
    flip = lambda b: F.translate(b, "ACGT", "TGCA")
    pyrimidine = ref.isin("C", "T")
    return F.concat(F.when(pyrimidine, ref).otherwise(flip(ref)), F.lit(">"), F.when(pyrimidine, alt).otherwise(flip(alt)))


def clusters(rated: DataFrame, keys: tuple[str, ...] = ("sample",), by_type: bool = False, neighbour_rate: bool = False, alpha: float = ALPHA, most: int = REACH, rows: int | None = None) -> DataFrame:
    """rated (keys, chrom, pos, rate[, mutation_type]) with critical, distance, cluster, cluster_size, score.

    Points of rate zero or less are left out. Along a chromosome a point starts a new cluster if
    it lies further from the one before than that one's critical distance, and than ``most`` at
    the latest. A cluster's id is its chromosome (and type) with a running number; score is
    -log10(nearest distance / critical). With neighbour_rate the nearest point's rate takes the
    place of the point's own. Samples are spread over tasks, a sample's chromosome is in one. rows: a
    bound on the rows of rated, which are counted if it isn't known.
    """
    d = dealt(rated.where("rate > 0 AND pos IS NOT NULL"), *keys, "chrom", rows=rows)
    # the nearest other place: several rows of one place have the same; looked for where the rows lie, without a join
    others = lambda order: W.partitionBy(*keys, "chrom").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_r", -F.max(-F.col("pos")).over(others(-F.col("pos")))).withColumn("_l", F.max("pos").over(others(F.col("pos"))))
    up = F.col("_r").isNull() | (F.col("pos") - F.col("_l") <= F.col("_r") - F.col("pos"))
    d = d.withColumn("neighbour", F.when(F.col("_l").isNotNull() & up, F.col("_l")).otherwise(F.col("_r")))
    d = d.withColumn("distance", F.abs(F.col("pos") - F.col("neighbour"))).drop("_l", "_r")
    if neighbour_rate:
        other = d.select(*keys, "chrom", F.col("pos").alias("neighbour"), F.col("rate").alias("_r")).distinct()
        d = d.join(other, [*keys, "chrom", "neighbour"], "left").withColumn("rate", F.coalesce("_r", "rate")).drop("_r")
    d = d.withColumn("critical", critical_distance(F.col("rate"), alpha))
    part = [*keys, "chrom", *(["mutation_type"] if by_type else [])]
    w = W.partitionBy(*part).orderBy("pos")
    limit = F.least(F.lit(float(most)), F.lag("critical").over(w))
    starts = F.coalesce((F.col("pos") - F.lag("pos").over(w) > limit).cast("int"), F.lit(1))
    d = d.withColumn("_start", starts).withColumn("_n", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    name = ["chrom", *(["mutation_type"] if by_type else []), "_n"]
    d = d.withColumn("cluster", F.concat_ws("_", *[F.col(c).cast("string") for c in name]))
    d = d.withColumn("cluster_size", F.count("*").over(W.partitionBy(*part, "_n")))
    return d.withColumn("score", -F.log10(F.col("distance") / F.col("critical"))).drop("_start", "_n")


def drop_clustered(clustered: DataFrame, below: int = 3) -> DataFrame:
    """The mutations in clusters of fewer than ``below``."""
    return clustered.where(F.col("cluster_size") < below)


def moving_average(df: DataFrame, value: str, order: list[str], width: int, keys: list[str] | None = None, name: str = "smoothed", stretch: int = 1 << 16) -> DataFrame:
    """value averaged over a centred window of width rows; beyond the ends values count as zero, the divisor is always width.

    Without keys all rows are one sequence: they are numbered and fall into stretches, each of which
    also gets the width rows around it, so no task sees more than one stretch. order should be total.
    """
    back, ahead = width // 2, (width - 1) // 2
    if keys:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-back, ahead)
        return df.withColumn(name, F.sum(value).over(w) / width)
    size = max(stretch, width)
    rows = numbered(df, *order, name="_row")
    held = F.sequence(F.floor(F.greatest(F.col("_row") - ahead, F.lit(0)) / size), F.floor((F.col("_row") + back) / size))
    w = W.partitionBy("_stretch").orderBy("_row").rowsBetween(-back, ahead)
    out = rows.withColumn("_stretch", F.explode(held)).withColumn(name, F.sum(value).over(w) / width)
    return out.where(F.col("_stretch") == F.floor(F.col("_row") / size)).drop("_row", "_stretch")


def annotate(variants: DataFrame, annotations: DataFrame, on: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """All variants with the annotation columns of the same place, null where there are none."""
    return variants.join(annotations, list(on), "left")


def reference_check(mutations: DataFrame, sequences: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """mutations (chrom, pos, ref, ...) with context, the upper-cased three bases around pos; errors where ref isn't the middle one.

    sequences are chunks (chrom, chunk_id, start, seq) of ``chunk`` bases that overlap the next by two
    bases. A mutation whose chromosome is missing raises as well; one at an end has no context and is left out.
    """
    m = mutations.withColumn("chunk_id", F.floor((F.col("pos") - 1) / chunk).cast("long"))
    j = m.join(sequences.select("chrom", "chunk_id", F.col("start").alias("_s"), "seq"), ["chrom", "chunk_id"], "left")
    known = sequences.select("chrom").distinct().withColumn("_known", F.lit(True))
    j = j.join(F.broadcast(known), "chrom", "left")
    context = F.upper(F.substring(F.col("seq"), (F.col("pos") - F.col("_s")).cast("int"), 3))
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no sequence for "), F.col("chrom"))).cast("string")).otherwise(F.when((F.col("pos") > 0) & (F.length(context) == 3), context))
    j = j.withColumn("context", checked).where("context IS NOT NULL")
    wrong = F.concat(F.lit("reference base differs at "), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"))
    good = F.when(F.substring("context", 2, 1) == F.upper("ref"), F.col("context")).otherwise(F.raise_error(wrong).cast("string"))
    return j.withColumn("context", good).drop("seq", "_s", "chunk_id", "_known")


def featurise(snvs: DataFrame, segs: DataFrame, sequences: DataFrame, size: int = BIN) -> DataFrame:
    """snvs (sample, chrom, pos, ref, alt[, weight]) in the regions' segments: (sample, chrom, pos, locus, context, mutation, attribute, weight)."""
    from ..functions.sequence import alt_index, context_index
    from .intervals import point_join

    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in snvs.columns else F.lit(1.0)
    placed = point_join(snvs.withColumn("weight", weight), segs.select("locus", "chrom", "start", "end"), size).drop("start", "end")
    seen = reference_check(placed, sequences)
    known = base_index(F.col("alt")).isNotNull()
    return seen.where(known).select("sample", "chrom", "pos", "locus", context_index(F.col("context")).cast("int").alias("context"), alt_index(F.col("context"), F.col("alt")).cast("int").alias("mutation"), F.lit(0).alias("attribute"), "weight").where("context IS NOT NULL AND mutation IS NOT NULL")


def sequence_chunks(fasta: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """(chrom, chunk_id, start, seq) from whole sequences (chrom, seq), each overlapping the next by two bases."""
    k = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / chunk)))
    c = fasta.select("chrom", "seq", k.alias("chunk_id")).withColumn("chunk_id", F.col("chunk_id").cast("long"))
    return c.select("chrom", "chunk_id", (F.col("chunk_id") * chunk).alias("start"), F.substring(F.col("seq"), (F.col("chunk_id") * chunk + 1).cast("int"), F.lit(chunk + 2)).alias("seq"))
