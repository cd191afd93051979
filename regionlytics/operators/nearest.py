"""Nearest neighbours and overlays along chromosomes, in two levels so that no task sees a whole one.

A chromosome is cut into stretches. What a stretch passes on to the next - its last position, or how
many lines are open - is one row per stretch, and a running aggregate over those rows is joined back;
within a stretch an ordinary window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import dealt
from .intervals import BIN, anti_join, overlap_join

STRETCH = 1 << 20
#: Segments of an overlay at most this long are dropped.
SLIVER = 5


def _carried(df: DataFrame, keys: list[str], pos: str, value: Column, forward: bool, stretch: int) -> DataFrame:
    """df with _best: the largest (forward) or smallest value of rows before (behind) each row's stretch, and _at, its stretch."""
    d = df.withColumn("_at", F.floor(F.col(pos) / stretch)).withColumn("_value", value)
    pick = F.max if forward else F.min
    rows = d.groupBy(*keys, "_at").agg(pick("_value").alias("_own"))
    order = F.col("_at").asc() if forward else F.col("_at").desc()
    rows = rows.withColumn("_best", pick("_own").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))).drop("_own")
    return d.join(rows, [*keys, "_at"])


def nearest_before_after(regions: DataFrame, features: DataFrame, key: str = "locus", stretch: int = STRETCH) -> DataFrame:
    """(key, upstream, downstream): distances to the nearest feature before and behind each region.

    A feature that ends where the region starts is at distance one; features that overlap are at
    zero on both sides; null where there is none. Regions are taken from their first start to their last end.
    """
    span = regions.groupBy(key, "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))

    def side(forward: bool) -> DataFrame:
        edge = "start" if forward else "end"
        r = span.select(key, "chrom", F.col(edge).alias("p"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("v"))
        f = features.select(F.lit(None).cast(regions.schema[key].dataType).alias(key), "chrom", F.col("end" if forward else "start").alias("p"), F.lit(0).alias("k"), F.col("end" if forward else "start").cast("long").alias("v"))
        d = _carried(r.unionByName(f), ["chrom"], "p", F.col("v"), forward, stretch)
        order = [F.col("p").asc(), F.col("k").asc()] if forward else [F.col("p").desc(), F.col("k").asc()]
        within = (F.max if forward else F.min)("v").over(W.partitionBy("chrom", "_at").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        best = (F.greatest if forward else F.least)(within, F.col("_best"))
        gap = F.col("p") - best if forward else best - F.col("p")
        return d.withColumn("d", gap + 1).where("k = 1").select(key, F.col("d").alias("upstream" if forward else "downstream"))

    touched = overlap_join(span, features.select("chrom", "start", "end")).select(key).distinct().withColumn("_zero", F.lit(True))
    out = side(True).join(side(False), key).join(touched, key, "left")
    zero = lambda c: F.when(F.col("_zero"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    return out.select(key, zero("upstream"), zero("downstream"))


def distance_features(near: DataFrame, key: str = "locus", reverse: bool = False) -> DataFrame:
    """(key, progress, total): u / (u + d), or one minus that, and u + d; NaN unless both are there and u + d > 0."""
    u, d = F.col("upstream"), F.col("downstream")
    ok = u.isNotNull() & d.isNotNull() & (u + d > 0)
    share = 1 - u / (u + d) if reverse else u / (u + d)
    nan = F.lit(float("nan"))
    return near.select(key, F.when(ok, share).otherwise(nan).alias("progress"), F.when(ok, (u + d).cast("double")).otherwise(nan).alias("total"))


def nearest_self(points: DataFrame, keys: list[str], pos: str = "pos", ties: str = "upstream") -> DataFrame:
    """Distinct points (keys, pos) with the nearest other one: neighbour, distance; null if alone.

    On a tie the neighbour upstream is taken; with ties="all" there is a row for either.
    """
    w = W.partitionBy(*keys).orderBy(pos)
    p = dealt(points.select(*keys, pos), *keys).distinct().withColumns({"_l": F.lag(pos).over(w), "_r": F.lead(pos).over(w)})
    left, right = F.col(pos) - F.col("_l"), F.col("_r") - F.col(pos)
    up = F.col("_r").isNull() | (left <= right)
    if ties == "all":
        near = F.array_compact(F.array(F.when(left <= F.coalesce(right, left), F.col("_l")), F.when(right <= F.coalesce(left, right), F.col("_r"))))
        p = p.withColumn("neighbour", F.explode_outer(near))
    else:
        p = p.withColumn("neighbour", F.when(F.col("_l").isNotNull() & up, F.col("_l")).otherwise(F.col("_r")))
    return p.withColumn("distance", F.abs(F.col(pos) - F.col("neighbour"))).drop("_l", "_r")


def depth_segments(intervals: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(chrom, start, end, depth): the stretches between neighbouring ends and how many intervals lie over them."""
    ends = intervals.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")))).alias("e"))
    at = ends.groupBy("chrom", F.col("e.p").alias("pos")).agg(F.sum("e.d").alias("delta")).withColumn("_at", F.floor(F.col("pos") / stretch))
    rows = at.groupBy("chrom", "_at").agg(F.sum("delta").alias("_sum"), F.min("pos").alias("_first"))
    w = W.partitionBy("chrom").orderBy("_at")
    rows = rows.select("chrom", "_at", F.coalesce(F.sum("_sum").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_open"), F.lead("_first").over(w).alias("_next"))
    inner = W.partitionBy("chrom", "_at").orderBy("pos")
    out = at.join(rows, ["chrom", "_at"]).withColumns({"end": F.coalesce(F.lead("pos").over(inner), F.col("_next")), "depth": F.col("_open") + F.sum("delta").over(inner.rowsBetween(W.unboundedPreceding, 0))})
    return out.where("end IS NOT NULL AND depth > 0").select("chrom", F.col("pos").alias("start"), "end", F.col("depth").cast("long").alias("depth"))


def overlay(tracks: DataFrame, sliver: int = SLIVER, size: int = BIN, stretch: int = STRETCH) -> DataFrame:
    """(chrom, start, end, labels): the pieces between neighbouring ends of all tracks, with what lies over them.

    tracks has (track, chrom, start, end, label). labels is the sorted set of ``track:label``. Pieces of
    at most sliver bases are dropped.
    """
    pieces = depth_segments(tracks.select("chrom", "start", "end"), stretch).where(F.col("end") - F.col("start") > sliver).drop("depth")
    named = tracks.select("chrom", "start", "end", F.concat_ws(":", "track", "label").alias("name"))
    hit = overlap_join(pieces, named, size)
    return hit.groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_set("b_name")).alias("labels"))


def overlapping_same_label(tracks: DataFrame) -> DataFrame:
    """(track, label, chrom): labels that overlap themselves, of which an overlay should warn."""
    w = W.partitionBy("track", "label", "chrom").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    return tracks.withColumn("_e", F.max("end").over(w)).where(F.col("start") < F.col("_e")).select("track", "label", "chrom").distinct()


def fixed_windows(chroms: DataFrame, width: int) -> DataFrame:
    """The track of windows of equal width over chroms (chrom, length); the label is the window's number on its chromosome."""
    starts = F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(width)))
    w = chroms.select("chrom", "length", starts.alias("n", "start"))
    return w.select(F.lit("window").alias("track"), "chrom", F.col("start").cast("long").alias("start"), F.least(F.col("start") + width, F.col("length")).cast("long").alias("end"), F.concat_ws("_", "chrom", "n").alias("label"))


def make_regions(tracks: DataFrame, blacklist: DataFrame | None = None, sliver: int = SLIVER, size: int = BIN) -> DataFrame:
    """Regions from tracks: overlay, without pieces that the blacklist touches, one region per set of labels.

    Regions are numbered by the first piece that survives; result as assemble(), key ``locus``.
    """
    from .durable import numbered
    from .intervals import assemble

    pieces = overlay(tracks, sliver, size).withColumn("combo", F.concat_ws("|", "labels"))
    if blacklist is not None:
        pieces = anti_join(pieces.withColumn("_id", F.concat_ws(":", "chrom", "start")), blacklist, "_id", size).drop("_id")
    first = pieces.groupBy("combo").agg(F.min(F.struct("chrom", "start")).alias("_f"))
    ids = numbered(first.select("combo", F.col("_f.chrom").alias("_c"), F.col("_f.start").alias("_s")), "_c", "_s", name="locus").select("combo", "locus")
    return assemble(pieces.join(ids, "combo").select("locus", "chrom", "start", "end"), "locus")
