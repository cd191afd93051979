"""Relational algebra of half-open intervals [start, end) by chromosome.

Range predicates become equi-joins over a hierarchy of bins. The bins of level 0 have ``size`` bases,
those of each further level FACTOR times as many. An interval is stored at its own level, the first
whose bins are no shorter than itself, so it lies in one or two bins however long it is; it looks for
longer ones in the one or two bins that it touches at each of their levels. Only levels that occur
are looked at. A pair is kept in the first bin that both touch. So rows grow with the input alone, and
the planner sees an ordinary join that it can shuffle, broadcast or split by skew. The few intervals
of a sparse level are copied to several parts of their bins, among which what looks for them is dealt,
as all places of a chromosome may look into one bin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .durable import BROADCAST_ROWS, tasks_for

BIN = 1024
#: How much longer each level's bins are, the number of levels, and the most parts of a bin.
FACTOR, LEVELS, PARTS = 4, 16, 16
#: A slot is a bin's number times this, plus its level, role and part.
STEP = LEVELS * 2 * PARTS


def bin_of(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def level_of(length: Column, size: int = BIN) -> Column:
    """The level whose bins are the shortest that aren't shorter than length."""
    return reduce(lambda x, y: x + y, ((length > size * FACTOR**k).cast("int") for k in range(LEVELS - 1)))


def level_counts(size: int, *tables: DataFrame) -> list[dict[int, int]]:
    """For each of the tables (start, end, ...) the number of intervals at each level; empty ones don't count. One job."""
    length = F.col("end") - F.col("start")
    parts = [t.where(length > 0).select(F.lit(i).alias("t"), level_of(length, size).alias("level")) for i, t in enumerate(tables)]
    out: list[dict[int, int]] = [{} for _ in tables]
    for r in reduce(DataFrame.unionByName, parts).groupBy("t", "level").count().collect():  # at most LEVELS rows a table
        out[r["t"]][r["level"]] = r["count"]
    return out


def _parts(stored: dict[int, int], rows: int) -> dict[int, int]:
    """Into how many parts the bins of each level fall: no level has more copies than there are rows."""
    return {level: max(1, min(PARTS, rows // n)) for level, n in sorted(stored.items())}


def _entries(role: int, parts: dict[int, int]) -> list[tuple[int, int, int]]:
    return [(role, level, n) for level, n in parts.items()]


def _placed(df: DataFrame, start: str, end: str, size: int, entries: list[tuple[int, int, int]], stored: int, strict: int | None, name: str) -> DataFrame:
    """df once for each slot, as the column name, of the entries (role, level, parts).

    In the role ``stored`` an interval lies in the bins of its own level, in each of their parts; in the
    other one it looks for those of its own level and above, or above only if that role is ``strict``, in one part.
    """
    if not entries:
        return df.where("false").withColumn(name, F.lit(None).cast("long"))
    s, e = F.col(start), F.col(end)
    each = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(level).alias("level"), F.lit(n).alias("parts"), F.lit(size * FACTOR**level).cast("long").alias("width")) for r, level, n in entries])
    out = df.where(e > s).withColumn("_own", level_of(e - s, size)).withColumn("_at", F.explode(each) if len(entries) > 1 else each[0])
    role, level, parts, width = (F.col(f"_at.{c}") for c in ("role", "level", "parts", "width"))
    below = F.when(role == strict, F.col("_own") < level).otherwise(F.col("_own") <= level) if strict is not None else F.col("_own") <= level
    out = out.where(F.when(role == stored, F.col("_own") == level).otherwise(below))
    out = out.withColumn("_bin", F.explode(F.sequence(F.floor(s / width), F.floor((e - 1) / width))))
    part = F.lit(0)
    if any(n > 1 for _, _, n in entries):
        one = F.pmod(F.xxhash64(s, e), parts).cast("int")
        out = out.withColumn("_part", F.explode(F.sequence(F.when(role == stored, 0).otherwise(one), F.when(role == stored, parts - 1).otherwise(one))))
        part = F.col("_part")
    return out.withColumn(name, _slot(F.col("_bin"), level, role, part)).drop("_own", "_at", "_bin", "_part")


def _slot(at: Column, level: Column, role: Column, part: Column) -> Column:
    return at * STEP + ((level * 2 + role) * PARTS + part).cast("long")


def segments(regions: DataFrame) -> DataFrame:
    """The blocks of regions (locus, chrom, start, block_sizes, block_starts, ...): (locus, chrom, block, start, end)."""
    blocks = F.posexplode(F.arrays_zip("block_starts", "block_sizes"))
    b = regions.select("locus", "chrom", F.col("start").alias("_s"), blocks.alias("block", "_b"))
    return b.select("locus", "chrom", "block", (F.col("_s") + F.col("_b.block_starts")).cast("long").alias("start"), (F.col("_s") + F.col("_b.block_starts") + F.col("_b.block_sizes")).cast("long").alias("end"))


def point_join(points: DataFrame, intervals: DataFrame, size: int = BIN, how: str = "inner") -> DataFrame:
    """points (chrom, pos, ...) with the columns of the intervals (chrom, start, end, ...) that hold them.

    how: inner, left, left_semi or left_anti. Interval columns other than chrom must not clash with
    those of points. A null place is in no interval.
    """
    (stored,) = level_counts(size, intervals)
    parts = _parts(stored or {0: 1}, sum(stored.values()))
    held = _placed(intervals, "start", "end", size, _entries(0, parts), 0, None, "_to").withColumnsRenamed({"chrom": "_chrom"})
    pos = F.col("pos")
    slots = [_slot(bin_of(pos, size * FACTOR**level), F.lit(level), F.lit(0), F.pmod(F.xxhash64(pos), F.lit(n))) for level, n in parts.items()]
    inside = (pos >= F.col("start")) & (pos < F.col("end")) & (F.col("chrom") == F.col("_chrom"))
    join = lambda left, slot, how: left.join(held, inside & (slot == F.col("_to")), how).drop("_chrom", "_to")
    if len(slots) == 1:
        return join(points, slots[0], how)
    if how in ("inner", "left"):
        found = join(points.withColumn("_slot", F.explode(F.array(*slots))), F.col("_slot"), "inner").drop("_slot")
        return found if how == "inner" else found.unionByName(reduce(lambda left, x: join(left, x, "left_anti"), slots, points), allowMissingColumns=True)
    left, out = points, []
    for x in slots:
        out.append(join(left, x, "left_semi"))
        left = join(left, x, "left_anti")
    return left if how == "left_anti" else reduce(DataFrame.unionByName, out)


def overlap_join(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals; a's columns as they are, b's with the prefix ``b_``, both unclipped. Empty intervals overlap nothing."""
    in_a, in_b = level_counts(size, a, b)
    rows = sum(in_a.values()) + sum(in_b.values())
    # role 0: b is stored and looked for by what is in a at its level or below; role 1: a is stored and looked for from below
    parts_b = _parts({k: n for k, n in in_b.items() if in_a and min(in_a) <= k}, rows)
    parts_a = _parts({k: n for k, n in in_a.items() if in_b and min(in_b) < k}, rows)
    entries = _entries(0, parts_b) + _entries(1, parts_a)
    x = _placed(a, "start", "end", size, entries, 1, None, "_slot")
    y = _placed(b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]), "b_start", "b_end", size, entries, 0, 1, "_b_slot")
    # an interval looks into two bins at most, or lies in as many in each part; tables that may be broadcast are left to the planner
    placed_a = sum(2 * n * (parts_a.get(k, 0) + sum(level >= k for level in parts_b)) for k, n in in_a.items())
    placed_b = sum(2 * n * (parts_b.get(k, 0) + sum(level > k for level in parts_a)) for k, n in in_b.items())
    if min(placed_a, placed_b) > BROADCAST_ROWS and (n := tasks_for(a, placed_a + placed_b)) > tasks_for(a, 0):
        x, y = x.repartition(n, "chrom", "_slot"), y.repartition(n, "b_chrom", "_b_slot")
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_slot") == F.col("_b_slot")) & (F.col("b_start") < F.col("end")) & (F.col("start") < F.col("b_end"))
    width = F.pow(F.lit(float(FACTOR)), F.floor(F.pmod(F.col("_slot"), F.lit(STEP)) / (2 * PARTS))) * size
    return x.join(y, on & (F.floor(F.col("_slot") / STEP) == F.floor(F.greatest("start", "b_start") / width))).drop("_slot", "_b_slot")


def overlap(pairs: DataFrame) -> Column:
    """Length of the overlap of a pair from overlap_join."""
    return F.least("end", "b_end") - F.greatest("start", "b_start")


def anti_join(a: DataFrame, b: DataFrame, key: str, size: int = BIN) -> DataFrame:
    """The intervals of a, whole, that no interval of b overlaps. key identifies a's intervals."""
    hit = overlap_join(a.select(key, "chrom", "start", "end"), b.select("chrom", "start", "end"), size).select(key).distinct()
    return a.join(hit, key, "left_anti")


def map_distinct(regions: DataFrame, tracks: DataFrame, key: str = "locus", size: int = BIN) -> DataFrame:
    """(key, labels array<string>): the sorted distinct labels over each region; empty if none."""
    hit = overlap_join(regions.select(key, "chrom", "start", "end"), tracks.select("chrom", "start", "end", "label"), size)
    got = hit.groupBy(key).agg(F.array_sort(F.collect_set("b_label")).alias("labels"))
    return regions.select(key).distinct().join(got, key, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def resolve_priority(labels: DataFrame, priority: list[str] | None = None, key: str = "locus", null_label: str = "None", check: bool = True) -> DataFrame:
    """(key, label) from (key, labels): the null label for none, the only one, or the first in priority.

    Without a priority the order is alphabetical, of any number of labels. With check, a priority
    that isn't exactly the set of labels observed is an error.
    """
    if priority is None:
        first = F.array_min("labels")
    else:
        if check:
            seen = labels.select(F.explode("labels").alias("label")).distinct()
            strange = [r[0] for r in seen.where(~F.col("label").isin(list(priority))).limit(10).collect()]
            absent = set(priority) - {r[0] for r in seen.where(F.col("label").isin(list(priority))).collect()}  # as many as the priority names
            if strange or absent:
                raise ValueError(f"the priority {list(priority)} must hold exactly the labels observed; not in it: {strange}, not observed: {sorted(absent)}")
        order = F.array(*[F.lit(p) for p in priority]).cast("array<string>")
        ranked = F.transform("labels", lambda x: F.struct((F.array_position(order, x) + F.when(F.array_position(order, x) == 0, 1 << 30).otherwise(0)).alias("rank"), x.alias("label")))
        first = F.array_min(ranked)["label"]
    return labels.select(key, F.when(F.size("labels") == 0, F.lit(null_label)).otherwise(first).alias("label"))


def coverage_count(regions: DataFrame, points: DataFrame, key: str = "locus", size: int = BIN) -> DataFrame:
    """(key, n): how many points each region holds, zeros included; regions may be several segments of one key."""
    hits = point_join(points.select("chrom", "pos"), regions.select(F.col(key), "chrom", "start", "end"), size).groupBy(key).agg(F.count("*").alias("n"))
    return regions.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def map_sum(regions: DataFrame, tracks: DataFrame, key: str = "locus", size: int = BIN) -> DataFrame:
    """(key, total): the sum of the values over each region, zero if none."""
    hit = overlap_join(regions.select(key, "chrom", "start", "end"), tracks.select("chrom", "start", "end", "value"), size)
    got = hit.groupBy(key).agg(F.sum("b_value").alias("total"))
    return regions.select(key).distinct().join(got, key, "left").select(key, F.coalesce("total", F.lit(0.0)).alias("total"))


def mean_signal(regions: DataFrame, signal: DataFrame, key: str = "locus", extend: int = 0, least_share: float = 0.0, size: int = BIN) -> DataFrame:
    """(key, mean): the signal's mean over each region's bases, uncovered bases counting as zero.

    extend widens every segment on both sides; least_share drops signal intervals of which a smaller share lies inside.
    """
    wide = regions.withColumns({"start": F.greatest(F.col("start") - extend, F.lit(0)), "end": F.col("end") + extend}).select(key, "chrom", "start", "end")
    hit = overlap_join(wide, signal.select("chrom", "start", "end", "value"), size).withColumn("_o", F.least("end", "b_end") - F.greatest("start", "b_start"))
    if least_share:
        hit = hit.where(F.col("_o") >= least_share * (F.col("b_end") - F.col("b_start")))
    got = hit.groupBy(key).agg(F.sum(F.col("b_value") * F.col("_o")).alias("_s"))
    length = wide.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("_l"))
    return length.join(got, key, "left").select(key, (F.coalesce("_s", F.lit(0.0)) / F.col("_l")).alias("mean"))


def apportion(segs: DataFrame, value: str, key: str = "locus") -> DataFrame:
    """segs with value split over the segments of a key by length."""
    length = F.col("end") - F.col("start")
    return segs.withColumn(value, F.col(value) * length / F.sum(length).over(W.partitionBy(key)))


def allowed_chroms(df: DataFrame, chroms: DataFrame) -> DataFrame:
    """The rows of df whose chrom is in chroms (chrom, ...), a list of chromosomes that is broadcast."""
    return df.join(F.broadcast(chroms.select("chrom").distinct()), "chrom", "left_semi")


def assemble(segs: DataFrame, key: str = "window") -> DataFrame:
    """One region per key from its segments: first chrom, start, end, and blocks relative to start in order."""
    g = segs.groupBy(key).agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").cast("int").alias("n_blocks"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_b"))
    return g.select(key, "chrom", "start", "end", "n_blocks", F.transform("_b", lambda b: (b["end"] - b["start"]).cast("int")).alias("block_sizes"), F.transform("_b", lambda b: (b["start"] - F.col("start")).cast("int")).alias("block_starts"))
