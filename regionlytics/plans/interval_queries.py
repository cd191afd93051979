"""Queries over intervals and points, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import durable
from ..operators import intervals as iv
from ..operators import nearest as nr
from . import fixture as fx

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def points(spark, sf):
    return fx.snvs(spark, sf).where("filter = 'PASS'")


def spans(spark, sf):
    return fx.loci(spark, sf).select("locus", "chrom", "start", "end")


IN_LOCUS = "p.chrom = l.chrom and p.pos >= l.s and p.pos < l.e"


@query("snv_window_histogram", fx.sql(f"select l.locus, p.context, count(*) as n, sum(p.weight) as weight from snvs p join loci l on {IN_LOCUS} where p.filter = 'PASS' group by 1, 2", "loci", "snvs"))
def snv_window_histogram(spark, sf):
    hit = iv.point_join(points(spark, sf).select("chrom", "pos", "context", "weight"), spans(spark, sf))
    return hit.groupBy("locus", "context").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("snv_filter_project", fx.sql("select sample, 'x' || chrom as chrom, pos + 1 as pos1, weight from snvs where filter = 'PASS' and info = 'F' and weight > 10", "snvs"))
def snv_filter_project(spark, sf):
    return points(spark, sf).where(F.expr("info = 'F' AND weight > 10")).select("sample", F.concat(F.lit("x"), "chrom").alias("chrom"), (F.col("pos") + 1).alias("pos1"), "weight")


@query("chrom_semi_join", fx.sql("select sample, chrom, pos from snvs where chrom in (select 'chr' || (r_regionkey + 1) from region where r_regionkey < 2)", "snvs"))
def chrom_semi_join(spark, sf):
    chroms = fx.read(spark, sf, "region").where("r_regionkey < 2").selectExpr("concat('chr', r_regionkey + 1) AS chrom")
    return iv.allowed_chroms(fx.snvs(spark, sf).select("sample", "chrom", "pos"), chroms).select("sample", "chrom", "pos")


OVER = "t.chrom = l.chrom and t.s < l.e and l.s < t.e"


@query("interval_overlap_join", fx.sql(f"select l.locus, t.event_id, l.s as \"start\", t.s as b_start, (least(l.e, t.e) - greatest(l.s, t.s))::bigint as overlap from loci l join tracks t on {OVER}", "loci", "tracks"))
def interval_overlap_join(spark, sf):
    pairs = iv.overlap_join(spans(spark, sf), fx.tracks(spark, sf).select("event_id", "chrom", "start", "end"))
    return pairs.select("locus", F.col("b_event_id").alias("event_id"), "start", "b_start", iv.overlap(pairs).cast("long").alias("overlap"))


#: Intervals from ten bases to a chromosome's length.
MIXED = ", m as (select locus, chrom, case when locus < 10 then 0 else s end as s, case when locus < 10 then 250000000 else s + 10 * (4 ** (locus % 5))::bigint end as e from loci)"


def mixed(spark, sf):
    whole = F.col("locus") < 10
    length = F.lit(10) * F.pow(F.lit(4), F.col("locus") % 5).cast("long")
    return fx.loci(spark, sf).select("locus", "chrom", F.when(whole, 0).otherwise(F.col("start")).alias("start"), F.when(whole, 250_000_000).otherwise(F.col("start") + length).alias("end"))


@query("mixed_length_overlap", fx.sql(MIXED + " select m.locus, count(*) as n, sum(least(m.e, t.e) - greatest(m.s, t.s))::bigint as bases from m join tracks t on t.chrom = m.chrom and t.s < m.e and m.s < t.e group by m.locus", "loci", "tracks"))
def mixed_length_overlap(spark, sf):
    pairs = iv.overlap_join(mixed(spark, sf), fx.tracks(spark, sf).select("event_id", "chrom", "start", "end"))
    return pairs.groupBy("locus").agg(F.count("*").alias("n"), F.sum(iv.overlap(pairs)).cast("long").alias("bases"))


@query("mixed_length_coverage", fx.sql(MIXED + " select m.locus, count(p.pos) as n from m left join snvs p on p.chrom = m.chrom and p.pos >= m.s and p.pos < m.e and p.filter = 'PASS' group by m.locus", "loci", "snvs"))
def mixed_length_coverage(spark, sf):
    return iv.coverage_count(mixed(spark, sf), points(spark, sf))


@query("interval_anti_join", fx.sql(f"select l.locus, l.chrom, l.s as \"start\", l.e as \"end\" from loci l where not exists (select 1 from tracks t where {OVER} and t.label = 'click')", "loci", "tracks"))
def interval_anti_join(spark, sf):
    return iv.anti_join(spans(spark, sf), fx.tracks(spark, sf).where("label = 'click'"), "locus").select("locus", "chrom", "start", "end")


@query("interval_map_distinct", fx.sql(f"select l.locus, coalesce(string_agg(distinct t.label, ',' order by t.label), 'none') as labels from loci l left join tracks t on {OVER} group by l.locus", "loci", "tracks"))
def interval_map_distinct(spark, sf):
    m = iv.map_distinct(spans(spark, sf), fx.tracks(spark, sf))
    return m.select("locus", F.when(F.size("labels") == 0, "none").otherwise(F.concat_ws(",", "labels")).alias("labels"))


@query("class_priority", fx.sql(f", r as (select event_type as label, row_number() over (order by event_type desc) as rank from (select distinct event_type from events)) select l.locus, coalesce(min_by(t.label, r.rank), 'None') as label from loci l left join tracks t on {OVER} left join r on r.label = t.label group by l.locus", "loci", "tracks"))
def class_priority(spark, sf):
    t = fx.tracks(spark, sf)
    order = sorted((r[0] for r in t.select("label").distinct().collect()), reverse=True)
    return iv.resolve_priority(iv.map_distinct(spans(spark, sf), t), order, check=False)


@query("interval_coverage_count", fx.sql(f"select l.locus, count(p.pos) as n from loci l left join snvs p on {IN_LOCUS} and p.filter = 'PASS' group by l.locus", "loci", "snvs"))
def interval_coverage_count(spark, sf):
    return iv.coverage_count(spans(spark, sf), points(spark, sf))


@query("interval_map_sum", fx.sql(f"select l.locus, round(coalesce(sum(t.value), 0), 4) as total from loci l left join tracks t on {OVER} group by l.locus", "loci", "tracks"))
def interval_map_sum(spark, sf):
    return iv.map_sum(spans(spark, sf), fx.tracks(spark, sf)).select("locus", F.round("total", 4).alias("total"))


def cents(spark, sf):
    """The tracks with whole values, whose sums don't depend on the order."""
    return fx.tracks(spark, sf).withColumn("value", F.round(F.col("value") * 100))


@query("bin_mean_signal", fx.sql(f"select l.locus, round(coalesce(sum(round(t.value * 100) * (least(l.e, t.e) - greatest(l.s, t.s))), 0) / (l.e - l.s), 4) as mean from loci l left join tracks t on {OVER} group by l.locus, l.s, l.e", "loci", "tracks"))
def bin_mean_signal(spark, sf):
    return iv.mean_signal(spans(spark, sf), cents(spark, sf)).select("locus", F.round("mean", 4).alias("mean"))


@query("half_covered_mean_signal", fx.sql(f"select l.locus, round(coalesce(sum(case when (least(l.e, t.e) - greatest(l.s, t.s)) >= 0.5 * (t.e - t.s) then round(t.value * 100) * (least(l.e, t.e) - greatest(l.s, t.s)) end), 0) / (l.e - l.s), 4) as mean from loci l left join tracks t on {OVER} group by l.locus, l.s, l.e", "loci", "tracks"))
def half_covered_mean_signal(spark, sf):
    return iv.mean_signal(spans(spark, sf), cents(spark, sf), least_share=0.5).select("locus", F.round("mean", 4).alias("mean"))


BLOCKS = "b as (select locus, chrom, 0 as block, s as s, s + 300 as e, (p_size % 10)::double as score from loci union all select locus, chrom, 1, s + 500, s + 800, (p_size % 10)::double from loci)"


def bed12(spark, sf):
    """Regions of two blocks each, from the loci."""
    return fx.loci(spark, sf).selectExpr("locus", "chrom", "start", "start + 800 AS end", "CAST(p_size % 10 AS DOUBLE) AS score", "array(300, 300) AS block_sizes", "array(0, 500) AS block_starts")


@query("unstack_segments", fx.sql(f", {BLOCKS} select locus, chrom, block::int as block, s as \"start\", e as \"end\" from b", "loci"))
def unstack_segments(spark, sf):
    return iv.segments(bed12(spark, sf)).select("locus", "chrom", "block", "start", "end")


@query("score_apportion", fx.sql(f", {BLOCKS} select locus, block::int as block, score * (e - s) / sum(e - s) over (partition by locus) as score from b", "loci"))
def score_apportion(spark, sf):
    r = bed12(spark, sf)
    return iv.apportion(iv.segments(r).join(r.select("locus", "score"), "locus"), "score").select("locus", "block", "score")


@query("nearest_up_down", fx.sql(""", f as (select * from tracks where label = 'purchase'),
z as (select distinct l.locus from loci l join f t on t.chrom = l.chrom and t.s < l.e and l.s < t.e)
select l.locus, case when l.locus in (select locus from z) then 0 else (select l.s - max(e) + 1 from f where f.chrom = l.chrom and f.e <= l.s) end::bigint as upstream,
 case when l.locus in (select locus from z) then 0 else (select min(s) - l.e + 1 from f where f.chrom = l.chrom and f.s >= l.e) end::bigint as downstream from loci l""", "loci", "tracks"))
def nearest_up_down(spark, sf):
    return nr.nearest_before_after(spans(spark, sf), fx.tracks(spark, sf).where("label = 'purchase'"))


@query("distance_progress", fx.sql(""", f as (select * from tracks where label = 'purchase'),
z as (select distinct l.locus from loci l join f t on t.chrom = l.chrom and t.s < l.e and l.s < t.e),
d as (select l.locus, case when l.locus in (select locus from z) then 0 else (select l.s - max(e) + 1 from f where f.chrom = l.chrom and f.e <= l.s) end as u,
 case when l.locus in (select locus from z) then 0 else (select min(s) - l.e + 1 from f where f.chrom = l.chrom and f.s >= l.e) end as d from loci l)
select locus, case when u + d > 0 then round(u / (u + d), 6) else -1 end as progress, case when u + d > 0 then (u + d)::double else -1 end as total from d""", "loci", "tracks"))
def distance_progress(spark, sf):
    d = nr.distance_features(nr.nearest_before_after(spans(spark, sf), fx.tracks(spark, sf).where("label = 'purchase'")))
    return d.select("locus", F.round(F.nanvl("progress", F.lit(-1.0)), 6).alias("progress"), F.nanvl("total", F.lit(-1.0)).alias("total"))


@query("nearest_self", fx.sql(""", d as (select distinct sample, chrom, pos from snvs),
n as (select *, pos - lag(pos) over w as a, lead(pos) over w - pos as b from d window w as (partition by sample, chrom order by pos))
select sample, chrom, pos, case when a is not null and (b is null or a <= b) then pos - a else pos + b end as neighbour, least(a, b) as distance from n""", "snvs"))
def nearest_self(spark, sf):
    return nr.nearest_self(fx.snvs(spark, sf), ["sample", "chrom"]).select("sample", "chrom", "pos", "neighbour", "distance")


@query("nearest_self_ties", fx.sql(""", d as (select distinct sample, chrom, pos from snvs),
n as (select *, pos - lag(pos) over w as a, lead(pos) over w - pos as b from d window w as (partition by sample, chrom order by pos))
select sample, chrom, pos, count(*) as n from (select sample, chrom, pos from n where a <= coalesce(b, a) union all select sample, chrom, pos from n where b <= coalesce(a, b) union all select sample, chrom, pos from n where a is null and b is null) group by 1, 2, 3""", "snvs"))
def nearest_self_ties(spark, sf):
    return nr.nearest_self(fx.snvs(spark, sf), ["sample", "chrom"], ties="all").groupBy("sample", "chrom", "pos").agg(F.count("*").alias("n"))


OVERLAY = """, x as (select 'e:' || label as name, chrom, s, e from tracks union all select 'l:' || (p_size % 3), chrom, s, e from loci),
p as (select chrom, s as pos from x union select chrom, e from x), g as (select chrom, pos as s, lead(pos) over (partition by chrom order by pos) as e from p),
o as (select g.chrom, g.s, g.e, string_agg(distinct x.name, '|' order by x.name) as labels from g join x on x.chrom = g.chrom and x.s < g.e and g.s < x.e where g.e - g.s > 5 group by 1, 2, 3)"""


def overlay_tracks(spark, sf):
    t = fx.tracks(spark, sf).selectExpr("'e' AS track", "chrom", "start", "end", "label")
    return t.unionByName(fx.loci(spark, sf).selectExpr("'l' AS track", "chrom", "start", "end", "CAST(p_size % 3 AS STRING) AS label"))


@query("interval_overlay", fx.sql(OVERLAY + " select chrom, s as \"start\", e as \"end\", labels from o", "loci", "tracks"))
def interval_overlay(spark, sf):
    return nr.overlay(overlay_tracks(spark, sf)).select("chrom", "start", "end", F.concat_ws("|", "labels").alias("labels"))


@query("overlay_depth", fx.sql(""", p as (select chrom, s as pos, 1 as d from tracks union all select chrom, e, -1 from tracks), q as (select chrom, pos, sum(d) as d from p group by 1, 2),
r as (select chrom, pos as s, lead(pos) over w as e, sum(d) over w as depth from q window w as (partition by chrom order by pos))
select chrom, s as "start", e as "end", depth::bigint as depth from r where depth > 0 and e is not null""", "tracks"))
def overlay_depth(spark, sf):
    return nr.depth_segments(fx.tracks(spark, sf), stretch=1 << 14).select("chrom", "start", "end", "depth")


@query("region_assembly", fx.sql(OVERLAY + """, k as (select o.* from o where not exists (select 1 from tracks t where t.label = 'click' and t.chrom = o.chrom and t.s < o.e and o.s < t.e)),
c as (select labels, min(struct_pack(chrom := chrom, s := s)) as f from k group by labels), i as (select labels, row_number() over (order by f.chrom, f.s) - 1 as locus from c)
select i.locus, min(k.chrom) as chrom, min(k.s) as "start", max(k.e) as "end", count(*)::int as n_blocks, string_agg((k.e - k.s)::varchar, ',' order by k.s, k.e) as sizes from k join i using (labels) group by i.locus""", "loci", "tracks"))
def region_assembly(spark, sf):
    black = fx.tracks(spark, sf).where("label = 'click'").select("chrom", "start", "end")
    r = nr.make_regions(overlay_tracks(spark, sf), black)
    return r.select("locus", "chrom", "start", "end", "n_blocks", F.concat_ws(",", F.col("block_sizes").cast("array<string>")).alias("sizes"))


@query("first_seen_ids", fx.sql(", c as (select label, min(struct_pack(s := s, i := event_id)) as f from tracks group by label) select label, row_number() over (order by f.s, f.i) - 1 as id from c", "tracks"))
def first_seen_ids(spark, sf):
    c = fx.tracks(spark, sf).groupBy("label").agg(F.min(F.struct("start", "event_id")).alias("f"))
    return durable.numbered(c.select("label", "f.*"), "start", "event_id", name="id").select("label", "id")


@query("sort_check", fx.sql(", o as (select chrom, s, lag(struct_pack(c := chrom, s := s)) over (order by event_id) as before from tracks) select count(*) as rows, count(case when before > struct_pack(c := chrom, s := s) then 1 end) as out_of_order from o", "tracks"))
def sort_check(spark, sf):
    from ..sources.validate import out_of_order

    return out_of_order(fx.tracks(spark, sf), "event_id", ["chrom", "start"])


@query("marginal_rate", fx.sql(f", n as (select l.locus, count(p.pos) as n from loci l left join snvs p on {IN_LOCUS} and p.filter = 'PASS' group by l.locus) select locus, n, round(n / sum(n) over (), 9) as rate from n", "loci", "snvs"))
def marginal_rate(spark, sf):
    return cl.marginal_rate(spans(spark, sf), points(spark, sf)).select("locus", "n", F.round("rate", 9).alias("rate"))


#: The track with whole-number values, and the rate around each point of each sample.
RATED = """, t as (select distinct chrom, s, e, (1 + event_id % 7)::double as value from tracks),
d as (select distinct chrom, pos from snvs), h as (select d.chrom, d.pos, sum(t.value) as v, sum(t.e - t.s) as l from d join t on t.chrom = d.chrom and t.s < d.pos + 1000 and t.e > greatest(d.pos - 1000, 0) group by 1, 2),
j as (select distinct p.sample, p.chrom, p.pos, h.v, h.l from snvs p join h on h.chrom = p.chrom and h.pos = p.pos), r as (select sample, chrom, pos, v / l * count(*) over (partition by sample) as rate from j)"""


def rated(spark, sf):
    t = fx.tracks(spark, sf).selectExpr("chrom", "start", "end", "CAST(1 + event_id % 7 AS DOUBLE) AS value").distinct()
    return cl.local_rate(fx.snvs(spark, sf).select("sample", "chrom", "pos"), t, reach=1000)


@query("local_rate", fx.sql(RATED + " select sample, chrom, pos, round(rate, 6) as rate from r", "snvs", "tracks"))
def local_rate(spark, sf):
    return rated(spark, sf).select("sample", "chrom", "pos", F.round("rate", 6).alias("rate"))


@query("critical_distance", fx.sql(RATED + " select sample, chrom, pos, round(-ln(0.995) / rate, 6) as critical from r", "snvs", "tracks"))
def critical_distance(spark, sf):
    return rated(spark, sf).select("sample", "chrom", "pos", F.round(cl.critical_distance(F.col("rate")), 6).alias("critical"))


#: Clusters use a rate that whole numbers make, so that thresholds agree in both engines.
CLUSTER = """, d as (select distinct sample, chrom, pos, (1 + pos % 5) / 100000.0::double as rate, case when pos % 2 = 0 then 'C>A' else 'T>G' end as mutation_type from snvs),
w as (select *, pos - lag(pos) over (partition by {part} order by pos) as gap, lag(-ln(0.995::double) / rate) over (partition by {part} order by pos) as lim from d),
k as (select *, sum(case when gap is null or gap > least(10000, lim) then 1 else 0 end) over (partition by {part} order by pos) as n from w),
c as (select sample, chrom, pos, {name} as cluster from k), z as (select *, count(*) over (partition by sample, cluster) as cluster_size from c)"""


def rated_points(spark, sf):
    p = durable.dealt(fx.snvs(spark, sf).select("sample", "chrom", "pos"), "sample", "chrom", "pos").distinct()
    return p.withColumns({"rate": (1 + F.col("pos") % 5) / 100000.0, "mutation_type": F.when(F.col("pos") % 2 == 0, "C>A").otherwise("T>G")})


def clustered(spark, sf, **options):
    """Clusters of the rated points, no more of which there are than mutations."""
    return cl.clusters(rated_points(spark, sf), rows=fx.snvs(spark, sf).count(), **options)


@query("mutation_clusters", fx.sql(CLUSTER.format(part="sample, chrom", name="chrom || '_' || n") + " select sample, chrom, pos, cluster, cluster_size from z", "snvs"))
def mutation_clusters(spark, sf):
    return clustered(spark, sf).select("sample", "chrom", "pos", "cluster", "cluster_size")


@query("mutation_clusters_by_type", fx.sql(CLUSTER.format(part="sample, chrom, mutation_type", name="chrom || '_' || mutation_type || '_' || n") + " select sample, chrom, pos, cluster, cluster_size from z", "snvs"))
def mutation_clusters_by_type(spark, sf):
    return clustered(spark, sf, by_type=True).select("sample", "chrom", "pos", "cluster", "cluster_size")


@query("drop_clustered", fx.sql(CLUSTER.format(part="sample, chrom", name="chrom || '_' || n") + " select sample, chrom, pos from z where cluster_size < 3", "snvs"))
def drop_clustered(spark, sf):
    return cl.drop_clustered(clustered(spark, sf)).select("sample", "chrom", "pos")


@query("unclustered_mutations", fx.sql(RATED + """, scaled as (select sample, chrom, pos, rate / 1000000.0::double as rate from r),
w as (select *, pos - lag(pos) over (partition by sample, chrom order by pos) as gap, lag(-ln(0.995::double) / rate) over (partition by sample, chrom order by pos) as lim from scaled),
k as (select *, sum(case when gap is null or gap > least(10000, lim) then 1 else 0 end) over (partition by sample, chrom order by pos) as n from w),
z as (select *, count(*) over (partition by sample, chrom, n) as cluster_size from k)
select sample, chrom, pos, round(rate * 1000000, 6) as rate, cluster_size from z where cluster_size < 3""", "snvs", "tracks"))
def unclustered_mutations(spark, sf):
    """From points and a rate track to the mutations that stay: local rate, clusters under it, small clusters, in one plan."""
    r = rated(spark, sf).withColumn("rate", F.col("rate") / 1e6)
    return cl.drop_clustered(cl.clusters(r, rows=fx.snvs(spark, sf).count())).select("sample", "chrom", "pos", F.round(F.col("rate") * 1e6, 6).alias("rate"), "cluster_size")


@query("cluster_scores", fx.sql(""", d as (select distinct sample, chrom, pos, (1 + pos % 5) / 100000.0::double as rate from snvs),
n as (select *, pos - lag(pos) over w as a, lead(pos) over w - pos as b from d window w as (partition by sample, chrom order by pos))
select sample, chrom, pos, round(-log10(least(a, b) / (-ln(0.995::double) / rate)), 6) as score from n where a is not null or b is not null""", "snvs"))
def cluster_scores(spark, sf):
    return clustered(spark, sf).where("distance IS NOT NULL").select("sample", "chrom", "pos", F.round("score", 6).alias("score"))


@query("moving_average", fx.sql("select locus, sum(p_size) over (partition by chrom order by locus rows between 3 preceding and 3 following) / 7 as smoothed from loci", "loci"))
def moving_average(spark, sf):
    return cl.moving_average(fx.loci(spark, sf), "p_size", ["locus"], 7, ["chrom"]).select("locus", "smoothed")


@query("moving_average_all", fx.sql("select locus, sum(p_size) over (order by chrom, locus rows between 3 preceding and 3 following) / 7 as smoothed from loci", "loci"))
def moving_average_all(spark, sf):
    return cl.moving_average(fx.loci(spark, sf), "p_size", ["chrom", "locus"], 7, stretch=512).select("locus", "smoothed")


@query("annotate_variants", fx.sql(", a as (select chrom, pos, max(weight) as top from snvs where filter = 'PASS' group by 1, 2) select v.sample, v.chrom, v.pos, v.weight, a.top from snvs v left join a on a.chrom = v.chrom and a.pos = v.pos", "snvs"))
def annotate_variants(spark, sf):
    a = points(spark, sf).groupBy("chrom", "pos").agg(F.max("weight").alias("top"))
    return cl.annotate(fx.snvs(spark, sf).select("sample", "chrom", "pos", "weight"), a).select("sample", "chrom", "pos", "weight", "top")


@query("same_place_join", fx.sql("select a.sample as a, b.sample as b, a.chrom, a.pos, count(*) as n from snvs a join snvs b on a.chrom = b.chrom and a.pos = b.pos where a.filter = 'PASS' and b.filter = 'LOWQ' group by 1, 2, 3, 4", "snvs"))
def same_place_join(spark, sf):
    s = fx.snvs(spark, sf).select("sample", "chrom", "pos", "filter")
    a, b = s.where("filter = 'PASS'").select(F.col("sample").alias("a"), "chrom", "pos"), s.where("filter = 'LOWQ'").select(F.col("sample").alias("b"), "chrom", "pos")
    return a.join(b, ["chrom", "pos"]).groupBy("a", "b", "chrom", "pos").agg(F.count("*").alias("n"))


@query("event_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as f from events), i as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) as i from g) select user_id, min(ts) as \"start\", count(*) as n from i group by user_id, i.i")
def event_sessions(spark, sf):
    from ..streaming.online import sessions

    return sessions(fx.read(spark, sf, "events").select("user_id", "ts"), ["user_id"], "ts", gap="6 hours").select("user_id", "start", "n")
