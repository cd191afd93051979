"""Queries over sequences, corpora, features and rates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions import special as sp
from ..operators import corpora as co
from ..operators import durable
from ..operators import intervals as iv
from ..operators import rates as rt
from ..operators import scaling as sc
from ..operators import views as vw
from . import fixture as fx
from .interval_queries import BLOCKS, bed12, query

ALPHABET = "['A','C','G','T']"
BASE = "(case {x} when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 end)"


def base(x: str) -> str:
    return BASE.format(x=x)


@query("trinuc_counts", "with s as (select doc_id as chrom, upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')) as seq from documents), k as (select chrom, substr(seq, i.i, 3) as kmer from s, lateral (select unnest(range(1, length(seq) - 1)) as i) i) select chrom, kmer, count(*) as n from k where regexp_matches(kmer, '^[ACGT]{3}$') group by 1, 2")
def trinuc_counts(spark, sf):
    return sq.kmer_counts(fx.sequences(spark, sf), "chrom", "seq")


CONTEXT = f"{ALPHABET}[(context % 16) // 4 + 1] || {ALPHABET}[context // 16 + 1] || {ALPHABET}[context % 4 + 1]"
ALT = f"list_filter({ALPHABET}, lambda b: b <> {ALPHABET}[context // 16 + 1])[mutation + 1]"
NAMED = f", m as (select *, {CONTEXT} as ctx, {ALT} as alt from snvs), f as (select *, case when ctx[2] in ('C', 'T') then ctx else translate(reverse(ctx), 'ACGT', 'TGCA') end as fctx, case when ctx[2] in ('C', 'T') then alt else translate(alt, 'ACGT', 'TGCA') end as falt, case when ctx[2] in ('C', 'T') then 'f' else 'r' end as strand from m)"


def named(spark, sf):
    c = F.array(*[F.lit(b) for b in sq.BASES])
    at = lambda i: F.element_at(c, (i + 1).cast("int"))
    n = fx.snvs(spark, sf).withColumn("ctx", F.concat(at(F.floor(F.col("context") % 16 / 4)), at(F.floor(F.col("context") / 16)), at(F.col("context") % 4)))
    others = F.filter(c, lambda b: b != F.substring("ctx", 2, 1))
    return n.withColumn("alt", F.element_at(others, (F.col("mutation") + 1).cast("int")))


@query("revcomp_fold", fx.sql(NAMED + " select fctx as context, falt as alt, strand, count(*) as n from f group by 1, 2, 3", "snvs"))
def revcomp_fold(spark, sf):
    n = named(spark, sf)
    c, a = F.col("ctx"), F.col("alt")
    return n.groupBy(sq.fold_context(c).alias("context"), sq.fold_alt(c, a).alias("alt"), sq.strand(c).alias("strand")).agg(F.count("*").alias("n"))


@query("cosmic_label_counts", fx.sql(NAMED + " select corpus, fctx[1] || '[' || fctx[2] || '>' || falt || ']' || fctx[3] as label, count(*) as n, sum(weight) as weight from f group by 1, 2", "snvs"))
def cosmic_label_counts(spark, sf):
    n = named(spark, sf).withColumn("label", sq.cosmic_label(F.col("ctx"), F.col("alt")))
    return n.groupBy("corpus", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("strand_profile", fx.sql(NAMED + ", l as (select sample, fctx[1] || '[' || fctx[2] || '>' || falt || ']' || fctx[3] as label, strand, weight from f) select sample, label, coalesce(sum(weight) filter (strand = 'f'), 0) as f, coalesce(sum(weight) filter (strand = 'r'), 0) as r from l group by 1, 2", "snvs"))
def strand_profile(spark, sf):
    return sq.split_strands(named(spark, sf).select("sample", F.col("ctx").alias("context"), "alt", "weight"))


PRODUCT = f"x as (select (16 * m.i + 4 * l.i + r.i)::int as context_id, l.b || m.b || r.b as context from (select unnest(range(4)) as i, unnest({ALPHABET}) as b) m, (select unnest(range(4)) as i, unnest({ALPHABET}) as b) l, (select unnest(range(4)) as i, unnest({ALPHABET}) as b) r)"


@query("context_index_product", fx.sql(f", {PRODUCT}, t as (select context, sum(n)::bigint as n from trinucs group by 1), m as (select context, count(*) as k from snvs group by 1) select context_id, x.context, coalesce(t.n, 0) as occurrences, coalesce(m.k, 0) as mutations from x left join t on t.context = context_id left join m on m.context = context_id", "snvs", "trinucs"))
def context_index_product(spark, sf):
    """All 64 contexts with their occurrences in the loci and their mutations."""
    t = fx.trinucs(spark, sf).groupBy(F.col("context").alias("context_id")).agg(F.sum("n").cast("long").alias("occurrences"))
    m = fx.snvs(spark, sf).groupBy(F.col("context").alias("context_id")).agg(F.count("*").alias("mutations"))
    x = sq.context_table(spark).select(F.col("context_id").cast("int").alias("context_id"), "context")
    return x.join(t, "context_id", "left").join(m, "context_id", "left").na.fill(0, ["occurrences", "mutations"])


@query("context_roundtrip", fx.sql(NAMED + f" select 16 * {base('ctx[2]')} + 4 * {base('ctx[1]')} + {base('ctx[3]')} as context_id, mutation, count(*) as n from f group by 1, 2", "snvs"))
def context_roundtrip(spark, sf):
    n = named(spark, sf)
    return n.groupBy(sq.context_index(F.col("ctx")).cast("int").alias("context_id"), sq.alt_index(F.col("ctx"), F.col("alt")).cast("int").alias("mutation")).agg(F.count("*").alias("n"))


@query("ref_base_check", "with s as (select doc_id as chrom, upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')) as seq from documents where length(text) > 2), p as (select chrom, 1 + chrom % (length(seq) - 2) as pos, substr(seq, (2 + chrom % (length(seq) - 2))::int, 1) as ref, seq from s) select chrom, pos, ref, substr(seq, pos::int, 3) as context from p")
def ref_base_check(spark, sf):
    from ..operators.clusters import reference_check, sequence_chunks

    s = fx.sequences(spark, sf).where("length(seq) > 2")
    m = s.select("chrom", (1 + F.col("chrom") % (F.length("seq") - 2)).alias("pos"), "seq")
    m = m.select("chrom", "pos", F.substring(F.col("seq"), (F.col("pos") + 1).cast("int"), F.lit(1)).alias("ref"))
    return reference_check(m, sequence_chunks(s, 4096), 4096).select("chrom", "pos", "ref", "context")


@query("empirical_rate", fx.sql("select corpus, locus, context, sum(weight) as weight, round(ln(sum(weight)), 6) as log_weight from snvs group by 1, 2, 3", "snvs"))
def empirical_rate(spark, sf):
    return co.empirical_rate(fx.mutations(spark, sf)).withColumn("log_weight", F.round("log_weight", 6))


@query("mutation_totals", fx.sql("select corpus, sample, sum(weight) as total, count(*) as n from snvs group by 1, 2", "snvs"))
def mutation_totals(spark, sf):
    return co.mutation_totals(fx.mutations(spark, sf))


@query("sample_profile", fx.sql("select sample, context, mutation, sum(weight) as weight from snvs group by 1, 2, 3", "snvs"))
def sample_profile(spark, sf):
    return co.profile(fx.mutations(spark, sf))


def corpus(spark, sf, name):
    loci = fx.loci(spark, sf)
    own = F.lit(name).alias("corpus")
    return co.Corpus(
        fx.mutations(spark, sf).where(F.col("corpus") == name), loci.select(own, "locus", "exposure"), fx.packed_trinucs(spark, sf).select(own, "locus", "n"),
        loci.select(own, "locus", "p_size", "p_retailprice", "p_type", "p_brand"),
    )


@query("corpus_union", fx.sql("select corpus, count(distinct sample) as samples, count(*) as n, count(distinct locus) as loci from snvs group by corpus", "snvs"))
def corpus_union(spark, sf):
    both = co.union([corpus(spark, sf, "c0"), corpus(spark, sf, "c1")])
    return both.mutations.groupBy("corpus").agg(F.count_distinct("sample").alias("samples"), F.count("*").alias("n"), F.count_distinct("locus").alias("loci"))


@query("corpus_shape", fx.sql("select 'c0' as corpus, (select count(distinct sample) from snvs where corpus = 'c0') as samples, (select count(*) from loci) as loci, 64::bigint as contexts, 4::bigint as features", "snvs", "loci"))
def corpus_shape(spark, sf):
    s = corpus(spark, sf, "c0").shape()
    return spark.createDataFrame([("c0", s["samples"], s["loci"], s["contexts"], s["features"])], "corpus string, samples long, loci long, contexts long, features long")


@query("train_test_split", fx.sql(""", k as (select corpus, sample, count(*) as n from snvs where corpus = 'c0' group by corpus, sample),
r as (select sample, n, row_number() over (order by md5('0:' || corpus || ':' || sample::varchar), sample) - 1 as i, count(*) over () as total from k)
select sample, n, case when i < floor(0.7 * total) then 'train' else 'test' end as side from r""", "snvs"))
def train_test_split(spark, sf):
    train, test = co.split(corpus(spark, sf, "c0"), 0.7)
    side = lambda c, n: c.mutations.groupBy("sample").agg(F.count("*").alias("n")).withColumn("side", F.lit(n))
    return side(train, "train").unionByName(side(test, "test"))


@query("split_anti", fx.sql(", a as (select distinct corpus, sample from snvs), t as (select * from a where sample % 10 < 7) select * from a except select * from t", "snvs"))
def split_anti(spark, sf):
    a = corpus(spark, sf, "c0").samples().unionByName(corpus(spark, sf, "c1").samples())
    return a.join(a.where("sample % 10 < 7"), ["corpus", "sample"], "left_anti")


@query("subset_samples", fx.sql("select sample, count(*) as n from snvs where corpus = 'c0' and sample % 4 = 2 group by sample", "snvs"))
def subset_samples(spark, sf):
    c = corpus(spark, sf, "c0")
    return co.subset_samples(c, c.samples().where("sample % 4 = 2")).mutations.groupBy("sample").agg(F.count("*").alias("n"))


@query("subset_loci_reindex", fx.sql(", k as (select locus, row_number() over (order by locus) - 1 as id from loci where p_size % 2 = 0) select k.id as locus, s.context, count(*) as n from snvs s join k using (locus) where s.corpus = 'c0' group by 1, 2", "loci", "snvs"))
def subset_loci_reindex(spark, sf):
    c = co.subset_loci(corpus(spark, sf, "c0"), fx.loci(spark, sf).where("p_size % 2 = 0").select("locus"))
    return c.mutations.groupBy("locus", "context").agg(F.count("*").alias("n"))


@query("dense_ids", fx.sql("select locus, row_number() over (order by chrom, s, locus) - 1 as ordinal from loci", "loci"))
def dense_ids(spark, sf):
    return durable.numbered(fx.loci(spark, sf), "chrom", "start", "locus").select("locus", "ordinal")


@query("feature_union", fx.sql(", c as (select 'c0' as corpus, locus, p_size from loci union all select 'c1', locus, p_size from loci) select corpus, count(*) as n, sum(p_size)::bigint as size from c group by corpus", "loci"))
def feature_union(spark, sf):
    f = co.union([corpus(spark, sf, "c0"), corpus(spark, sf, "c1")]).features
    return f.groupBy("corpus").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("genome_context_share", fx.sql("select context, round(sum(n) / (select sum(n) from trinucs), 9) as share from trinucs group by context", "trinucs"))
def genome_context_share(spark, sf):
    return co.context_share(fx.trinucs(spark, sf)).select("context", F.round("share", 9).alias("share"))


def features(spark, sf, kinds, ordinal=False, digits=6):
    df = fx.loci(spark, sf)
    t = sc.FeatureTransform(kinds, ordinal=ordinal).fit(df)
    return t.transform(df, "locus").select("locus", *[F.round(F.col(f"`{n}`"), digits).alias(n.replace("=", "_").replace("#", "").replace(" ", "_")) for n in t.names()])


@query("minmax_features", fx.sql("select locus, round((p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ()), 6) as p_size from loci", "loci"))
def minmax_features(spark, sf):
    return features(spark, sf, {"p_size": "minmax"})


@query("standardize_features", fx.sql("select locus, round((p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 6) as p_size, round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 6) as p_retailprice from loci", "loci"))
def standardize_features(spark, sf):
    return features(spark, sf, {"p_size": "standardize", "p_retailprice": "standardize"})


@query("robust_features", fx.sql(", q as (select quantile_cont(p_retailprice, 0.25) as a, quantile_cont(p_retailprice, 0.5) as m, quantile_cont(p_retailprice, 0.75) as b from loci) select locus, round((p_retailprice - m) / (b - a), 6) as p_retailprice from loci, q", "loci"))
def robust_features(spark, sf):
    return features(spark, sf, {"p_retailprice": "robust"})


#: Ranks among the 1,001 quantiles: the fixture has fewer rows than the quantiles' accuracy, so both engines find the same ones.
_GRID = "select list_transform(range(1001), lambda i: v[greatest(1, ceil((i / 1000::double) * len(v))::bigint)]) as g from (select list({0}::double order by {0}) as v from loci)"
_RANK = "case when x <= g[1] then 0 when x >= g[1001] then 1 when upto > below then (below + upto - 1) / 2 / 1000 else (below - 1 + (x - g[below]) / (g[below + 1] - g[below])) / 1000 end"


def _quantile_sql(name: str) -> str:
    counted = f"select locus, {name}::double as x, g, len(list_filter(g, lambda q: q < {name})) as below, len(list_filter(g, lambda q: q <= {name})) as upto from loci, ({_GRID.format(name)})"
    return f"(select locus, round({_RANK}, 6) as {name} from ({counted}))"


@query("quantile_features", fx.sql(f"select a.locus, a.p_retailprice, b.p_size from {_quantile_sql('p_retailprice')} a join {_quantile_sql('p_size')} b using (locus)", "loci"))
def quantile_features(spark, sf):
    return features(spark, sf, {"p_retailprice": "quantile", "p_size": "quantile"})


@query("power_features")
def power_features(spark, sf):
    return features(spark, sf, {"p_retailprice": "power", "p_size": "power"})


@query("ordinal_features", fx.sql("select locus, (dense_rank() over (order by p_brand) - 1)::double as p_brand from loci", "loci"))
def ordinal_features(spark, sf):
    return features(spark, sf, {"p_brand": "categorical"}, ordinal=True)


@query("onehot_features", fx.sql(", v as (select p_brand, dense_rank() over (order by p_brand) - 1 as level from (select distinct p_brand from part)) select l.locus, v.level as level from loci l join v using (p_brand)", "loci"))
def onehot_features(spark, sf):
    df = fx.loci(spark, sf)
    t = sc.FeatureTransform({"p_brand": "categorical"}).fit(df)
    dummies = t.transform(df, "locus")
    level = sum((F.col(f"`{n}`") * (i + 1) for i, n in enumerate(t.names())), F.lit(0.0))
    return dummies.select("locus", level.cast("long").alias("level"))


@query("nucleotide_effect", fx.sql("select d.component, t.locus, round(sum(d.delta * t.n), 6) as effect from trinucs t join deltas d using (context) group by 1, 2", "trinucs", "deltas"))
def nucleotide_effect(spark, sf):
    return rt.nucleotide_effect(fx.trinucs(spark, sf), fx.deltas(spark)).select("component", "locus", F.round("effect", 6).alias("effect"))


EFFECT = ", f as (select d.component, t.locus, sum(d.delta * t.n) as effect from trinucs t join deltas d using (context) group by 1, 2)"
MODEL = ("trinucs", "deltas", "rates")


def model_tables(spark, sf):
    return fx.rates(spark, sf), fx.packed_trinucs(spark, sf), fx.deltas(spark), fx.loci(spark, sf).select("locus", "exposure")


@query("log_denominator", fx.sql(EFFECT + " select component, round(ln(sum(effect * exp(logmu) * exposure)), 6) as log_z from f join rates using (component, locus) join (select locus, exposure from loci) using (locus) group by component", *MODEL))
def log_denominator(spark, sf):
    return rt.log_denominator(*model_tables(spark, sf)).select("component", F.round("log_z", 6).alias("log_z"))


@query("context_exposure", fx.sql(" select component, context, round(sum(n * exposure * exp(logmu)), 3) as eta from trinucs join rates using (locus) join (select locus, exposure from loci) using (locus) group by 1, 2", *MODEL))
def context_exposure(spark, sf):
    r, t, _, e = model_tables(spark, sf)
    return rt.context_exposure(r, t, e).select("component", "context", F.round("eta", 3).alias("eta"))


PSI = EFFECT + ", z as (select component, sum(effect * exp(logmu) * exposure) as z from f join rates using (component, locus) join (select locus, exposure from loci) using (locus) group by component), p as (select d.component, context, t.locus, d.delta * t.n * exp(r.logmu) * l.exposure / z.z as psi from trinucs t join deltas d using (context) join rates r on r.component = d.component and r.locus = t.locus join loci l on l.locus = t.locus join z on z.component = d.component)"


@query("psi_tensor_sum", fx.sql(PSI + " select component, context, round(sum(psi), 9) as psi from p group by 1, 2", *MODEL))
def psi_tensor_sum(spark, sf):
    return rt.psi(*model_tables(spark, sf)).groupBy("component", "context").agg(F.round(F.sum("psi"), 9).alias("psi"))


@query("psi_by_locus", fx.sql(PSI + " select component, locus, round(sum(psi), 9) as psi from p group by 1, 2", *MODEL))
def psi_by_locus(spark, sf):
    return rt.psi(*model_tables(spark, sf), use_context=False).select("component", "locus", F.round("psi", 9).alias("psi"))


def mixture_weights(spark):
    return spark.createDataFrame([(k, float(k + 1)) for k in range(fx.COMPONENTS)], "component int, w double")


@query("marginal_mixture", fx.sql(PSI + " select locus, context, round(ln(sum(psi * (component + 1) / 6)), 6) as log_rate from p group by 1, 2", *MODEL))
def marginal_mixture(spark, sf):
    return rt.mixed_rates(*model_tables(spark, sf), mixture_weights(spark)).select("locus", "context", F.round("log_rate", 6).alias("log_rate"))


MIXED = PSI + ", v as (select l.chrom, l.s, p.locus, sum(psi * (component + 1) / 6) as v from p join loci l using (locus) group by all)"


@query("rate_track", fx.sql(MIXED + """, o as (select *, row_number() over (order by chrom, s, locus) - 1 as i, sum(v) over (order by chrom, s, locus rows between 15 preceding and 14 following) / 30 as w from v), t as (select count(*) as n, sum(v) as v, sum(w) as w from o),
b as (select (i * least(200, n) // n)::int as bin, i, o.v / t.v as raw, o.w / t.w as smooth from o, t)
select bin, min(i) as "first", max(i) as "last", count(*) as n, round(avg(raw), 10) as raw_mean, round(min(raw), 10) as raw_min, round(max(raw), 10) as raw_max, round(avg(smooth), 10) as smooth_mean, round(min(smooth), 10) as smooth_min, round(max(smooth), 10) as smooth_max from b group by bin""", *MODEL))
def rate_track(spark, sf):
    """The mixed rate of all loci by place, in 200 bins and smoothed over 30 loci."""
    w = mixture_weights(spark)
    w = w.crossJoin(F.broadcast(w.agg(F.sum("w").alias("t")))).select("component", (F.col("w") / F.col("t")).alias("w"))  # a row a component
    v = rt.psi(*model_tables(spark, sf), use_context=False).join(F.broadcast(w), "component").groupBy("locus").agg(F.sum(F.col("w") * F.col("psi")).alias("v"))
    t = vw.rate_track(v.join(fx.loci(spark, sf).select("locus", "chrom", "start"), "locus"), "v", ["chrom", "start", "locus"], 200, 30)
    return t.select("bin", "first", "last", "n", *[F.round(c, 10).alias(c) for c in t.columns[4:]])


def component_matrix(spark, sf):
    """(locus, c0, c1, c2): each component's density over loci."""
    return rt.psi(*model_tables(spark, sf), use_context=False).groupBy("locus").agg(*[F.sum(F.when(F.col("component") == k, F.col("psi"))).alias(f"c{k}") for k in range(fx.COMPONENTS)])


WIDE = ", w as (select locus, sum(psi) filter (component = 0) as c0, sum(psi) filter (component = 1) as c1, sum(psi) filter (component = 2) as c2 from p group by locus)"


@query("rate_matrix", fx.sql(PSI + WIDE + """, m as (select w.*, row_number() over (order by chrom, s, locus) - 1 as i, count(*) over () as n from w join loci using (locus)), u as (unpivot (select i, n, c0, c1, c2 from m) on c0, c1, c2 into name name value v),
d as (select 1 - sum(c0 * c1) / sqrt(sum(c0 * c0) * sum(c1 * c1)) as d01, 1 - sum(c0 * c2) / sqrt(sum(c0 * c0) * sum(c2 * c2)) as d02, 1 - sum(c1 * c2) / sqrt(sum(c1 * c1) * sum(c2 * c2)) as d12 from w),
q as (select * from (select [0, 1, 2] as p, d01 + d12 as cost from d union all select [0, 2, 1], d02 + d12 from d union all select [1, 0, 2], d01 + d02 from d) order by cost limit 1),
s as (select name, i, (i * least(50, n) // n)::int as bin, v / sum(v) over (partition by name) as share from u)
select name, (list_position(q.p, right(name, 1)::int) - 1)::int as position, bin, min(i) as "first", max(i) as "last", round(avg(share), 10) as share from s, q group by all""", *MODEL))
def rate_matrix(spark, sf):
    """The components' densities by place in 50 bins, like ones side by side. The SQL tries all orders of the three."""
    w = component_matrix(spark, sf).join(fx.loci(spark, sf).select("locus", "chrom", "start"), "locus")
    m = vw.rate_matrix(w, ["c0", "c1", "c2"], ["chrom", "start", "locus"], 50)
    return m.withColumn("share", F.round("share", 10))


@query("matrix_by_segment", fx.sql(PSI + WIDE + f", {BLOCKS} select chrom, b.s as \"start\", b.e as \"end\", round(c0, 9) as c0, round(c1, 9) as c1, round(c2, 9) as c2 from b join w using (locus)", *MODEL))
def matrix_by_segment(spark, sf):
    """The components' densities of each locus at each of its blocks."""
    m = vw.matrix_by_segment(component_matrix(spark, sf), iv.segments(bed12(spark, sf)))
    return m.select("chrom", "start", "end", *[F.round(f"c{k}", 9).alias(f"c{k}") for k in range(3)])


@query("pseudo_r2", fx.sql(PSI + """, m as (select locus, context, sum(psi * (component + 1) / 6) as r from p group by 1, 2), y as (select locus, context, sum(weight) as y from snvs group by 1, 2),
c as (select m.locus, m.context, coalesce(y, 0) as y, r, n from m join trinucs using (locus, context) left join y using (locus, context)), t as (select sum(y) as ty, sum(r) as tr, sum(n) as tn from c),
d as (select sum(case when y > 0 then y * ln(y / ty) else 0 end) as own, sum(case when y > 0 then y * ln(r / tr) else 0 end) as model, sum(case when y > 0 then y * ln(n / tn) else 0 end) as base from c, t) select round(1 - (own - model) / (own - base), 6) as r2 from d""", "snvs", *MODEL))
def pseudo_r2(spark, sf):
    y = fx.mutations(spark, sf).groupBy("locus", "context").agg(F.sum("weight").alias("y"))
    cells = rt.mixed_rates(*model_tables(spark, sf), mixture_weights(spark), counts=y).withColumn("rate", F.exp("log_rate"))
    return rt.pseudo_r2(cells, "y", "rate", "n").select(F.round("r2", 6).alias("r2"))


@query("glm_targets", fx.sql(", s as (select sample % 3 as component, locus, sum(weight) as target from snvs group by 1, 2), e as (select s.*, exposure as eta from s join loci using (locus)), m as (select *, avg(target / eta) over (partition by component) as m from e) select component, locus, round(target / (eta * m), 6) as y, round(eta * m / avg(eta * m) over (partition by component), 6) as w from m", "loci", "snvs"))
def glm_targets(spark, sf):
    s = fx.mutations(spark, sf).groupBy((F.col("sample") % 3).alias("component"), "locus").agg(F.sum("weight").alias("target"))
    s = s.join(fx.loci(spark, sf).select("locus", F.col("exposure").alias("eta")), "locus")
    return rt.glm_targets(s).select("component", "locus", F.round("y", 6).alias("y"), F.round("w", 6).alias("w"))


@query("sufficient_stats_grouping_sets", fx.sql(", p as (select sample % 3 as component, context, mutation, corpus, locus, weight as value from snvs) select component, context, mutation, corpus, locus, grouping(component, context, mutation, corpus, locus)::bigint as level, sum(value) as value from p group by grouping sets ((component, context, mutation), (component, context), (component, corpus, locus))", "snvs"))
def sufficient_stats_grouping_sets(spark, sf):
    phi = fx.mutations(spark, sf).select((F.col("sample") % 3).alias("component"), "context", "mutation", "corpus", "locus", F.col("weight").alias("value"))
    return rt.sufficient_stats(phi)


@query("marginal_signature", fx.sql(", y as (select context, sum(weight) as y from snvs group by context) select n.context, round(coalesce(y.y, 0) / n.n, 9) as rate from (select context, sum(n) as n from trinucs group by context) n left join y using (context)", "snvs", "trinucs"))
def marginal_signature(spark, sf):
    return rt.marginal_signature(fx.mutations(spark, sf), fx.trinucs(spark, sf)).select("context", F.round("rate", 9).alias("rate"))


@query("log_bias", fx.sql("select corpus, round(ln(sum(weight)) - ln(sum(exp(context / 64))), 6) as bias from snvs group by corpus", "snvs"))
def log_bias(spark, sf):
    return rt.log_bias(fx.snvs(spark, sf).withColumn("f", F.col("context") / 64), "weight", "f").withColumn("bias", F.round("bias", 6))


G = "(x + 8)"
DIGAMMA = f"(ln({G}) - 0.5 / {G} - 1 / ({G} * {G}) * (1 / 12.0::double - 1 / ({G} * {G}) * (1 / 120.0::double - 1 / ({G} * {G}) * (1 / 252.0::double - 1 / ({G} * {G}) * (1 / 240.0::double - 1 / ({G} * {G}) / 132.0::double)))) - " + " - ".join(f"1 / (x + {i})" for i in range(8)) + ")"


def shares(spark, sf):
    g = fx.mutations(spark, sf).groupBy("corpus", "sample", (F.col("context") % 3).alias("component")).agg((F.lit(1.0) + F.sum("weight")).alias("gamma"))
    return g


@query("dirichlet_expectation", fx.sql(f", g as (select corpus, sample, context % 3 as component, 1.0::double + sum(weight) as x from snvs group by 1, 2, 3), t as (select corpus, sample, sum(x) as x from g group by 1, 2), a as (select corpus, sample, component, {DIGAMMA} as d from g), b as (select corpus, sample, {DIGAMMA} as d from t) select component, round(avg(a.d - b.d), 6) as logp from a join b using (corpus, sample) group by component", "snvs"))
def dirichlet_expectation(spark, sf):
    return rt.dirichlet_log_mean(shares(spark, sf)).select("component", F.round("logp", 6).alias("logp"))


@query("dirichlet_bound", fx.sql(", g as (select corpus, sample, context % 3 as component, 1.0::double + sum(weight) as x from snvs group by 1, 2, 3) select corpus, sample, round(lgamma(3) - lgamma(sum(x)) + sum(lgamma(x)), 3) as bound from g group by 1, 2", "snvs"))
def dirichlet_bound(spark, sf):
    return shares(spark, sf).groupBy("corpus", "sample").agg(F.round(sp.lgamma(F.lit(3.0)) - sp.lgamma(F.sum("gamma")) + F.sum(sp.lgamma(F.col("gamma"))), 3).alias("bound"))


@query("svi_learning_rate", fx.sql(", b as (select sample % 50 as step, avg(weight) as own from snvs group by 1), a as (select avg(weight) as whole from snvs) select step, round(pow(16 + step, -0.5), 9) as rate, round((1 - pow(16 + step, -0.5)) * whole + pow(16 + step, -0.5) * own, 6) as blended from b, a", "snvs"))
def svi_learning_rate(spark, sf):
    """Batches of samples: the rate of each one's step, and the mean weight of all with the batch's own blended in at that rate."""
    m = fx.snvs(spark, sf)
    own = m.groupBy((F.col("sample") % 50).alias("step")).agg(F.avg("weight").alias("own"))
    rate = sp.learning_rate(F.col("step"))
    both = own.crossJoin(F.broadcast(m.agg(F.avg("weight").alias("whole"))))  # one row
    return both.select("step", F.round(rate, 9).alias("rate"), F.round(sp.blend(F.col("whole"), F.col("own"), rate), 6).alias("blended"))


@query("estep_single", fx.sql(", s as (select component, context, mutation, omega / sum(omega) over (partition by component, context) * delta as f from signatures join deltas using (component, context)), m as (select corpus, sample, locus, context, mutation, sum(weight) as w from snvs group by 1, 2, 3, 4, 5), j as (select m.*, s.component, s.f * exp(r.logmu) as f from m join s using (context, mutation) join rates r on r.locus = m.locus and r.component = s.component), p as (select *, f / sum(f) over (partition by corpus, sample, locus, context, mutation) * w as phi from j) select corpus, sample, component, round(1 + sum(phi), 4) as gamma from p group by 1, 2, 3", "snvs", "deltas", "rates"))
def estep_single(spark, sf):
    g = rt.one_step_gamma(fx.mutations(spark, sf), fx.rates(spark, sf), fx.deltas(spark), fx.signatures(spark))
    return g.select("corpus", "sample", "component", F.round("gamma", 4).alias("gamma"))


#: Likelihoods of cells, compositions after one step, and their digammas.
BOUND = f""", s as (select component, context, mutation, omega / sum(omega) over (partition by component, context) * delta as f from signatures join deltas using (component, context)),
m as (select corpus, sample, locus, context, mutation, sum(weight) as w from snvs group by 1, 2, 3, 4, 5),
j as (select m.*, s.component, s.f * exp(r.logmu) as f from m join s using (context, mutation) join rates r on r.locus = m.locus and r.component = s.component),
p as (select *, f / sum(f) over (partition by corpus, sample, locus, context, mutation) * w as phi from j),
g as (select corpus, sample, component, 1 + sum(phi) as x from p group by 1, 2, 3), t as (select corpus, sample, sum(x) as x from g group by 1, 2),
dg as (select corpus, sample, component, x, {DIGAMMA} as d from g), dt as (select corpus, sample, x as total, {DIGAMMA} as d from t),
e as (select dg.corpus, dg.sample, component, x, total, dg.d - dt.d as e from dg join dt using (corpus, sample)),
c as (select j.corpus, j.sample, j.locus, j.context, j.mutation, any_value(w) as w, ln(sum(exp(e.e) * j.f)) as l from j join e using (corpus, sample, component) group by 1, 2, 3, 4, 5),
k as (select corpus, sample, sum(w * l) as s, sum(w) as w from c group by 1, 2),
q as (select corpus, sample, lgamma(count(*)) - lgamma(any_value(total)) + sum(lgamma(x) + (1 - x) * e) as s from e group by 1, 2)"""


def _bounds(spark, sf):
    tables = fx.mutations(spark, sf), fx.rates(spark, sf), fx.deltas(spark), fx.signatures(spark)
    return rt.evidence_bound_of(*tables, rt.one_step_gamma(*tables))


@query("evidence_bound", fx.sql(BOUND + " select corpus, sample, round((k.s + q.s) / k.w, 6) as bound from k join q using (corpus, sample)", "snvs", "deltas", "rates"))
def evidence_bound(spark, sf):
    return _bounds(spark, sf).select("corpus", "sample", F.round(F.col("bound") / F.col("weight"), 6).alias("bound"))


@query("perplexity", fx.sql(BOUND + " select corpus, round(exp(-sum(k.s + q.s) / sum(k.w)), 5) as perplexity from k join q using (corpus, sample) group by corpus", "snvs", "deltas", "rates"))
def perplexity(spark, sf):
    return _bounds(spark, sf).groupBy("corpus").agg(F.round(F.exp(-F.sum("bound") / F.sum("weight")), 5).alias("perplexity"))


@query("dirichlet_multinomial", fx.sql(", n as (select corpus, sample, count(*) filter (mutation = 0) as a, count(*) filter (mutation = 1) as b, count(*) filter (mutation = 2) as c from snvs group by 1, 2) select corpus, sample, round(lgamma(3.5) - lgamma(3.5 + a + b + c) + lgamma(0.5 + a) - lgamma(0.5) + lgamma(1 + b) - lgamma(1) + lgamma(2 + c) - lgamma(2), 5) as logp from n", "snvs"))
def dirichlet_multinomial(spark, sf):
    n = fx.snvs(spark, sf).groupBy("corpus", "sample").agg(*[F.count_if(F.col("mutation") == i).alias(f"n{i}") for i in range(3)])
    return n.select("corpus", "sample", F.round(sp.dirichlet_multinomial([0.5, 1.0, 2.0], ["n0", "n1", "n2"]), 5).alias("logp"))


@query("component_subset", fx.sql(", g as (select corpus, sample, context % 3 as component, 1.0::double + sum(weight) as gamma from snvs where context % 3 < 2 group by 1, 2, 3) select corpus, sample, component, round(gamma / sum(gamma) over (partition by corpus, sample), 6) as gamma from g", "snvs"))
def component_subset(spark, sf):
    return co.subset_components(shares(spark, sf), [0, 1]).select("corpus", "sample", "component", F.round("gamma", 6).alias("gamma"))


@query("top_component", fx.sql(", g as (select corpus, sample, context % 3 as component, 1.0::double + sum(weight) as gamma from snvs group by 1, 2, 3) select corpus, sample, max_by(component, gamma * 10 + component) as component, round(max(gamma) / sum(gamma), 6) as share from g group by 1, 2", "snvs"))
def top_component(spark, sf):
    return co.top_component(shares(spark, sf)).select("corpus", "sample", "component", F.round("share", 6).alias("share"))


CENTRES = "with u as (select label, vec_id % 2 as half, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, half, i, avg(v) as v from u group by 1, 2, 3), c as (select label, half, list(v order by i) as vector from m group by 1, 2)"


def vectors(spark, sf):
    """The labels' mean vectors over even ids, and over odd ones."""
    e = fx.read(spark, sf, "embeddings").select("label", (F.col("vec_id") % 2).alias("half"), F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "half", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    c = m.groupBy("label", "half").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector"))
    return c.where("half = 0").selectExpr("label AS truth_id", "vector"), c.where("half = 1").selectExpr("label AS found_id", "vector")


@query("cosine_best_match", CENTRES + " select t.label as truth_id, round(max(list_cosine_similarity(t.vector, f.vector)), 6) as best from c t, c f where t.half = 0 and f.half = 1 group by t.label")
def cosine_best_match(spark, sf):
    return rt.best_matches(*vectors(spark, sf)).withColumn("best", F.round("best", 6))


@query("l1_best_match", CENTRES + " select t.label as truth_id, round(min(list_sum(list_transform(list_zip(t.vector, f.vector), lambda x: abs(x[1] - x[2])))), 6) as best from c t, c f where t.half = 0 and f.half = 1 group by t.label")
def l1_best_match(spark, sf):
    return rt.best_matches(*vectors(spark, sf), measure="l1").withColumn("best", F.round("best", 6))


TRIALS = "trials as (select p_partkey as trial, case when p_size % 9 = 0 then 'failed' else 'complete' end as state, p_retailprice as value from part)"


def trials(spark, sf):
    return fx.read(spark, sf, "part").selectExpr("p_partkey AS trial", "CASE WHEN p_size % 9 = 0 THEN 'failed' ELSE 'complete' END AS state", "p_retailprice AS value")


@query("best_trial", f"with {TRIALS} select trial, value from trials where state = 'complete' order by value, trial limit 1")
def best_trial(spark, sf):
    from ..model.tuning import best

    return best(trials(spark, sf)).select("trial", "value")


@query("no_improvement_stop", f"with {TRIALS.replace('p_retailprice as value', 'p_retailprice as value, p_brand as study')}, b as (select study, trial, min(value) over (partition by study order by trial rows between unbounded preceding and 5 preceding) as early, min(value) over (partition by study order by trial rows between 4 preceding and current row) as late from trials) select study, trial, coalesce(late >= early, false) as stop from b")
def no_improvement_stop(spark, sf):
    from ..model.tuning import stalled

    history = fx.read(spark, sf, "part").selectExpr("p_brand AS study", "p_partkey AS trial", "p_retailprice AS value")
    return stalled(history, "trial", "value", 5, ["study"])
