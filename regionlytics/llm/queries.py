"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of op1: hosts with paths, and what they say.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_join import range_join

    return range_join(table(spark, sf_dir, "embeddings"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    out = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import near_duplicate_lines

    out = near_duplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_kept", F.concat_ws(",", F.col("dropped_lines").cast("array<string>")).alias("dropped_lines"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    placed, pieces = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    out = placed.join(taken, "row", "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_name: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    from .pieces import ids_digest, round_trip

    path = public_tokenizers.path(model_name)
    out = round_trip(table(spark, sf_dir, "documents"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import lloyd, with_inertia

    return with_inertia(*lloyd(table(spark, sf_dir, "embeddings")))


def op12_token_counts(spark: SparkSession, sf_dir: str, model_name: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(model_name))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def with_planted_run(doc_id: int | None, words: list[str]) -> list[str]:
    """op13's words of a document: of one in ten, told by its id, the words from some place on repeat the first of them. A null id plants nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs

    out = periodic_runs(table(spark, sf_dir, "documents"), words_of=with_planted_run)
    # runs come by start, then period, so the first of the greatest stays
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_ngram_join": op2_ngram_join,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_html_extract": op4_html_extract,
        "op5_secret_scan": op5_secret_scan,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality": op7_quality,
        "op8_mixing": op8_mixing,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_centroids": op11_centroids,
        "op12_token_counts": op12_token_counts,
        "op13_periodic_runs": op13_periodic_runs,
    }


SQL = {
    "op2_ngram_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from g group by doc_id),
r as (select s from g group by s having count(*) > 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as i from g a join g b on a.s = b.s and a.doc_id < b.doc_id where a.s in (select s from r) group by 1, 2),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 85 * (p.n + q.n - i)),
d as (select x, y from e union select y, x from e),
reach(id, k) as (select doc_id, doc_id from documents union select reach.id, d.y from reach join d on d.x = reach.k)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.k as component_id
from documents left join n using (doc_id) join (select id, min(k) as k from reach group by id) m on m.id = doc_id
""",
    "op3_embedding_dedup": """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, k) as (select vec_id, vec_id from embeddings union select reach.id, l.y from reach join l on l.x = reach.k),
c as (select id, min(k) as k from reach group by id), n as (select x, count(*) as n from l group by x)
select vec_id, coalesce(n.n, 0)::bigint as n_links, c.k as component_id, vec_id = c.k as kept
from embeddings join c on c.id = vec_id left join n on n.x = vec_id
""",
    "op6_line_dedup": """
with recursive t as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as line_no from documents),
l as (select line, min(doc_id) as d from t where line <> '' group by line),
u as (select line, length(line) as n, row_number() over (order by line) as i from l),
p as (select a.i as x, b.i as y from u a join u b on a.n >= 20 and b.n >= a.n and b.n <= a.n + 2 and a.i <> b.i
  where (a.n > b.n or a.i < b.i or a.n < b.n) and abs(a.n - b.n) <= 2
  and (substr(a.line, 1, a.n // 3) = substr(b.line, 1, a.n // 3) or right(a.line, a.n // 3) = right(b.line, a.n // 3)
    or instr(b.line, substr(a.line, a.n // 3 + 1, a.n // 3)) > 0) and levenshtein(a.line, b.line) <= 2),
e as (select x, y from p union select y, x from p),
reach(i, k) as (select i, i from u union select reach.i, e.y from reach join e on e.x = reach.k),
c as (select i, min(k) as c from reach group by i),
o as (select t.doc_id, t.line_no, c.c, row_number() over (partition by c.c order by t.doc_id, t.line_no) as r from t join u on u.line = t.line join c on c.i = u.i),
g as (select doc_id, string_agg(line_no::varchar, ',' order by line_no) as s, count(*) as k from o where r > 1 group by doc_id)
select doc_id, len(string_split(coalesce(text, ''), chr(10)))::bigint as n_lines, (len(string_split(coalesce(text, ''), chr(10))) - coalesce(g.k, 0))::bigint as n_kept, coalesce(g.s, '') as dropped_lines
from documents left join g using (doc_id)
""",
    "op8_mixing": r"""
with s as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size from documents),
per as (select source, sum(size)::bigint as source_size from s group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as r from per),
w as (select *, case r % 3 when 0 then 5 when 1 then 2 else 1 end as w from ranked),
o as (select *, 1.5::double * (sum(source_size) over ())::double - 2.0::double * coalesce(sum(source_size) over (order by source_size / w, r rows between unbounded preceding and 1 preceding), 0)::double as lw,
  (sum(w) over ())::bigint - coalesce(sum(w) over (order by source_size / w, r rows between unbounded preceding and 1 preceding), 0)::bigint as lg from w),
c as (select *, lw * w >= 2.0::double * source_size * lg as capped from o),
l as (select lw, lg from c where not capped order by source_size / w, r limit 1),
t as (select c.source, c.source_size, case when capped then 2.0::double * source_size else l.lw * w / l.lg end as target from c left join l on true),
p as (select s.doc_id, s.size, t.source_size, t.target, least(round(t.target), 2 * t.source_size)::bigint as take,
  coalesce(sum(s.size) over (partition by t.source order by md5('mix:' || s.doc_id::varchar), s.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from s join t on s.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
  case when size = 0 then 0 else (take // source_size) * size + greatest(0, least(start + size, take % source_size) - start) end::bigint as taken from p
""",
    "op10_exact_dedup": """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d
""",
}


def _lloyd_sql(rounds: int = 3) -> str:
    """Vectors by row and component against centroids, one round after the other."""
    far = lambda c: f"select v.r, c.k, sum((v.x - c.x) * (v.x - c.x))::bigint as d from u v join {c} c on c.j = v.j group by v.r, c.k"
    near = lambda c: f"select r, arg_min(k, (d, k)) as k, min(d) as d from ({far(c)}) group by r"
    out = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as materialized (select r, unnest(e) as x, generate_subscripts(e, 1) as j from v),
f as (select r, row_number() over (order by sha256('1:' || vec_id::varchar), e) - 1 as k from v qualify k < 16),
c0 as materialized (select f.k, u.j, u.x from f join u using (r))"""
    for i in range(rounds):
        out += f""",
a{i} as materialized ({near(f"c{i}")}),
m{i} as (select a.k, u.j, sum(u.x)::bigint as s, count(*) as n from a{i} a join u using (r) group by all),
c{i + 1} as materialized (select c.k, c.j, case when m.n is null then c.x else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as x from c{i} c left join m{i} m on m.k = c.k and m.j = c.j)"""
    return (
        out
        + f""",
a as materialized ({near(f"c{rounds}")}),
h as (select k, sha256(string_agg(x::varchar, ',' order by j)) as s from c{rounds} group by k)
select v.vec_id, a.k::int as cluster, a.d as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, h.s as centroid_sha256
from a join v using (r) join h using (k)
"""
    )


SQL["op11_centroids"] = _lloyd_sql()
SQL["op13_periodic_runs"] = r"""
with t as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as o, case when doc_id is null then 1 else xor(4294967295, list_reduce(
    flatten(list_transform(string_split(doc_id::varchar, ''), lambda d: [ascii(d)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, 4294967295::bigint)) end as h from documents),
g as (select *, len(o) as n, h // 10 as g, h % 10 = 0 and len(o) > 0 as planted from t),
s as (select *, case when planted then g % n else n end as a, case when planted then 1 + (n - g % n) // (3 + g % 8) else 1 end as p from g),
w as materialized (select s.r, i.i, o.w, s.n from (select r, unnest(range(n)) as i from s) i join s using (r)
  join (select r, unnest(o) as w, generate_subscripts(o, 1) - 1 as i from s) o on o.r = s.r and o.i = case when i.i >= a then a + (i.i - a) % p else i.i end),
e as (select x.r, x.i, y.i - x.i as q from w x join w y on x.r = y.r and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
b as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from e),
c as materialized (select r, q, min(i) as s, count(*) + q as l from b group by r, q, island having count(*) + q >= greatest(6, 4 * q)),
d as materialized (select * from c where not exists (select 1 from c k where k.r = c.r and k.q < c.q and k.s <= c.s and k.s + k.l >= c.s + c.l)),
z as (select w.r, string_agg(w.w, ' ' order by w.i) as z from w where not exists (select 1 from d where d.r = w.r and w.i >= d.s + d.q and w.i < d.s + d.l) group by w.r),
k as (select r, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as listed from d group by r),
m as (select * from d qualify row_number() over (partition by r order by l::double / q desc, s, q) = 1)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, m.s::bigint as start, m.l::bigint as length, m.q::bigint as period, (1000 * m.l // m.q)::bigint as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(z.z, '')) as collapsed_sha256
from t left join k using (r) left join m using (r) left join z using (r)
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
