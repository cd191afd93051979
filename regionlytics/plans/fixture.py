"""The driver's tables read as domain tables, in Spark and as SQL common table expressions.

The mapping uses whole-number arithmetic only, so that both engines hold the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpora import unpacked

COMPONENTS = 3
SPAN = 400_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS locus", "concat('chr', p_partkey % 5 + 1) AS chrom", "(p_partkey DIV 5) * 1000 AS start",
        "(p_partkey DIV 5) * 1000 + 1000 - (p_size % 7) * 10 AS end", "p_size", "p_retailprice", "p_type", "p_brand", "p_retailprice / 1000 AS exposure",
    )


def snvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS sample", "concat('c', l_suppkey % 2) AS corpus", "concat('chr', l_partkey % 5 + 1) AS chrom",
        "(l_partkey DIV 5) * 1000 + (l_orderkey * 13 + l_linenumber * 101) % 1000 AS pos", "l_partkey AS part",
        "CAST((l_orderkey * 7 + l_linenumber) % 64 AS INT) AS context", "CAST((l_orderkey + l_linenumber) % 3 AS INT) AS mutation",
        "l_quantity AS weight", "CASE WHEN l_returnflag = 'R' THEN 'LOWQ' ELSE 'PASS' END AS filter", "l_linestatus AS info",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('chr', user_id % 5 + 1) AS chrom", f"(event_id * 37) % {SPAN} AS start",
        f"(event_id * 37) % {SPAN} + 50 + event_id % 400 AS end", "event_type AS label", "value", "'events' AS track",
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("doc_id AS chrom", "upper(regexp_replace(text, '[^ACGTacgt]', 'N')) AS seq")


def trinucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(packed_trinucs(spark, sf_dir))


def packed_trinucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trinucs with an array of the 64 counts for each locus. Parts are dealt out first: their table is small, what is made of them isn't."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("locus")).repartition(n, "locus")
    return parts.selectExpr("locus", "transform(sequence(0, 63), c -> 1 + (locus * 31 + c * 17) % 23) AS n")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snvs with the locus of their part, wherever they lie in it."""
    return snvs(spark, sf_dir).withColumnRenamed("part", "locus")


def signatures(spark: SparkSession) -> DataFrame:
    """(component, context, mutation, omega): K x 64 x 3 small whole numbers."""
    k = spark.range(COMPONENTS * 192).selectExpr("CAST(id DIV 192 AS INT) AS component", "CAST((id % 192) DIV 3 AS INT) AS context", "CAST(id % 3 AS INT) AS mutation")
    return k.withColumn("omega", ((F.col("component") * 7 + F.col("context") * 3 + F.col("mutation") * 5) % 11 + 1).cast("double"))


def deltas(spark: SparkSession) -> DataFrame:
    """(component, context, delta)."""
    return signatures(spark).groupBy("component", "context").agg((F.sum("omega") / 100).alias("delta"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, locus, logmu)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(COMPONENTS - 1)))
    return loci(spark, sf_dir).select("locus", "p_size", k.alias("component")).selectExpr("locus", "component", "(p_size * (component + 1) % 13 - 6) / 10 AS logmu")


CTE = {
    "loci": "loci as (select p_partkey as locus, 'chr' || (p_partkey % 5 + 1) as chrom, (p_partkey // 5) * 1000 as s, (p_partkey // 5) * 1000 + 1000 - (p_size % 7) * 10 as e, p_size, p_retailprice, p_type, p_brand, p_retailprice / 1000 as exposure from part)",
    "snvs": "snvs as (select l_suppkey as sample, 'c' || (l_suppkey % 2) as corpus, 'chr' || (l_partkey % 5 + 1) as chrom, (l_partkey // 5) * 1000 + (l_orderkey * 13 + l_linenumber * 101) % 1000 as pos, l_partkey as locus, ((l_orderkey * 7 + l_linenumber) % 64)::int as context, ((l_orderkey + l_linenumber) % 3)::int as mutation, l_quantity as weight, case when l_returnflag = 'R' then 'LOWQ' else 'PASS' end as filter, l_linestatus as info from lineitem)",
    "tracks": f"tracks as (select event_id, 'chr' || (user_id % 5 + 1) as chrom, (event_id * 37) % {SPAN} as s, (event_id * 37) % {SPAN} + 50 + event_id % 400 as e, event_type as label, value from events)",
    "trinucs": "trinucs as (select p_partkey as locus, c.range::int as context, 1 + (p_partkey * 31 + c.range * 17) % 23 as n from part, range(64) c)",
    "signatures": f"signatures as (select (i.range // 192)::int as component, ((i.range % 192) // 3)::int as context, (i.range % 3)::int as mutation, (((i.range // 192) * 7 + ((i.range % 192) // 3) * 3 + (i.range % 3) * 5) % 11 + 1)::double as omega from range({COMPONENTS * 192}) i)",
    "deltas": "deltas as (select component, context, sum(omega) / 100 as delta from signatures group by component, context)",
    "rates": f"rates as (select locus, k.range::int as component, (p_size * (k.range + 1) % 13 - 6) / 10 as logmu from loci, range({COMPONENTS}) k)",
}
NEEDS = {"deltas": ["signatures"], "rates": ["loci"]}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """body behind the expressions named and those that they need; body may go on with ``, x as (...)``."""
    wanted: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in wanted:
                wanted.append(m)
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(CTE[n] for n in wanted) + ("" if body.lstrip().startswith(",") else "\n") + body
