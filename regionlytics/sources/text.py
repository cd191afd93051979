"""Readers and writers of the text formats: chromosome sizes, BED, BED12, bedGraph, VCF, FASTA, feature and exposure files.

Lines are read by Spark from any file system that it knows. Where a format's meaning depends on
the order of lines, the lines' places are made explicit on reading, as ``ordinal``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import numbered
from .validate import require_columns


def _error(message: Column | str) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def _rows(spark: SparkSession, path: str | list[str], comment: str | None = "#") -> DataFrame:
    """(c, line): the fields of every line that is neither empty nor a comment."""
    t = spark.read.text(path).where("trim(value) <> ''")
    if comment:
        t = t.where(~F.col("value").startswith(comment))
    return t.select(F.split("value", "\t").alias("c"), F.col("value").alias("line"))


def _field(i: int, kind: str | None = None) -> Column:
    c = F.get("c", F.lit(i))
    return c.cast(kind) if kind else c


def _whole(i: int, what: str) -> Column:
    """Field i as a whole number; anything else is an error that names the line."""
    v = F.expr(f"try_cast(get(c, {i}) AS BIGINT)")
    return F.when(v.isNotNull(), v).otherwise(_error(F.concat(F.lit(f"no {what} in: "), F.col("line"))).cast("long"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ordinal, value): lines in the order of the file, from 0.

    Spark splits files at byte ranges and reads each range in order, so file, then offset of the
    range, then the place within it give a line's place.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return numbered(t, "_f", "_b", "_i").select("ordinal", "value")


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length)."""
    return _rows(spark, path).select(_field(0).alias("chrom"), _field(1, "long").alias("length"))


def read_bed(spark: SparkSession, path: str, label_column: int = 4, track: str | None = None) -> DataFrame:
    """(track, chrom, start, end, label): BED of three or more columns; the label defaults to ``1``."""
    r = _rows(spark, path)
    chrom = F.when(F.size("c") >= 3, _field(0)).otherwise(_error(F.concat(F.lit("fewer than three columns in: "), F.col("line"))).cast("string"))
    name = track or path.rstrip("/").rsplit("/", 1)[-1]
    return r.select(F.lit(name).alias("track"), chrom.alias("chrom"), _whole(1, "start").alias("start"), _whole(2, "end").alias("end"), F.coalesce(_field(label_column - 1), F.lit("1")).alias("label"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, value)."""
    return _rows(spark, path).where(~F.col("line").rlike("^(track|browser) ?")).select(_field(0).alias("chrom"), _whole(1, "start").alias("start"), _whole(2, "end").alias("end"), _field(3, "double").alias("value"))


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """(locus, chrom, start, end, score, strand, block_sizes, block_starts); comments are left out, other lines need 12 fields."""
    r = _rows(spark, path)
    locus = F.when(F.size("c") >= 12, _whole(3, "whole-number name")).otherwise(_error(F.concat(F.lit("fewer than twelve columns in: "), F.col("line"))).cast("long"))
    numbers = lambda i: F.transform(F.filter(F.split(_field(i), ","), lambda x: x != ""), lambda x: x.cast("int"))
    return r.select(locus.alias("locus"), _field(0).alias("chrom"), _whole(1, "start").alias("start"), _whole(2, "end").alias("end"), _field(4, "double").alias("score"), _field(5).alias("strand"), numbers(10).alias("block_sizes"), numbers(11).alias("block_starts"))


def write_bed12(regions: DataFrame, path: str) -> None:
    """Regions by locus; in one file per range of loci, in order."""
    join = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    cols = ["chrom", "start", "end", "locus", F.coalesce(F.col("score") if "score" in regions.columns else F.lit(None).cast("double"), F.lit(0.0)).cast("string"), F.lit("+"), "start", "end", F.lit("0,0,0"), F.size("block_sizes").cast("string"), join("block_sizes"), join("block_starts")]
    text = F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    regions.orderBy("locus").select(text.alias("value")).write.mode("overwrite").text(path)


def write_bedgraph(track: DataFrame, path: str) -> None:
    """(chrom, start, end, value) by place."""
    track.orderBy("chrom", "start").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.col("value").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_vcf(spark: SparkSession, path: str | list[str], chr_prefix: str = "", weight_field: str | None = None, sample: str | None = None, passed_only: bool = True, expression: str | None = None) -> DataFrame:
    """(sample, chrom, pos, ref, alt, filter, weight, dp, ad, info): single-base substitutions, pos from 0.

    weight is the INFO field of that name, else 1. sample picks the column of a file with several;
    without it the first is taken, and the file's name stands for the sample if there is none.
    expression is a SQL condition on the result.
    """
    t = spark.read.text(path).withColumn("_file", F.col("_metadata.file_name"))
    head = t.where("value LIKE '#CHROM%'").select("_file", F.split("value", "\t").alias("_h"))
    r = t.where("value <> '' AND NOT value LIKE '#%'").select("_file", F.split("value", "\t").alias("c")).join(F.broadcast(head), "_file", "left")  # a header per file
    at = F.array_position("_h", sample) - 1 if sample else F.lit(9)
    at = F.when(at >= 9, at).otherwise(_error(f"no sample {sample}").cast("int") if sample else F.lit(9)) if sample else at
    call = F.split(F.get("c", at.cast("int")), ":")
    key = lambda k: F.get(call, (F.array_position(F.split(_field(8), ":"), k) - 1).cast("int"))
    info = lambda k: F.regexp_extract(_field(7), rf"(?:^|;){k}=([^;]*)", 1)
    weight = F.coalesce(F.expr("try_cast(_w AS DOUBLE)"), F.lit(1.0))
    out = r.withColumn("_w", info(weight_field) if weight_field else F.lit(None).cast("string")).select(
        F.coalesce(F.lit(sample), F.get("_h", F.lit(9)), F.regexp_replace("_file", r"\.vcf$", "")).alias("sample"), F.concat(F.lit(chr_prefix), _field(0)).alias("chrom"),
        (_field(1, "long") - 1).alias("pos"), _field(3).alias("ref"), _field(4).alias("alt"), _field(6).alias("filter"), weight.alias("weight"),
        key("DP").cast("int").alias("dp"), F.get(F.split(key("AD"), ","), F.lit(1)).cast("int").alias("ad"), _field(7).alias("info"),
    )
    out = out.where((F.length("ref") == 1) & (F.length("alt") == 1) & F.upper("ref").isin(*"ACGT") & F.upper("alt").isin(*"ACGT"))
    if passed_only:
        out = out.where("filter = 'PASS'")
    return out.where(F.expr(expression)) if expression else out


def annotate_vcf(spark: SparkSession, source: str, annotations: DataFrame, path: str, chr_prefix: str = "", descriptions: dict[str, str] | None = None) -> None:
    """Writes the VCF at source with the annotations' columns (chrom, pos from 0, ...) as INFO fields of lines at that place."""
    kinds = {"string": "String", "int": "Integer", "bigint": "Integer"}
    names = [c for c in annotations.columns if c not in ("chrom", "pos", "sample", "corpus")]
    lines = numbered_lines(spark, source)
    body = lines.where("NOT value LIKE '#%'").withColumn("c", F.split("value", "\t"))
    own = annotations.groupBy("chrom", "pos").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    fields = F.concat_ws(";", *[F.when(F.col(f"`{n}`").isNotNull(), F.concat(F.lit(f"{n}="), F.col(f"`{n}`").cast("string"))) for n in names])
    own = own.select((F.substring("chrom", len(chr_prefix) + 1, 1 << 20) if chr_prefix else F.col("chrom")).alias("_c"), (F.col("pos") + 1).alias("_p"), fields.alias("_info"))
    hit = body.join(own, (F.get("c", F.lit(0)) == F.col("_c")) & (F.get("c", F.lit(1)).cast("long") == F.col("_p")), "left")
    info = F.when(F.coalesce("_info", F.lit("")) == "", F.get("c", F.lit(7))).when(F.get("c", F.lit(7)) == ".", F.col("_info")).otherwise(F.concat_ws(";", F.get("c", F.lit(7)), "_info"))
    written = F.concat_ws("\t", F.transform("c", lambda x, i: F.when(i == 7, info).otherwise(x)))
    head = lines.where("value LIKE '##%'").select("ordinal", F.lit(0).alias("k"), "value")
    columns = lines.where("value LIKE '#CHROM%'").select("ordinal", F.lit(2).alias("k"), "value")
    new = [(i, 1, f'##INFO=<ID={n},Number=1,Type={kinds.get(annotations.schema[n].dataType.simpleString(), "Float")},Description="{(descriptions or {}).get(n, n)}">') for i, n in enumerate(names)]
    made = spark.createDataFrame(new, "ordinal long, k int, value string") if new else head.limit(0)
    out = head.unionByName(made).unionByName(columns).unionByName(hit.select("ordinal", F.lit(3).alias("k"), written.alias("value")))
    out.orderBy("k", "ordinal").select("value").write.mode("overwrite").text(path)


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """(chrom, chunk_id, start, seq): chunks that overlap the next by two bases, for operators.clusters.reference_check.

    Lines keep their own offsets within a sequence, so a chromosome is never one row.
    """
    from pyspark.sql import Window as W

    lines = numbered_lines(spark, path).where("value <> ''").withColumn("_stretch", F.floor(F.col("ordinal") / 65536))
    lines = lines.withColumns({"_head": F.when(F.col("value").startswith(">"), F.col("ordinal")), "_size": F.when(F.col("value").startswith(">"), 0).otherwise(F.length(F.trim("value")))})
    whole = lines.groupBy("_stretch").agg(F.max("_head").alias("_last"), F.sum("_size").alias("_sum"))
    w = W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)  # a row per 65,536 lines
    whole = whole.select("_stretch", F.max("_last").over(w).alias("_before"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inner = W.partitionBy("_stretch").orderBy("ordinal")
    placed = lines.join(whole, "_stretch").withColumns({
        "_seq": F.coalesce(F.max("_head").over(inner.rowsBetween(W.unboundedPreceding, 0)), F.col("_before")),
        "_at": F.col("_base") + F.coalesce(F.sum("_size").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    })
    names = placed.where("_head IS NOT NULL").select(F.col("ordinal").alias("_seq"), F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("chrom"), F.col("_at").alias("_zero"))
    body = placed.where("_head IS NULL").join(names, "_seq").select("chrom", (F.col("_at") - F.col("_zero")).alias("at"), F.trim("value").alias("s"))
    # a line goes to each chunk that it touches, the two bases of overlap included
    first, last = F.floor(F.greatest(F.col("at") - 2, F.lit(0)) / chunk), F.floor((F.col("at") + F.length("s") - 1) / chunk)
    parts = body.withColumn("chunk_id", F.explode(F.sequence(first, last))).withColumn("start", F.col("chunk_id") * chunk)
    lo, hi = F.greatest(F.col("start") - F.col("at"), F.lit(0)), F.least(F.col("start") + chunk + 2 - F.col("at"), F.length("s"))
    parts = parts.withColumn("piece", F.substring(F.col("s"), (lo + 1).cast("int"), (hi - lo).cast("int"))).where(hi > lo)
    g = parts.groupBy("chrom", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("_p"), F.min("start").alias("start"))
    return g.select("chrom", "chunk_id", "start", F.concat_ws("", F.transform("_p", lambda p: p["piece"])).alias("seq"))


def read_features(spark: SparkSession, path: str, required: list[str] | None = None) -> tuple[DataFrame, dict[str, str], dict[str, list[str]]]:
    """(locus, one column per feature), types by feature and groups by feature.

    Three lines head the file: #feature=, #type= and #group=, per column. Categorical columns are text,
    others numbers, ``.`` is missing: NaN, or ``nan`` in text. Rows are loci in order; a row of another width is an error.
    """
    head = [r["value"].split("\t") for r in spark.read.text(path).limit(3).collect()]
    if len(head) < 3 or not all(all(x.startswith(k) for x in row) for k, row in zip(("#feature=", "#type=", "#group="), head, strict=True)):
        raise ValueError("a feature file starts with lines of #feature=, #type= and #group=")
    names, types, groups = ([x.split("=", 1)[1] for x in row] for row in head)
    if len(set(names)) != len(names) or not len(names) == len(types) == len(groups):
        raise ValueError("a feature file names each feature once, with a type and a group")
    lines = numbered_lines(spark, path).where("ordinal >= 3 AND value <> ''").select((F.col("ordinal") - 3).alias("locus"), F.split("value", "\t").alias("c"), F.col("value").alias("line"))
    checked = F.when(F.size("c") == len(names), F.col("c")).otherwise(_error(F.concat(F.lit(f"not {len(names)} columns in: "), F.col("line"))).cast("array<string>"))
    lines = lines.withColumn("c", checked)

    def column(i: int) -> Column:
        meta = {"ftype": types[i], "group": groups[i].split(",")}
        v = _field(i)
        if types[i] == "categorical":
            return F.when(v == ".", F.lit("nan")).otherwise(v).alias(names[i], metadata=meta)
        number = F.expr(f"try_cast(get(c, {i}) AS DOUBLE)")
        bad = _error(F.concat(F.lit("no number in: "), F.col("line"))).cast("double")
        return F.when(v == ".", F.lit(float("nan"))).when(number.isNotNull(), number).otherwise(bad).alias(names[i], metadata=meta)

    df = lines.select("locus", *[column(i) for i in range(len(names))])
    return require_columns(df, required or []), dict(zip(names, types, strict=True)), {n: g.split(",") for n, g in zip(names, groups, strict=True)}


def write_feature(values: DataFrame, columns: dict[str, tuple[str, str]], path: str) -> None:
    """(locus, columns...) as a feature file; columns gives type and group per feature. NaN and null become ``.``."""
    names = list(columns)
    heads = ["\t".join(f"#feature={n}" for n in names), "\t".join(f"#type={columns[n][0]}" for n in names), "\t".join(f"#group={columns[n][1]}" for n in names)]
    cell = lambda n: F.when(F.col(f"`{n}`").isNull() | (F.col(f"`{n}`").cast("string") == "NaN"), F.lit(".")).otherwise(F.col(f"`{n}`").cast("string"))
    spark = values.sparkSession
    top = spark.createDataFrame([(i - 3, h) for i, h in enumerate(heads)], "locus long, value string")
    body = values.select(F.col("locus").cast("long").alias("locus"), F.concat_ws("\t", *[cell(n) for n in names]).alias("value"))
    top.unionByName(body).orderBy("locus").select("value").write.mode("overwrite").text(path)


def read_exposures(spark: SparkSession, path: str) -> DataFrame:
    """(locus, exposure): one number per line, in the order of loci."""
    lines = numbered_lines(spark, path).where("value <> '' AND NOT value LIKE '#%'")
    n = numbered(lines, "ordinal", name="locus")
    v = F.expr("try_cast(trim(value) AS DOUBLE)")
    return n.select("locus", F.when(v.isNotNull(), v).otherwise(_error(F.concat(F.lit("no number in: "), F.col("value"))).cast("double")).alias("exposure"))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(signature, label, p) from a JSON map of maps."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
    return t.select(F.explode("m").alias("signature", "s")).select("signature", F.explode("s").alias("label", "p"))
