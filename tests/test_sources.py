import pytest
from pyspark.sql import functions as F

from regionlytics.operators import clusters as cl
from regionlytics.operators import corpora as co
from regionlytics.sources import store, text


def write(path, s):
    path.write_text(s)
    return str(path)


def lines(spark, path):
    return [r["value"] for r in text.numbered_lines(spark, path).orderBy("ordinal").collect()]


def test_bed(spark, tmp_path):
    p = write(tmp_path / "a.bed", "# x\nchr1\t0\t10\nchr1\t5\t15\tB\n")
    assert [(r["start"], r["label"]) for r in text.read_bed(spark, p).orderBy("start").collect()] == [(0, "1"), (5, "B")]
    with pytest.raises(Exception, match="fewer than three"):
        text.read_bed(spark, write(tmp_path / "b.bed", "chr1\t0\n")).collect()


def test_bed12_round_trip(spark, tmp_path):
    rows = [(0, "chr1", 0, 100, [10, 20], [0, 80]), (1, "chr2", 5, 6, [1], [0])]
    d = spark.createDataFrame(rows, "locus long, chrom string, start long, end long, block_sizes array<int>, block_starts array<int>")
    text.write_bed12(d, str(tmp_path / "r"))
    got = text.read_bed12(spark, str(tmp_path / "r")).orderBy("locus").collect()
    assert [(r["locus"], r["chrom"], r["start"], r["end"], r["block_sizes"], r["block_starts"]) for r in got] == rows
    with pytest.raises(Exception, match="whole-number name"):
        text.read_bed12(spark, write(tmp_path / "x", "\t".join(["chr1", "0", "1", "n", "0", "+", "0", "1", "0", "1", "1", "0"]))).collect()


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
1\t11\t.\tC\tA\t.\tPASS\tW=2.5\tGT:DP:AD\t0/1:9:4,5\t0/1:8:4,4
1\t12\t.\tC\tAT\t.\tPASS\t.\tGT\t0/1\t0/1
1\t13\t.\tG\tT\t.\tq10\tW=x\tGT\t0/1\t0/1
"""


def test_vcf(spark, tmp_path):
    p = write(tmp_path / "a.vcf", VCF)
    r = text.read_vcf(spark, p, "chr", "W", "S2").collect()
    assert [(x["sample"], x["chrom"], x["pos"], x["ref"], x["alt"], x["weight"], x["dp"], x["ad"]) for x in r] == [("S2", "chr1", 10, "C", "A", 2.5, 8, 4)]
    assert [x["weight"] for x in text.read_vcf(spark, p, weight_field="W", passed_only=False).orderBy("pos").collect()] == [2.5, 1.0]
    assert text.read_vcf(spark, p, passed_only=False, expression="pos > 10").count() == 1
    notes = spark.createDataFrame([("chr1", 10, 3, "k")], "chrom string, pos long, clusterSize int, cluster string")
    text.annotate_vcf(spark, p, notes, str(tmp_path / "out"), "chr")
    got = lines(spark, str(tmp_path / "out"))
    assert len([x for x in got if x.startswith("##INFO")]) == 2 and got.index(VCF.split("\n")[1]) == 3
    assert [x.split("\t")[7] for x in got if not x.startswith("#")] == ["W=2.5;clusterSize=3;cluster=k", ".", "W=x"]


def test_fasta_chunks(spark, tmp_path):
    seq = "ACGTTGCAAC" * 7
    p = write(tmp_path / "a.fa", ">chr1 x\n" + "\n".join(seq[i : i + 9] for i in range(0, len(seq), 9)) + "\n>chr2\nGG\n")
    for chunk in (4, 16, 1000):
        got = {(r["chrom"], r["chunk_id"]): r["seq"] for r in text.read_fasta(spark, p, chunk).collect()}
        want = {("chr1", i // chunk): seq[i : i + chunk + 2] for i in range(0, len(seq), chunk)} | {("chr2", 0): "GG"}
        assert {k: v for k, v in got.items() if k in want} == want
    m = spark.createDataFrame([("chr1", i, seq[i]) for i in range(1, len(seq) - 1)], "chrom string, pos long, ref string")
    assert cl.reference_check(m, text.read_fasta(spark, p, 16), 16).count() == len(seq) - 2


FEATURES = "#feature=a\t#feature=c\n#type=power\t#type=categorical\n#group=all\t#group=replication,x\n1.5\tu\n.\t.\n"


def test_features(spark, tmp_path):
    d, types, groups = text.read_features(spark, write(tmp_path / "f", FEATURES), ["a"])
    rows = d.orderBy("locus").collect()
    assert rows[0]["a"] == 1.5 and rows[1]["a"] != rows[1]["a"] and rows[1]["c"] == "nan"
    assert types == {"a": "power", "c": "categorical"} and groups == {"a": ["all"], "c": ["replication", "x"]}
    with pytest.raises(ValueError):
        text.read_features(spark, write(tmp_path / "f", FEATURES), ["b"])
    with pytest.raises(Exception, match="columns in"):
        text.read_features(spark, write(tmp_path / "g", FEATURES + "1\n"))[0].collect()
    text.write_feature(d.select("locus", "a"), {"a": ("power", "all")}, str(tmp_path / "w"))
    assert lines(spark, str(tmp_path / "w")) == ["#feature=a", "#type=power", "#group=all", "1.5", "."]


def test_exposures_and_signatures(spark, tmp_path):
    assert [(r[0], r[1]) for r in text.read_exposures(spark, write(tmp_path / "e", "# x\n1\n0.5\n")).orderBy("locus").collect()] == [(0, 1.0), (1, 0.5)]
    assert text.read_signatures(spark, write(tmp_path / "s", '{"S1": {"A[C>A]A": 0.5}}')).collect()[0]["p"] == 0.5


def tiny(spark, name="c"):
    n = F.lit(name).alias("corpus")
    m = spark.createDataFrame([(s, "chr1", i, i % 4, i % 64, i % 3, 0, 1.0) for s in range(4) for i in range(20)], "sample long, chrom string, pos long, locus long, context int, mutation int, attribute int, weight double")
    loci = spark.range(4).withColumnRenamed("id", "locus")
    return co.Corpus(m.select(n, "*"), loci.select(n, "locus", F.lit(1.0).alias("exposure")), loci.crossJoin(spark.range(64).toDF("context")).select(n, "locus", F.col("context").cast("int"), F.lit(2).alias("n")), loci.select(n, "locus", (F.col("locus") * 1.0).alias("f")))


def test_corpus_store_and_subsets(spark, tmp_path):
    c = tiny(spark)
    store.save_corpus(c, str(tmp_path / "c"))
    back = store.load_corpus(spark, str(tmp_path / "c"))
    assert co.same_rows(back.mutations.select(c.mutations.columns), c.mutations) and back.shape() == c.shape()
    both = co.union([c, tiny(spark, "d")])
    assert both.names() == ["c", "d"] and both.shape()["samples"] == 8
    with pytest.raises(ValueError):
        co.union([c, c])
    a, b = co.split(c, 0.7)
    assert a.samples().count() == 2 and b.samples().count() == 2
    x, y = co.split(c, 0.5, by_locus=True)
    assert sorted(r[0] for r in x.loci.select("locus").collect()) == [0, 1] and x.mutations.count() + y.mutations.count() == 80
    made = []
    make = lambda: made.append(1) or c.loci
    for _ in range(2):
        assert store.cached_rates(spark, str(tmp_path / "cache"), "m", "c", make).count() == 4
    assert len(made) == 1
