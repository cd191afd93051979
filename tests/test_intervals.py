"""Hand-computed cases of the interval algebra, and its invariants."""

import random

import pytest
from pyspark.sql import functions as F

from regionlytics.operators import clusters as cl
from regionlytics.operators import durable
from regionlytics.operators import intervals as iv
from regionlytics.operators import nearest as nr
from regionlytics.sources.validate import check_exposures, check_regions, out_of_order


def tracks(spark, rows):
    return spark.createDataFrame([("t", *r) for r in rows], "track string, chrom string, start long, end long, label string")


SMALL = [("chr1", 0, 10, "A"), ("chr1", 10, 20, "A"), ("chr1", 5, 15, "B"), ("chr1", 30, 33, "C")]


def test_overlay_drops_slivers(spark):
    assert nr.overlay(tracks(spark, SMALL)).count() == 0
    big = tracks(spark, [(c, s * 10, e * 10, x) for c, s, e, x in SMALL])
    got = {(r["start"], r["end"], tuple(r["labels"])) for r in nr.overlay(big, stretch=64).collect()}
    assert got == {(0, 50, ("t:A",)), (50, 100, ("t:A", "t:B")), (100, 150, ("t:A", "t:B")), (150, 200, ("t:A",)), (300, 330, ("t:C",))}


def test_depth_times_length_is_total_length(spark):
    r = random.Random(1)
    rows = [(f"chr{r.randint(1, 3)}", s := r.randint(0, 5000), s + r.randint(1, 300), "x") for _ in range(300)]
    for stretch in (100, 1 << 20):
        d = nr.depth_segments(tracks(spark, rows), stretch).agg(F.sum((F.col("end") - F.col("start")) * F.col("depth"))).first()[0]
        assert d == sum(e - s for _, s, e, _ in rows)


def lengths(r, longest):
    return r.choice([0, 1, r.randint(0, 40), int(longest ** r.random()), longest])


@pytest.mark.parametrize(("size", "longest"), [(1, 40), (7, 40), (1024, 40), (1, 300), (4, 5000), (1024, 60_000)])
def test_overlap_join_against_brute_force(spark, size, longest):
    r = random.Random(2)
    make = lambda n: [(i, f"chr{r.randint(1, 2)}", s := r.randint(0, 6 * longest), s + lengths(r, longest)) for i in range(n)]
    a, b = make(70), make(60)
    schema = "id int, chrom string, start long, end long"
    got = iv.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), size)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
    assert sorted((r["id"], r["b_id"]) for r in got.collect()) == want
    none = spark.createDataFrame([(1, "chr1", None, 5), (2, None, 1, 5), (3, "chr1", 5, 5)], schema)
    assert iv.overlap_join(spark.createDataFrame(a, schema), none, size).count() == iv.overlap_join(none, spark.createDataFrame(b, schema), size).count() == 0


@pytest.mark.parametrize("longest", [40, 5000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_point_join_against_brute_force(spark, how, longest):
    r = random.Random(3)
    spans = [(i, f"chr{r.randint(1, 2)}", s := r.randint(0, 6 * longest), s + lengths(r, longest)) for i in range(15)]
    points = [(i, f"chr{r.randint(1, 3)}", r.randint(0, 7 * longest)) for i in range(150)] + [(150, "chr1", None), (151, None, 3)]
    p = spark.createDataFrame(points, "k int, chrom string, pos long")
    for held in (spans, []):
        hits = [(x[0], y[0]) for x in points for y in held if x[2] is not None and x[1] == y[1] and y[2] <= x[2] < y[3]]
        hit = {k for k, _ in hits}
        want = {"inner": hits, "left": hits + [(x[0], None) for x in points if x[0] not in hit], "left_semi": [(k,) for k in hit], "left_anti": [(x[0],) for x in points if x[0] not in hit]}[how]
        got = iv.point_join(p, spark.createDataFrame(held, "i int, chrom string, start long, end long"), 16, how)
        assert got.columns == ["k", "chrom", "pos"] + ["i", "start", "end"] * (how in ("inner", "left"))
        assert sorted((tuple(x[c] for c in ("k", "i") if c in got.columns) for x in got.collect()), key=repr) == sorted(want, key=repr)


def test_long_intervals_are_stored_a_few_times(spark, monkeypatch):
    """Rows after the deal grow with the rows, not with the lengths: a chromosome of 250 Mb was 244,000 rows in bins of one size."""
    seen = []
    placed = iv._placed
    monkeypatch.setattr(iv, "_placed", lambda *x: seen.append(placed(*x)) or seen[-1])
    whole = spark.createDataFrame([(i, "chr1", i, 250_000_000 + i) for i in range(5)], "id int, chrom string, start long, end long")
    short = spark.range(20_000).selectExpr("CAST(id AS INT) AS id", "'chr1' AS chrom", "id * 12000 AS start", "id * 12000 + 10 AS end")
    got = iv.overlap_join(short, whole)
    assert got.count() == 5 * 20_000
    assert seen[0].count() == 20_000 and seen[1].count() <= 5 * 2 * iv.PARTS
    # all short ones look into one bin of their chromosome, but in its parts
    spread = seen[0].groupBy("_slot").count().agg(F.max("count")).first()[0]
    assert spread < 2 * 20_000 / iv.PARTS  # one bin or two


def test_nearest_before_and_after(spark):
    regions = spark.createDataFrame([(0, "chr1", 100, 200), (1, "chr1", 300, 400), (2, "chr2", 5, 9)], "locus long, chrom string, start long, end long")
    feats = spark.createDataFrame([("chr1", 50, 100), ("chr1", 350, 360), ("chr1", 500, 510)], "chrom string, start long, end long")
    for stretch in (8, 1 << 20):
        got = {r["locus"]: (r["upstream"], r["downstream"]) for r in nr.nearest_before_after(regions, feats, stretch=stretch).collect()}
        assert got == {0: (1, 151), 1: (0, 0), 2: (None, None)}


def test_nearest_tie_is_upstream_unless_all(spark):
    p = spark.createDataFrame([("s", "chr1", x) for x in (0, 10, 20)], "sample string, chrom string, pos long")
    one = {r["pos"]: r["neighbour"] for r in nr.nearest_self(p, ["sample", "chrom"]).collect()}
    assert one == {0: 10, 10: 0, 20: 10}
    assert nr.nearest_self(p, ["sample", "chrom"], ties="all").where("pos = 10").count() == 2


def test_clusters_break_on_gap_and_chromosome(spark):
    rows = [("s", "chr1", 10), ("s", "chr1", 12), ("s", "chr1", 5000), ("s", "chr1", 5003), ("s", "chr2", 5003)]
    d = spark.createDataFrame(rows, "sample string, chrom string, pos long").withColumn("rate", F.lit(1e-3))
    got = {(r["chrom"], r["pos"]): (r["cluster"], r["cluster_size"]) for r in cl.clusters(d).collect()}
    assert got == {("chr1", 10): ("chr1_1", 2), ("chr1", 12): ("chr1_1", 2), ("chr1", 5000): ("chr1_2", 2), ("chr1", 5003): ("chr1_2", 2), ("chr2", 5003): ("chr2_1", 1)}
    assert cl.drop_clustered(cl.clusters(d), below=2).count() == 1


@pytest.mark.parametrize(("width", "stretch"), [(1, 4), (2, 4), (7, 3), (7, 16), (40, 8), (300, 10)])
def test_moving_average_in_stretches(spark, width, stretch):
    r = random.Random(width)
    values = [r.randint(0, 50) for _ in range(150)]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(7)
    for n in (150, 1, 0):
        got = cl.moving_average(d.where(F.col("i") < n), "v", ["i"], width, stretch=stretch)
        want = [sum(values[max(0, i - width // 2) : min(n, i + (width - 1) // 2 + 1)]) / width for i in range(n)]
        assert got.columns == ["i", "v", "smoothed"]
        assert [x["smoothed"] for x in sorted(got.collect())] == pytest.approx(want)
    assert "single" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_priority_must_hold_all_labels(spark):
    labels = spark.createDataFrame([(0, ["a", "b"]), (1, [])], "locus long, labels array<string>")
    got = {r["locus"]: r["label"] for r in iv.resolve_priority(labels, ["b", "a"]).collect()}
    assert got == {0: "b", 1: "None"}
    with pytest.raises(ValueError):
        iv.resolve_priority(labels, ["a"])


def test_numbered_is_dense_and_ordered(spark):
    rows = [(i * 7919 % 1000,) for i in range(1000)]
    got = durable.numbered(spark.createDataFrame(rows, "v int"), "v").collect()
    assert all(r["ordinal"] == r["v"] for r in got)


def test_validation(spark):
    good = spark.createDataFrame([(0, "chr1", 0, 5), (1, "chr1", 5, 9)], "locus long, chrom string, start long, end long")
    assert check_regions(good, "locus") is good
    with pytest.raises(ValueError):
        check_regions(good.where("locus = 1"))
    with pytest.raises(ValueError):
        check_regions(good.withColumn("start", -F.col("start")), "locus")
    exposures = spark.createDataFrame([(0, 1.0), (1, -1.0)], "locus long, exposure double")
    with pytest.raises(ValueError):
        check_exposures(exposures, 2)
    assert out_of_order(good, "locus", ["chrom", "start"], stretch=1).first()["out_of_order"] == 0


def test_reference_base_must_match(spark):
    seqs = cl.sequence_chunks(spark.createDataFrame([("chr1", "ACGTACGTAC")], "chrom string, seq string"), 4)
    good = spark.createDataFrame([("chr1", p, "ACGTACGTAC"[p]) for p in range(10)], "chrom string, pos long, ref string")
    got = {r["pos"]: r["context"] for r in cl.reference_check(good, seqs, 4).collect()}
    assert got == {p: "ACGTACGTAC"[p - 1 : p + 2] for p in range(1, 9)}
    with pytest.raises(Exception, match="reference base differs"):
        cl.reference_check(good.withColumn("ref", F.lit("A")), seqs, 4).collect()
    with pytest.raises(Exception, match="no sequence"):
        cl.reference_check(good.withColumn("chrom", F.lit("chr9")), seqs, 4).collect()
