"""The bigWig source against the rows that its files were made of, and against the same signal as bedGraph."""

import random

import bigwig_file
import pytest

from regionlytics.operators import intervals as iv
from regionlytics.sources import bigwig, text


def signal(r, sizes, per_block):
    """Blocks of all kinds by place, with values that four bytes hold."""
    blocks = []
    for c in sorted(sizes):
        at = r.randrange(50)
        while at < sizes[c] - 2000:
            kind, n, span = r.choice([1, 2, 3]), r.randint(1, per_block), r.randint(1, 20)
            step, rows = span + r.randrange(10), []
            for _ in range(n):
                end = at + (r.randint(1, 40) if kind == 1 else span)
                rows.append((at, end, r.randrange(-64, 640) / 8))
                at = at + step if kind == 3 else end + r.choice([0, 0, r.randrange(30)])
            blocks.append((c, kind, step, span, rows))
            at = max(at, rows[-1][1]) + r.choice([0, r.randrange(200)])
    return blocks


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("bigwig")
    r = random.Random(7)
    sizes = {"chr1": 60_000, "chr10": 9_000, "chr2": 30_000, "chrX_long_name": 5_000, "empty": 10}
    blocks = signal(r, sizes, 40)
    rows = sorted((c, *x) for c, _, _, _, xs in blocks for x in xs)
    for name, how in {"little": {}, "big": {"order": ">"}, "plain": {"packed": False, "fan": 7}}.items():
        bigwig_file.write(d / f"{name}.bw", sizes, blocks, **how)
    (d / "same.bedgraph").write_text("".join("\t".join(map(str, x)) + "\n" for x in rows))
    bigwig_file.write(d / "none.bw", sizes, [])
    return d, rows, sizes


@pytest.mark.parametrize("name", ["little", "big", "plain"])
@pytest.mark.parametrize("tasks", [1, 3, 100])
def test_rows_of_all_kinds_of_blocks(spark, files, name, tasks):
    d, rows, _ = files
    got = bigwig.read_bigwig(spark, f"{d}/{name}.bw", tasks)
    assert sorted(map(tuple, got.collect())) == rows
    assert got.rdd.getNumPartitions() <= tasks


def test_files_by_uri_several_and_without_values(spark, files):
    d, rows, _ = files
    assert bigwig.read_bigwig(spark, [f"file://{d}/little.bw", f"{d}/big.bw"]).count() == 2 * len(rows)
    assert bigwig.read_bigwig(spark, f"{d}/none.bw").count() == 0
    assert bigwig.is_bigwig(f"{d}/big.bw") and not bigwig.is_bigwig(f"{d}/same.bedgraph") and not bigwig.is_bigwig(f"{d}/absent")
    with pytest.raises(Exception, match="not a bigWig file"):
        bigwig.read_bigwig(spark, f"{d}/same.bedgraph").count()


CONDITIONS = ["chrom = 'chr2'", "chrom in ('chr10', 'chrX_long_name', 'none')", "chrom = 'chr1' and start >= 20000 and end < 21000", "start > 100 and start <= 130", "end = 500", "chrom = 'chr1' and value > 3", "chrom = 'absent'", "chrom > 'chr1' and end <= 4000", "chrom = 'chr1' and chrom = 'chr2'", "start < 0"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_conditions_are_pushed_and_keep_the_same_rows(spark, files, condition):
    d, rows, _ = files
    want = spark.createDataFrame(rows, bigwig.SCHEMA).where(condition)
    assert sorted(bigwig.read_bigwig(spark, f"{d}/little.bw", 5).where(condition).collect()) == sorted(want.collect())


def test_conditions_rule_blocks_out(files):
    d, rows, _ = files
    reader = bigwig.BigWigReader([f"{d}/little.bw"], 4)
    left = list(reader.pushFilters([bigwig.ds.EqualTo(("chrom",), "chr1"), bigwig.ds.GreaterThanOrEqual(("start",), 20_000), bigwig.ds.LessThan(("end",), 21_000), bigwig.ds.GreaterThan(("value",), 3.0)]))
    assert left == [bigwig.ds.GreaterThan(("value",), 3.0)]
    read = []
    whole = bigwig.zlib.decompress
    bigwig.zlib.decompress = lambda x: read.append(1) or whole(x)
    try:
        got = [x for p in reader.partitions() for b in reader.read(p) for x in zip(*b.to_pydict().values(), strict=True)]
    finally:
        bigwig.zlib.decompress = whole
    assert sorted(got) == [x for x in rows if x[0] == "chr1" and x[1] >= 20_000 and x[2] < 21_000]
    assert len(read) < 8 < len(rows) / 40  # blocks of at most 40 rows


def test_mean_over_regions_as_from_bedgraph(spark, files):
    d, _, sizes = files
    regions = spark.createDataFrame([(i, c, s, s + 700) for i, (c, s) in enumerate((c, s) for c in sizes for s in range(0, sizes[c], 900))], "locus long, chrom string, start long, end long")
    mean = lambda t: {x["locus"]: round(x["mean"], 9) for x in iv.mean_signal(regions, t, extend=30).collect()}
    got = mean(bigwig.read_bigwig(spark, f"{d}/little.bw"))
    assert len(set(got.values())) > 50 and got == mean(text.read_bedgraph(spark, f"{d}/same.bedgraph"))
