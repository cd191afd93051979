"""The commands one after another, from text files to an annotated VCF."""

import json
import random

import bigwig_file
import pytest

from regionlytics import cli
from regionlytics.model import core, trainer
from regionlytics.sources import store, text


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    r = random.Random(1)
    seqs = {c: "".join(r.choices("ACGT", k=20_000)) for c in ("chr1", "chr2")}
    (d / "g.fa").write_text("".join(f">{c}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for c, s in seqs.items()))
    (d / "sizes").write_text("".join(f"{c}\t{len(s)}\n" for c, s in seqs.items()))
    (d / "black.bed").write_text("chr1\t5000\t5500\n")
    (d / "genes.bed").write_text("".join(f"{c}\t{i}\t{i + 700}\t{r.choice('ab')}\n" for c in seqs for i in range(1000, 19_000, 3000)))
    (d / "signal.bedgraph").write_text("".join(f"{c}\t{i}\t{i + 500}\t{r.random():.3f}\n" for c in seqs for i in range(0, 20_000, 500)))
    for s in range(3):
        rows = []
        for c, seq in seqs.items():
            for p in sorted(r.sample(range(2, 19_990), 120)):
                alt = r.choice([b for b in "ACGT" if b != seq[p]])
                rows.append(f"{c[3:]}\t{p + 1}\t.\t{seq[p]}\t{alt}\t.\tPASS\t.\tGT\t0/1")
        (d / f"s{s}.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts" + f"{s}\n" + "\n".join(rows) + "\n")
    return d


def test_commands_are_all_there():
    assert len(cli.COMMANDS) == 27
    with pytest.raises(SystemExit):
        cli.main(["model-train"])


def test_files_to_model(spark, work, capsys, monkeypatch):
    d = str(work)
    run = lambda line: cli.main(line.format(d=d).split())
    vcfs = " ".join(f"{d}/s{i}.vcf" for i in range(3))
    run("get-regions --genome-file {d}/sizes --blacklist-file {d}/black.bed --window-size 1000 --categorical-features {d}/genes.bed --output {d}/regions")
    n = text.read_bed12(spark, f"{d}/regions").count()
    assert n > 40
    run("get-trinucs --fasta-file {d}/g.fa --regions-file {d}/regions --output {d}/tri")
    tri = spark.read.parquet(f"{d}/tri")
    assert tri.select("locus").distinct().count() == n
    run("ingest-bigwig {d}/signal.bedgraph --regions-file {d}/regions --feature-name sig --output {d}/f1 --normalization standardize")
    rows = [tuple(f(x) for f, x in zip((str, int, int, float), line.split(), strict=True)) for line in (work / "signal.bedgraph").read_text().splitlines()]
    bigwig_file.write(work / "signal.bw", {c: 20_000 for c in ("chr1", "chr2")}, [(c, 1, 0, 0, [x[1:] for x in rows if x[0] == c]) for c in ("chr1", "chr2")])
    run("ingest-bigwig {d}/signal.bw --regions-file {d}/regions --feature-name sig --output {d}/f1b --normalization standardize")
    as_read = lambda name: [round(x["sig"], 4) for x in text.read_features(spark, f"{d}/{name}")[0].orderBy("locus").collect()]
    assert as_read("f1") == as_read("f1b") and len(set(as_read("f1"))) > 20
    run("ingest-distance {d}/genes.bed --regions-file {d}/regions --feature-name gene --output {d}/f2")
    run("ingest-categorical {d}/genes.bed --regions-file {d}/regions --feature-name kind --output {d}/f3")
    got, types, _ = text.read_features(spark, f"{d}/f2")
    assert got.count() == n and types == {"gene_progress": "power", "gene_totalDistance": "power"}
    assert {r[0] for r in text.read_features(spark, f"{d}/f3")[0].select("kind").distinct().collect()} == {"a", "b", "None"}
    run(f"preprocess-estimate-mutrate --vcf-files {vcfs} --chr-prefix chr --regions-file {d}/regions --output {d}/rate")
    run("preprocess-cluster-mutations {d}/s0.vcf --mutation-rate-bedgraph {d}/rate --chr-prefix chr --output {d}/clustered")
    assert spark.read.text(f"{d}/clustered").where("value LIKE '%clusterSize=%' AND NOT value LIKE '##%'").count() > 100
    run(f"corpus-make --corpus-name c --vcf-files {vcfs} --chr-prefix chr --fasta-file {d}/g.fa --regions-file {d}/regions --correlates-file {d}/f1 --output {d}/c")
    run("corpus-split {d}/c --train-output {d}/train --test-output {d}/test --by-locus")
    run("corpus-empirical-mutation-rate {d}/c --output {d}/emp")
    run("model-train --n-components 2 --corpuses {d}/train --output {d}/m --num-epochs 2 --eval-every 2")
    capsys.readouterr()
    run("model-score {d}/m --corpuses {d}/test")
    assert json.loads(capsys.readouterr().out)["perplexity"] > 0
    run("model-predict {d}/m --corpuses {d}/c --output {d}/gamma")
    assert spark.read.option("header", True).csv(f"{d}/gamma").count() == 3
    run("model-save-signatures {d}/m --output {d}/sig")
    assert len(spark.read.option("header", True).csv(f"{d}/sig").columns) == 97
    run("model-plot-summary {d}/m --corpuses {d}/c --regions-file {d}/regions --bins 20 --smoothing 5 --output {d}/plots")
    table = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{d}/{name}")
    assert table("plots/rate_track").count() == 20 and table("plots/rate_matrix").count() == 40 and table("plots/signatures").count() == 192
    segments = text.read_bed12(spark, f"{d}/regions").selectExpr("sum(size(block_sizes)) AS n").first()["n"]
    assert table("plots/rates_by_segment").count() == segments and table("plots/rates_by_segment").columns[:3] == ["chrom", "start", "end"]
    run("corpus-empirical-mutation-rate {d}/c --model {d}/m --output {d}/by_component")
    laid = table("by_component").selectExpr("sum(component_0 + component_1) AS n").first()["n"]
    assert laid == pytest.approx(spark.read.parquet(f"{d}/c/mutations").selectExpr("sum(weight) AS n").first()["n"], rel=1e-6)
    run("model-train --n-components 1 --corpuses {d}/train --output {d}/marginal --model-type marginal")
    assert trainer.load(spark, f"{d}/marginal").state.rate_model.kind == "gbt"
    run("model-list-corpuses {d}/m")
    assert capsys.readouterr().out.strip() == "c"
    run("model-explain {d}/m --signature 0 --corpuses {d}/c --output {d}/shap")
    capsys.readouterr()
    run("model-score {d}/m --corpuses {d}/c")
    fresh = json.loads(capsys.readouterr().out)
    for said in ("cached", "unchanged"):
        run("model-cache-sstats {d}/m --corpus {d}/c")
        assert capsys.readouterr().out.strip() == said
    monkeypatch.setattr(core, "locus_table", None)  # what the cache holds isn't made again
    run("model-score {d}/m --corpuses {d}/c")
    assert json.loads(capsys.readouterr().out) == pytest.approx(fresh)
    monkeypatch.undo()
    # a corpus that was written anew isn't taken from the cache
    store.save_corpus(store.load_corpus(spark, f"{d}/c"), f"{d}/copy")
    assert store.folder_digest(spark, f"{d}/copy") != store.folder_digest(spark, f"{d}/c")
    assert cli._known_rates(spark, f"{d}/m", trainer.load(spark, f"{d}/m"), [f"{d}/copy"]) is None
    assert cli._known_rates(spark, f"{d}/m", trainer.load(spark, f"{d}/m"), [f"{d}/c"]) is not None
    run("model-annotate-mutations {d}/m --vcf-files {d}/s0.vcf --corpus {d}/c --output-prefix {d}/annotated_ --chr-prefix chr --iters 20")
    assert spark.read.text(f"{d}/annotated_s0.vcf").where("value LIKE '%logp_component_0=%'").count() > 100
    run("study-create --corpuses {d}/c --study-name st --max-components 2 --min-components 2 --storage {d}/studies --num-epochs 1")
    run("study-run-trial st --storage {d}/studies")
    run("study-summarize st --storage {d}/studies --output {d}/trials")
    run("study-retrain st --storage {d}/studies --output {d}/m2 --num-epochs 1")
    (work / "sim.json").write_text(json.dumps({"n_cells": 4, "n_loci": 20, "log_mean_mutations": 3}))
    run("simulate --config {d}/sim.json --prefix {d}/sim")
    run("model-train --n-components 2 --corpuses {d}/sim.corpus --output {d}/m3 --num-epochs 1")
    run("eval-sim {d}/m3 --simulation-params {d}/sim.truth")
    run("simulate-from-model {d}/m3 --corpus {d}/sim.corpus --output {d}/resampled --n-samples 2")
    assert "signature_cosine" in capsys.readouterr().out
    assert spark.read.parquet(f"{d}/resampled/mutations").select("sample").distinct().count() == 2
