"""Command line: ``python -m regionlytics.cli COMMAND ...``. Tables are folders of Parquet, models folders of JSON text."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.sequence import cosmic_order
from .functions.sequence import kmer_counts as _kmer_counts
from .model import extension, posterior, simulate, trainer, tuning
from .operators import clusters as cl
from .operators import corpora as co
from .operators import intervals as iv
from .operators import nearest as nr
from .operators import views
from .operators.scaling import FeatureTransform
from .sources import bigwig, store, text
from .sources.validate import check_exposures, check_regions


def session() -> SparkSession:
    return SparkSession.builder.appName("regionlytics").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _segments(spark, path: str):
    return iv.segments(check_regions(text.read_bed12(spark, path)))


def _save(df, path: str | None) -> None:
    """To path as CSV with a header, or printed."""
    if path:
        store.write_matrix(df, path)
    else:
        df.show(1000, truncate=False)


def estimate_mutrate(spark, a):
    points = text.read_vcf(spark, a.vcf_files, a.chr_prefix)
    text.write_bedgraph(cl.rate_track(text.read_bed12(spark, a.regions_file), points), a.output)


def clustered(spark, a, path):
    v = text.read_vcf(spark, path, a.chr_prefix, sample=a.sample)
    rated = cl.local_rate(v.select("sample", "chrom", "pos"), text.read_bedgraph(spark, a.mutation_rate_bedgraph))
    kinds = v.select("sample", "chrom", "pos", cl.mutation_type(F.col("ref"), F.col("alt")).alias("mutation_type")).dropDuplicates(["sample", "chrom", "pos"])
    return cl.clusters(rated.join(kinds, ["sample", "chrom", "pos"]))


def cluster_mutations(spark, a):
    c = clustered(spark, a, a.vcf_file)
    notes = c.select("chrom", "pos", F.col("mutation_type").alias("mutationType"), F.col("score").alias("negLog10interMutationDistanceRatio"), F.col("cluster_size").alias("clusterSize"), "cluster")
    text.annotate_vcf(spark, a.vcf_file, notes, a.output, a.chr_prefix)


def get_regions(spark, a):
    sizes = text.read_chrom_sizes(spark, a.genome_file)
    tracks = [nr.fixed_windows(sizes, a.window_size)]
    for spec in a.categorical_features:
        tracks.append(iv.allowed_chroms(text.read_bed(spark, spec), sizes).select("track", "chrom", "start", "end", "label"))
    black = text.read_bed(spark, a.blacklist_file)
    text.write_bed12(nr.make_regions(store.stack(tracks), black), a.output)


def trinucs(spark, a):
    """(locus, context, n) of the bases in the regions' blocks."""
    from .functions.sequence import context_index

    segs = _segments(spark, a.regions_file)
    chunk = 1 << 16
    seqs = text.read_fasta(spark, a.fasta_file, chunk)
    parts = segs.withColumn("chunk_id", F.explode(F.sequence(F.floor(F.greatest(F.col("start") - 1, F.lit(0)) / chunk), F.floor((F.col("end") - 1) / chunk)))).withColumnsRenamed({"start": "s", "end": "e"})
    j = parts.join(seqs, ["chrom", "chunk_id"])
    # three-mers centred in the block whose first base lies in this chunk
    lo = F.greatest(F.col("s") - 1, F.col("start"), F.lit(0))
    hi = F.least(F.col("e") + 1, F.col("start") + chunk + 2)
    cut = j.withColumn("piece", F.substring(F.col("seq"), (lo - F.col("start") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")))
    n = _kmer_counts(cut.select("locus", "piece"), "locus", "piece")
    n.select("locus", context_index(F.col("kmer")).cast("int").alias("context"), "n").write.mode("overwrite").parquet(a.output)


def ingest_bigwig(spark, a):
    """The mean of a bigWig file's signal over each region; a bedGraph file is taken as well."""
    segs = _segments(spark, a.regions_file)
    if bigwig.is_bigwig(a.bigwig_file):
        chroms = [r[0] for r in segs.select("chrom").distinct().collect()]  # a row per chromosome
        signal = bigwig.read_bigwig(spark, a.bigwig_file).where(F.col("chrom").isin(chroms))
    else:
        signal = text.read_bedgraph(spark, a.bigwig_file)
    mean = iv.mean_signal(segs, signal, extend=a.extend)
    text.write_feature(mean.withColumnRenamed("mean", a.feature_name), {a.feature_name: (a.normalization, a.group)}, a.output)


def ingest_distance(spark, a):
    near = nr.nearest_before_after(_segments(spark, a.regions_file), text.read_bed(spark, a.bed_file))
    d = nr.distance_features(near, reverse=a.reverse)
    names = {"progress": f"{a.feature_name}_progress", "total": f"{a.feature_name}_totalDistance"}
    text.write_feature(d.withColumnsRenamed(names), {n: (a.normalization, a.group) for n in names.values()}, a.output)


def ingest_categorical(spark, a):
    labels = iv.map_distinct(_segments(spark, a.regions_file), text.read_bed(spark, a.bed_file, a.column))
    got = iv.resolve_priority(labels, a.class_priority, null_label=a.null)
    text.write_feature(got.withColumnRenamed("label", a.feature_name), {a.feature_name: ("categorical", a.group)}, a.output)


def _featurised(name: str) -> extension.ObservationKind:
    """The kind of observation of that name, if it can be made from variants."""
    kind = extension.observation(name)
    if kind.featurise is None:
        raise ValueError(f"{name} can't be made from variants")
    return kind


def corpus_make(spark, a):
    regions = check_regions(text.read_bed12(spark, a.regions_file))
    segs, name = iv.segments(regions), F.lit(a.corpus_name).alias("corpus")
    n = regions.count()
    features, types, groups = text.read_features(spark, a.correlates_file)
    exposure = regions.select("locus", F.lit(1.0).alias("exposure"))
    if a.exposure_files:
        if len(a.exposure_files) > 1:
            raise ValueError("exposures are shared by all samples: give one file")
        exposure = check_exposures(text.read_exposures(spark, a.exposure_files[0]), n)
    seqs = text.read_fasta(spark, a.fasta_file)
    if not a.trinuc_file:
        a.trinuc_file, a.output_trinucs = f"{a.output}/trinucs_by_locus", True
        trinucs(spark, argparse.Namespace(regions_file=a.regions_file, fasta_file=a.fasta_file, output=a.trinuc_file))
    points = text.read_vcf(spark, a.vcf_files, a.chr_prefix, a.weight_col)
    rate = cl.rate_track(regions, points)
    rated = cl.local_rate(points.select("sample", "chrom", "pos"), rate)
    lone = cl.drop_clustered(cl.clusters(rated)).select("sample", "chrom", "pos").distinct()
    kind = _featurised(a.type)
    placed = kind.featurise(points.join(lone, ["sample", "chrom", "pos"], "left_semi"), segs, seqs)
    meta = spark.createDataFrame([(a.corpus_name, "types", json.dumps(types)), (a.corpus_name, "groups", json.dumps(groups)), (a.corpus_name, "regions_file", a.regions_file), (a.corpus_name, "fasta_file", a.fasta_file), (a.corpus_name, "observation", kind.name)], "corpus string, key string, value string")
    c = co.Corpus(placed.select(name, "*"), exposure.select(name, "*"), spark.read.parquet(a.trinuc_file).select(name, "*"), features.select(name, "*"), meta)
    store.save_corpus(c, a.output)


def corpus_split(spark, a):
    train, test = co.split(store.load_corpus(spark, a.corpus), a.train_prop, a.by_locus, a.seed)
    store.save_corpus(train, a.train_output)
    store.save_corpus(test, a.test_output)


def empirical_mutrate(spark, a):
    """Mutations by locus and context; with a model, by locus and the component that they are laid to."""
    corpus = store.load_corpus(spark, a.corpus)
    _save(trainer.component_rates(trainer.load(spark, a.model), corpus) if a.model else co.empirical_rate(corpus.mutations), a.output)


def _transform(corpus: co.Corpus) -> FeatureTransform:
    """The types in a corpus' metadata; columns without any pass through."""
    types = {f: "other" for f in corpus.feature_names()}
    groups: dict[str, list[str]] = {}
    if corpus.metadata is not None:
        for r in corpus.metadata.where("key IN ('types', 'groups')").collect():
            (types if r["key"] == "types" else groups).update(json.loads(r["value"]))
    return FeatureTransform({k: v for k, v in types.items() if k in corpus.feature_names()}, groups)


def _fixed(spark, a) -> dict[str, dict[str, float]]:
    """The signatures named in --fix-signatures, from the table in --signatures-file."""
    if not a.fix_signatures:
        return {}
    rows = text.read_signatures(spark, a.signatures_file).where(F.col("signature").isin(a.fix_signatures)).collect()
    out = {s: {r["label"]: r["p"] for r in rows if r["signature"] == s} for s in a.fix_signatures}
    if missing := [s for s, v in out.items() if set(v) != set(cosmic_order())]:
        raise ValueError(f"signatures without all 96 labels: {missing}")
    return out


def _options(spark, a, k: int) -> trainer.Options:
    own = {"n_components": "k", "model_type": "model_type", "num_epochs": "epochs", "tau": "tau", "kappa": "kappa", "pi_prior": "pi_prior", "batch_size": "batch_size", "locus_subsample": "locus_subsample", "empirical_bayes": "empirical_bayes", "begin_prior_updates": "begin_prior_updates", "eval_every": "eval_every", "bound_tol": "bound_tol", "time_limit": "time_limit", "seed": "seed"}
    given = {v: getattr(a, n) for n, v in own.items() if getattr(a, n, None) is not None}
    return trainer.Options(**given | {"k": k}, fixed=_fixed(spark, a))


def model_train(spark, a):
    """Trains a model; of the type marginal, one component of the corpora's own signature, its rate boosted on the features."""
    corpus = store.load_dataset(spark, a.corpuses)
    if a.model_type == "marginal":
        a.model_type = None
        model = trainer.marginal_model(corpus, _transform(corpus), _options(spark, a, 1))
    else:
        model = trainer.train(corpus, _transform(corpus), _options(spark, a, a.n_components))
    trainer.save(model, spark, a.output)


def model_score(spark, a):
    model = trainer.load(spark, a.model)
    print(json.dumps(trainer.score(model, store.load_dataset(spark, a.corpuses), rated=_known_rates(spark, a.model, model, a.corpuses))))


def model_predict(spark, a):
    model = trainer.load(spark, a.model)
    _save(trainer.predict(model, store.load_dataset(spark, a.corpuses), _known_rates(spark, a.model, model, a.corpuses)), a.output)


def save_signatures(spark, a):
    s = trainer.signatures(trainer.load(spark, a.model), spark)
    _save(store.pivoted(s, "component", "label", "p", cosmic_order()), a.output)


def plot_summary(spark, a):
    """The tables that plots of a model show. With corpora a folder: signatures, rate_track, rate_matrix and, given regions, rates_by_segment; else signatures alone."""
    model = trainer.load(spark, a.model)
    if not a.corpuses:
        return _save(trainer.signatures(model, spark), a.output)
    _save(trainer.signatures(model, spark), f"{a.output}/signatures")
    corpus = store.load_dataset(spark, a.corpuses)
    rates, names = trainer.locus_rates(model, corpus, _known_rates(spark, a.model, model, a.corpuses)), model.state.names
    _save(views.rate_track(rates.withColumn("rate", views.total(names)), "rate", ["corpus", "locus"], a.bins, a.smoothing), f"{a.output}/rate_track")
    _save(views.rate_matrix(rates, names, ["corpus", "locus"], a.bins), f"{a.output}/rate_matrix")
    if a.regions_file:
        _save(views.matrix_by_segment(rates, _segments(spark, a.regions_file)), f"{a.output}/rates_by_segment")


def list_corpuses(spark, a):
    print("\n".join(trainer.load(spark, a.model).state.corpora))


def mutation_rate_r2(spark, a):
    trainer.mutation_rate_r2(trainer.load(spark, a.model), store.load_dataset(spark, a.corpuses)).show()


def model_explain(spark, a):
    _save(posterior.explain(trainer.load(spark, a.model), store.load_dataset(spark, a.corpuses), a.signature), a.output)


def _known_rates(spark, model_path: str, model, corpora: list[str]):
    """The loci of the corpora with their log rates, those of unchanged corpora from the model's cache; None if it has none of them."""
    own = trainer.rate_digest(model)
    found = {p: store.cached(spark, f"{model_path}-cache", own, store.folder_digest(spark, p)) for p in corpora}
    if all(t is None for t in found.values()):
        return None
    return store.stack([t if t is not None else trainer.rates_for(model, store.load_corpus(spark, p))[0] for p, t in found.items()])


def cache_sstats(spark, a):
    """Keeps the corpus' log rates under the model beside the model, for scoring, prediction and annotation; made anew only where either has changed."""
    model = trainer.load(spark, a.model)
    make = lambda: trainer.rates_for(model, store.load_corpus(spark, a.corpus))[0]
    made = store.write_cached(spark, f"{a.model}-cache", trainer.rate_digest(model), store.folder_digest(spark, a.corpus), make)
    print("cached" if made else "unchanged")


def annotate_mutations(spark, a):
    model, corpus = trainer.load(spark, a.model), store.load_corpus(spark, a.corpus)
    meta = {r["key"]: r["value"] for r in corpus.metadata.collect()}
    rated = _known_rates(spark, a.model, model, [a.corpus])
    segs, seqs, name = _segments(spark, meta["regions_file"]), text.read_fasta(spark, meta["fasta_file"]), corpus.names()[0]
    for path in a.vcf_files:
        v = text.read_vcf(spark, path, a.chr_prefix, a.weight_col)
        m = _featurised(corpus.observation()).featurise(v, segs, seqs).select(F.lit(name).alias("corpus"), "*")
        got = posterior.assign(model, co.Corpus(m, corpus.loci, corpus.trinucs, corpus.features), sweeps=a.iters, rated=rated)
        text.annotate_vcf(spark, path, got, f"{a.output_prefix}{path.rstrip('/').rsplit('/', 1)[-1]}", a.chr_prefix)


def study_create(spark, a):
    settings = {k: v for k, v in vars(a).items() if k not in ("run", "command")}
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("errorifexists").text(f"{a.storage}/{a.study_name}/settings")


def _study(spark, a):
    s = json.loads(spark.read.text(f"{a.storage}/{a.study_name}/settings").first()[0])
    return s, f"{a.storage}/{a.study_name}/trials"


def study_run_trial(spark, a):
    s, path = _study(spark, a)
    corpus = store.load_dataset(spark, s["corpuses"])
    base = trainer.Options(model_type=s["model_type"], epochs=s["num_epochs"], batch_size=s["batch_size"], locus_subsample=s["locus_subsample"], empirical_bayes=s["empirical_bayes"], pi_prior=s["pi_prior"])
    tuning.search(corpus, _transform(corpus), path, a.iters, (s["min_components"], s["max_components"]), base, seed=a.seed)


def study_summarize(spark, a):
    _, path = _study(spark, a)
    _save(spark.read.parquet(path), a.output)


def study_retrain(spark, a):
    s, path = _study(spark, a)
    row = tuning.best(spark.read.parquet(path), a.trial_num).first()
    if row is None:
        raise ValueError("no such completed trial")
    o = trainer.Options(**json.loads(row["params"]))
    o.epochs = a.num_epochs or o.epochs
    corpus = store.load_dataset(spark, s["corpuses"])
    trainer.save(trainer.train(corpus, _transform(corpus), o), spark, a.output)


def run_simulation(spark, a):
    with open(a.config) as f:
        c = json.load(f)
    if "signatures_file" in c:
        rows = text.read_signatures(spark, c.pop("signatures_file")).collect()
        wanted = c.pop("cosmic_sigs", None)
        c["signatures"] = {n: {r["label"]: r["p"] for r in rows if r["signature"] == n} for n in wanted or sorted({r["signature"] for r in rows})}
    corpus, truth = simulate.simulate(spark, simulate.SimulationConfig(**c))
    store.save_corpus(corpus, f"{a.prefix}.corpus")
    truth.pop("states").write.mode("overwrite").parquet(f"{a.prefix}.states")
    kept = json.dumps({k: v.tolist() if hasattr(v, "tolist") else v for k, v in truth.items()})
    spark.createDataFrame([(kept,)], "truth string").coalesce(1).write.mode("overwrite").text(f"{a.prefix}.truth")


def simulate_from_model(spark, a):
    corpus = store.load_corpus(spark, a.corpus)
    if a.n_samples is not None:
        corpus = co.subset_samples(corpus, co.sample_exactly(corpus.mutations, a.n_samples, "corpus", "sample", seed=a.seed))
    store.save_corpus(simulate.resample(trainer.load(spark, a.model), corpus, a.seed), a.output)


def eval_sim(spark, a):
    import numpy as np

    truth = json.loads(spark.read.text(f"{a.simulation_params}").first()[0])
    print(json.dumps(simulate.recovery(trainer.load(spark, a.model), {k: np.array(v) for k, v in truth.items()})))


#: Command to its function and its arguments: a name that ends in "+" takes several values, "?" stands before optional ones, a type or default follows ":".
COMMANDS = {
    "preprocess-estimate-mutrate": (estimate_mutrate, "--vcf-files+ --regions-file --output ?--chr-prefix:"),
    "preprocess-cluster-mutations": (cluster_mutations, "vcf-file --mutation-rate-bedgraph --output ?--chr-prefix: ?--sample"),
    "get-regions": (get_regions, "--genome-file --blacklist-file --window-size:int --output ?--categorical-features+"),
    "get-trinucs": (trinucs, "--fasta-file --regions-file --output"),
    "ingest-bigwig": (ingest_bigwig, "bigwig-file --regions-file --feature-name --output ?--group:all ?--extend:int:0 ?--normalization:power"),
    "ingest-distance": (ingest_distance, "bed-file --regions-file --feature-name --output ?--group:all ?--normalization:power ?--reverse:flag"),
    "ingest-categorical": (ingest_categorical, "bed-file --regions-file --feature-name --output ?--group:all ?--null:None ?--class-priority+ ?--column:int:4"),
    "corpus-make": (corpus_make, "--corpus-name --vcf-files+ --fasta-file --regions-file --correlates-file --output ?--exposure-files+ ?--trinuc-file ?--weight-col ?--chr-prefix: ?--type:sbs"),
    "corpus-split": (corpus_split, "corpus --train-output --test-output ?--train-prop:float:0.7 ?--by-locus:flag ?--seed:int:0"),
    "corpus-empirical-mutation-rate": (empirical_mutrate, "corpus ?--output ?--model"),
    "study-create": (study_create, "--corpuses+ --study-name --max-components:int --min-components:int --storage ?--num-epochs:int:500 ?--model-type:linear ?--locus-subsample:float ?--batch-size:int ?--empirical-bayes:flag ?--pi-prior:float:1"),
    "study-run-trial": (study_run_trial, "study-name --storage ?--iters:int:1 ?--seed:int:0"),
    "study-summarize": (study_summarize, "study-name --storage ?--output"),
    "study-retrain": (study_retrain, "study-name --storage --output ?--trial-num:int ?--num-epochs:int"),
    "model-train": (model_train, "--n-components:int --corpuses+ --output ?--model-type:linear ?--locus-subsample:float ?--batch-size:int ?--begin-prior-updates:int:10 ?--time-limit:int ?--fix-signatures+ ?--signatures-file ?--empirical-bayes:flag ?--tau:int:16 ?--kappa:float:0.5 ?--eval-every:int:10 ?--seed:int:1776 ?--pi-prior:float:1 ?--num-epochs:int:1000 ?--bound-tol:float:0.01"),
    "model-score": (model_score, "model --corpuses+"),
    "model-predict": (model_predict, "model --corpuses+ --output"),
    "model-plot-summary": (plot_summary, "model --output ?--corpuses+ ?--regions-file ?--bins:int:1000 ?--smoothing:int:300"),
    "model-save-signatures": (save_signatures, "model ?--output"),
    "model-list-corpuses": (list_corpuses, "model"),
    "model-mutation-rate-r2": (mutation_rate_r2, "model --corpuses+"),
    "model-explain": (model_explain, "model --signature --corpuses+ ?--output"),
    "model-cache-sstats": (cache_sstats, "model --corpus"),
    "model-annotate-mutations": (annotate_mutations, "model --vcf-files+ --corpus --output-prefix ?--chr-prefix: ?--weight-col ?--iters:int:5000"),
    "simulate-from-model": (simulate_from_model, "model --corpus --output ?--n-samples:int ?--seed:int:0"),
    "simulate": (run_simulation, "--config --prefix"),
    "eval-sim": (eval_sim, "model --simulation-params"),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("regionlytics", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (run, spec) in COMMANDS.items():
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0] or None)
        p.set_defaults(run=run)
        for word in spec.split():
            optional, word = word.startswith("?"), word.removeprefix("?")
            head, _, rest = word.partition(":")
            kind, _, default = rest.partition(":") if rest.split(":")[0] in ("int", "float", "flag") else ("", "", rest)
            head, several = head.removesuffix("+"), head.endswith("+")
            if kind == "flag":
                p.add_argument(head, action="store_true")
                continue
            options = {"type": {"int": int, "float": float}.get(kind, str)}
            if several:
                options["nargs"] = "+"
            if optional:
                value = [] if several and name == "get-regions" else None
                options["default"] = options["type"](default) if default or (":" in word and not kind) else value
            if head.startswith("--"):
                options["required"] = not optional
                p.add_argument(head, **options)
            else:
                p.add_argument(head.replace("-", "_"), metavar=head, **options)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(), a)


if __name__ == "__main__":
    main()
