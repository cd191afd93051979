"""Studies: tables of trials, the best one, early stopping, random search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best(trials: DataFrame, number: int | None = None) -> DataFrame:
    """The completed trial of the smallest value, the first of several; or the one of that number."""
    if number is not None:
        return trials.where(F.col("trial") == number)
    return trials.where("state = 'complete' AND value IS NOT NULL").orderBy("value", "trial").limit(1)


def stalled(history: DataFrame, order: str, value: str, patience: int = 5, keys: list[str] | None = None) -> DataFrame:
    """(keys, order, stop): whether the last ``patience`` values of a run brought nothing below all before."""
    w = W.partitionBy(*(keys or [])).orderBy(order)
    early = F.min(value).over(w.rowsBetween(W.unboundedPreceding, -patience))
    late = F.min(value).over(w.rowsBetween(-(patience - 1), 0))
    return history.select(*(keys or []), order, F.coalesce(late >= early, F.lit(False)).alias("stop"))


def next_number(spark, study: str, seed: int) -> int:
    """A trial number that no other process has taken: numbers are claimed by files that may be created only once.

    study is a folder that Spark's writers reach; ``seed`` starts the search for a free number.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{study.rstrip('/')}-numbers")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    n = seed
    while not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(path, str(n))):
        n += 1
    return n


def search(corpus, transform, study: str, trials: int, k_range: tuple[int, int], base, share: float = 0.7, seed: int = 0, patience: int = 5) -> DataFrame:
    """Random search: each trial trains on a share of the loci and is scored on the others; its row joins the study's table.

    study is a folder of Parquet files; processes that search at once append to it, each trial under
    a number of its own, which also seeds its parameters. A trial's perplexity on the other loci is
    taken at every evaluation; after ``patience`` of them without a gain it ends, and its value is
    the best. Rows also hold all evaluations and the rates' R2 on both shares. Returns the table.
    """
    import json
    import random
    from dataclasses import replace

    from ..operators.corpora import split
    from .trainer import mutation_rate_r2, score, train

    spark = corpus.mutations.sparkSession
    first, second = split(corpus, share, by_locus=True, seed=seed)
    for _ in range(trials):
        t = next_number(spark, study, 0)
        rng = random.Random(f"{seed}:{t}")
        o = replace(base, k=rng.randint(*k_range), seed=rng.randrange(1 << 30))
        if o.model_type == "gbt":
            o.rate_options = {"depth": rng.randint(2, 5), "learning_rate": 10 ** rng.uniform(-2, -0.5), "l2": 10 ** rng.uniform(-2, 1), "least": float(rng.randint(5, 50))} | base.rate_options
        state, value, r2, scores = "complete", None, (None, None), []

        def evaluated(model, scores=scores) -> bool:
            scores.append(score(model, second)["perplexity"])
            rows = spark.createDataFrame(list(enumerate(scores)), "evaluation int, perplexity double")
            return stalled(rows, "evaluation", "perplexity", patience).orderBy(F.col("evaluation").desc()).first()["stop"]

        try:
            model = train(first, replace(transform), o, evaluated)
            value = min(scores)
            r2 = tuple(float(mutation_rate_r2(model, c).first()["r2"]) for c in (first, second))
        except (ValueError, ArithmeticError) as x:
            state, o.fixed = f"failed: {x}"[:200], {}
        row = [(t, state, float(value) if value is not None else None, json.dumps({k: v for k, v in vars(o).items() if k != "fixed"}), json.dumps(scores), *r2)]
        schema = "trial long, state string, value double, params string, evaluations string, r2_train double, r2_test double"
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(study)
    return spark.read.parquet(study)
