"""Corpora as tables: unions, subsets, splits, and rates counted from mutations."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .durable import numbered, small_or_shuffled


@dataclass
class Corpus:
    """The tables of one or several corpora; ``corpus`` names the corpus of a row.

    mutations (corpus, sample, chrom, pos, locus, context, mutation, attribute, weight), loci
    (corpus, locus, exposure), trinucs (corpus, locus, context, n) or, packed, (corpus, locus, n array
    by context), features (corpus, locus, one column per feature), metadata (corpus, key, value).
    """

    mutations: DataFrame
    loci: DataFrame
    trinucs: DataFrame
    features: DataFrame
    metadata: DataFrame | None = None

    def shape(self) -> dict[str, int]:
        m = self.mutations.agg(F.count_distinct("corpus", "sample")).first()[0]
        loci = self.loci.select("locus").distinct().count()
        return {"samples": m, "loci": loci, "contexts": 64, "mutations": 3, "features": len(self.feature_names())}

    def feature_names(self) -> list[str]:
        return [c for c in self.features.columns if c not in ("corpus", "locus")]

    def names(self) -> list[str]:
        return sorted(r[0] for r in self.loci.select("corpus").distinct().collect())

    def observation(self) -> str:
        """The kind of observation that the metadata name, one for all corpora; substitutions if they name none."""
        if self.metadata is None:
            return "sbs"
        kinds = {r["value"] for r in self.metadata.where("key = 'observation'").select("value").distinct().collect()}  # a row per kind
        if len(kinds) > 1:
            raise ValueError(f"corpora must be of one kind of observation, not {sorted(kinds)}")
        return kinds.pop() if kinds else "sbs"

    def samples(self) -> DataFrame:
        return self.mutations.select("corpus", "sample").distinct()


def packed(trinucs: DataFrame) -> bool:
    """Whether trinucs hold an array by context for each locus, instead of a row for each context."""
    return isinstance(trinucs.schema["n"].dataType, ArrayType)


def unpacked(trinucs: DataFrame) -> DataFrame:
    """trinucs with a row for each context; null in an array stands for none."""
    if not packed(trinucs):
        return trinucs
    return trinucs.select(*[c for c in trinucs.columns if c != "n"], F.posexplode("n").alias("context", "n")).where("n IS NOT NULL")


def union(corpora: list[Corpus]) -> Corpus:
    """One Corpus of several; names must be unique, features and loci the same."""
    names = [n for c in corpora for n in c.names()]
    if len(set(names)) != len(names):
        raise ValueError(f"corpora must have unique names, not {names}")
    first = corpora[0]
    for c in corpora[1:]:
        if set(c.feature_names()) != set(first.feature_names()):
            raise ValueError("corpora must have the same features")
        if not same_rows(c.loci.select("locus").distinct(), first.loci.select("locus").distinct()):
            raise ValueError("corpora must have the same loci")
    stack = lambda part: reduce(lambda a, b: a.unionByName(b), [getattr(c, part) for c in corpora])
    return Corpus(stack("mutations"), stack("loci"), stack("trinucs"), stack("features"), stack("metadata") if all(c.metadata is not None for c in corpora) else None)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether a and b hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def subset_samples(corpus: Corpus, samples: DataFrame) -> Corpus:
    """Only the samples in samples (corpus, sample); metadata is dropped."""
    keep = small_or_shuffled(samples.select("corpus", "sample").distinct())
    return replace(corpus, mutations=corpus.mutations.join(keep, ["corpus", "sample"], "left_semi"), metadata=None)


def reindex(loci: DataFrame, order: str = "locus") -> DataFrame:
    """(locus, new_locus): the loci numbered from 0 in the order given."""
    return numbered(loci.select("locus", *([order] if order != "locus" else [])).distinct(), order, name="new_locus").select("locus", "new_locus")


def subset_loci(corpus: Corpus, loci: DataFrame, order: str = "locus") -> Corpus:
    """Only the loci given, renumbered densely from 0 in the order of ``order``."""
    ids = small_or_shuffled(reindex(loci, order))
    move = lambda df: df.join(ids, "locus").withColumn("locus", F.col("new_locus")).drop("new_locus").select(df.columns)
    return Corpus(move(corpus.mutations), move(corpus.loci), move(corpus.trinucs), move(corpus.features), corpus.metadata)


def ranked(df: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    """Distinct keys with ordinal, their rank by a seeded MD5: the same on every run, in every plan and engine."""
    k = df.select(*keys).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])))
    return numbered(k, "_h", *keys).drop("_h")


def sample_exactly(df: DataFrame, k: int, *keys: str, seed: int = 0) -> DataFrame:
    """k distinct keys of df, without replacement."""
    h = F.xxhash64(F.lit(seed), *keys)
    return df.select(*keys).distinct().orderBy(h, *keys).limit(k)


def split(corpus: Corpus, share: float = 0.7, by_locus: bool = False, seed: int = 0) -> tuple[Corpus, Corpus]:
    """Training and test corpus with int(share * N) and the other samples, or loci."""
    keys = ("locus",) if by_locus else ("corpus", "sample")
    r = ranked(corpus.loci if by_locus else corpus.mutations, *keys, seed=seed)
    n = int(share * r.count())
    train, test = r.where(F.col("ordinal") < n), r.where(F.col("ordinal") >= n)
    part = subset_loci if by_locus else subset_samples
    return part(corpus, train.drop("ordinal")), part(corpus, test.drop("ordinal"))


def empirical_rate(mutations: DataFrame, keys: tuple[str, ...] = ("corpus",)) -> DataFrame:
    """(keys, locus, context, weight): summed weights of mutations, with the log of the sum as log_weight."""
    g = mutations.groupBy(*keys, "locus", "context").agg(F.sum("weight").alias("weight"))
    return g.withColumn("log_weight", F.log("weight"))


def mutation_totals(mutations: DataFrame, keys: tuple[str, ...] = ("corpus", "sample")) -> DataFrame:
    return mutations.groupBy(*keys).agg(F.sum("weight").alias("total"), F.count("*").alias("n"))


def profile(mutations: DataFrame) -> DataFrame:
    """(sample, context, mutation, weight), the counts that a signature plot shows."""
    return mutations.groupBy("sample", "context", "mutation").agg(F.sum("weight").alias("weight"))


def context_share(trinucs: DataFrame) -> DataFrame:
    """(context, share) of the genome."""
    g = unpacked(trinucs).groupBy("context").agg(F.sum("n").alias("n"))
    return g.select("context", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("share"))  # 64 rows


def normalised(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """df with value divided by its sum per keys."""
    return df.withColumn(value, F.col(value) / F.sum(value).over(W.partitionBy(*keys)))


def subset_components(gamma: DataFrame, components: list[str]) -> DataFrame:
    """gamma (corpus, sample, component, gamma) of some components, renormalised per sample."""
    return normalised(gamma.where(F.col("component").isin(components)), "gamma", "corpus", "sample")


def top_component(gamma: DataFrame) -> DataFrame:
    """(corpus, sample, component, share): each sample's largest component."""
    return normalised(gamma, "gamma", "corpus", "sample").groupBy("corpus", "sample").agg(F.max_by("component", F.struct("gamma", "component")).alias("component"), F.max("gamma").alias("share"))
