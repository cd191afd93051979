"""Nucleotide strings: strands, three-letter contexts and their numbers, mutation labels, k-mers."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
#: Contexts by middle, left and right base; a context's number is its place here.
CONTEXTS = [left + mid + right for mid, left, right in product(BASES, repeat=3)]


def alternatives(context: str) -> list[str]:
    """The three bases that the middle one can turn into, in alphabetical order."""
    return [b for b in BASES if b != context[1]]


def cosmic_order() -> list[str]:
    """The 96 labels of pyrimidine mutations, by mutation, left and right base."""
    return [f"{left}[{ref}>{alt}]{right}" for ref in "CT" for alt in BASES if alt != ref for left, right in product(BASES, repeat=2)]


def revcomp(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def _pyrimidine(context: Column) -> Column:
    return F.substring(context, 2, 1).isin("C", "T")


def fold_context(context: Column) -> Column:
    """The context on the strand where its middle base is C or T."""
    return F.when(_pyrimidine(context), context).otherwise(revcomp(context))


def fold_alt(context: Column, alt: Column) -> Column:
    return F.when(_pyrimidine(context), alt).otherwise(F.translate(alt, "ACGT", "TGCA"))


def strand(context: Column) -> Column:
    return F.when(_pyrimidine(context), F.lit("f")).otherwise(F.lit("r"))


def cosmic_label(context: Column, alt: Column) -> Column:
    """``A[C>T]G``, on the pyrimidine strand."""
    c, a = fold_context(context), fold_alt(context, alt)
    return F.concat(F.substring(c, 1, 1), F.lit("["), F.substring(c, 2, 1), F.lit(">"), a, F.lit("]"), F.substring(c, 3, 1))


def base_index(base: Column) -> Column:
    """0 to 3 for A, C, G, T; null for anything else."""
    return F.when(base == "A", 0).when(base == "C", 1).when(base == "G", 2).when(base == "T", 3)


def context_index(context: Column) -> Column:
    """The context's number; null if it holds another letter."""
    place = lambda i: base_index(F.substring(context, i, 1))
    return 16 * place(2) + 4 * place(1) + place(3)


def alt_index(context: Column, alt: Column) -> Column:
    """Which of the three alternatives alt is; null if it is the middle base or no base."""
    ref = F.substring(context, 2, 1)
    return F.when(alt != ref, base_index(alt) - (base_index(alt) > base_index(ref)).cast("int"))


def context_table(spark: SparkSession) -> DataFrame:
    """(context_id, context) of the 64 contexts, as a product of base tables."""
    base = spark.createDataFrame(list(enumerate(BASES)), "i int, b string")
    mid, left, right = base.toDF("mi", "m"), base.toDF("li", "l"), base.toDF("ri", "r")
    full = mid.crossJoin(left).crossJoin(right)  # four rows each
    return full.select((16 * F.col("mi") + 4 * F.col("li") + F.col("ri")).alias("context_id"), F.concat("l", "m", "r").alias("context"))


def kmers(seq: Column, k: int = 3) -> Column:
    """All substrings of length k: cut from each of k offsets, so that long sequences take linear time."""
    cuts = [F.regexp_extract_all(F.substring(seq, i + 1, 2**31 - 1 - i), F.lit(f"(?s).{{{k}}}"), F.lit(0)) for i in range(k)]
    return F.concat(*cuts)


def kmer_counts(sequences: DataFrame, key: str, seq: str, k: int = 3) -> DataFrame:
    """(key, kmer, n) over the k-mers of A, C, G and T only, upper-cased."""
    exploded = sequences.select(key, F.explode(kmers(F.upper(F.col(seq)), k)).alias("kmer"))
    return exploded.where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).groupBy(key, "kmer").agg(F.count("*").alias("n"))


def split_strands(profile: DataFrame) -> DataFrame:
    """(sample, label, f, r): a profile (sample, context, alt, weight) on both strands, by label."""
    c = profile.withColumn("label", cosmic_label(F.col("context"), F.col("alt"))).withColumn("strand", strand(F.col("context")))
    return c.groupBy("sample", "label").pivot("strand", ["f", "r"]).agg(F.sum("weight")).na.fill(0.0, ["f", "r"])


def signature_matrix(signature: dict[str, float]):
    """64 x 3 probabilities from the 96 labels, half of each on either strand."""
    import numpy as np

    out = np.zeros((64, 3))
    flip = str.maketrans("ACGT", "TGCA")
    for label, p in signature.items():
        left, ref, alt, right = label[0], label[2], label[4], label[6]
        c = left + ref + right
        for context, a in ((c, alt), (c.translate(flip)[::-1], alt.translate(flip))):
            out[CONTEXTS.index(context), alternatives(context).index(a)] += p / 2
    return out
