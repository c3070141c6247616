"""Mutation matrices: twenty log-likelihood ratios per protein position, wide or long."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.constants import AMINO_ACIDS
from varscore.functions.llr import llr_row, pick
from varscore.functions.sequence import aa_at


def llr_matrix(positions: DataFrame) -> DataFrame:
    """Rows with `ref_aa` and `logits` -> the same rows with `llr`, an array in amino-acid order.

    A position whose reference is not one of the twenty has no ratios and is left out.
    """
    ratios = llr_row(F.col("logits"), F.col("ref_aa"))
    return positions.where(pick(F.col("logits"), F.col("ref_aa")).isNotNull()).withColumn("llr", ratios).drop("logits")


def matrix_long(matrix: DataFrame) -> DataFrame:
    """One row per position and alternative amino acid."""
    columns = [c for c in matrix.columns if c != "llr"]
    return matrix.select(*columns, F.posexplode("llr").alias("aa_idx", "llr")).select(
        *columns, aa_at(F.col("aa_idx")).alias("alt_aa"), "llr"
    )


def matrix_wide(matrix: DataFrame) -> DataFrame:
    """One column per amino acid; a map-only projection of the array."""
    columns = [c for c in matrix.columns if c != "llr"]
    return matrix.select(*columns, *[F.get("llr", F.lit(i)).alias(aa) for i, aa in enumerate(AMINO_ACIDS)])


def pivot_long(long: DataFrame, keys) -> DataFrame:
    """Long rows `(keys, alt_aa, llr)` -> one column per amino acid; missing ones are null."""
    return long.groupBy(*keys).pivot("alt_aa", list(AMINO_ACIDS)).agg(F.first("llr"))


def conservation(matrix: DataFrame, keys) -> DataFrame:
    """Mean absolute ratio of the nineteen alternatives of each position."""
    values = [F.get("llr", F.lit(i)) for i in range(len(AMINO_ACIDS))]
    total, known = F.lit(0.0), F.lit(0)
    for v in values:
        total, known = total + F.coalesce(F.abs(v), F.lit(0.0)), known + F.when(v.isNotNull(), 1).otherwise(0)
    # The reference residue contributes 0 to the sum, so it only has to be left out of the count.
    mean = F.when(F.col("llr").isNotNull(), F.try_divide(total, known - 1))
    return matrix.select(*keys, mean.alias("conservation"))


def picked_llr(snvs: DataFrame) -> DataFrame:
    """As `attach_llr`, for changes whose codon brought its twenty ratios along as `llr`: no join per change."""
    picked = snvs.withColumn("llr", F.get("llr", F.col("aa_idx"))).drop("aa_idx")
    return picked.where(~F.isnan("llr") & F.col("llr").isNotNull())


def attach_llr(snvs: DataFrame, long: DataFrame) -> DataFrame:
    """Scores of changes by (transcript_id, codon_idx, alt_aa); changes without a number are left out."""
    hits = snvs.join(long.drop("ref_aa"), ["transcript_id", "codon_idx", "alt_aa"])
    return hits.where(~F.isnan("llr") & F.col("llr").isNotNull())
