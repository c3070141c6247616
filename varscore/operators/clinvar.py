"""Clinically labelled variants: records, filters, labels and counts."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from varscore.constants import BENIGN_LABELS, IGNORED_LABELS, PATHOGENIC_LABELS, SNV_CLASS
from varscore.functions.info import gene_symbol, info_value, review_stars
from varscore.functions.once import evaluate_once

LABELS = PATHOGENIC_LABELS + BENIGN_LABELS


def _text(key):
    return F.coalesce(info_value(F.col("INFO"), key), F.lit(""))


def with_annotations(body: DataFrame) -> DataFrame:
    """Add CLNSIG, CLNVC, CLNREVSTAT, GENE and stars, taken from INFO."""
    parsed = evaluate_once(
        body,
        CLNSIG=_text("CLNSIG"),
        CLNVC=_text("CLNVC"),
        CLNREVSTAT=_text("CLNREVSTAT"),
        GENE=gene_symbol(info_value(F.col("INFO"), "GENEINFO")),
    )
    return parsed.withColumn("stars", review_stars(F.col("CLNREVSTAT")))


def with_significance(body: DataFrame) -> DataFrame:
    """Add CLNSIG alone, for jobs that read no other field."""
    return evaluate_once(body, CLNSIG=_text("CLNSIG"))


def clinvar_records(body: DataFrame) -> DataFrame:
    """Typed records of a labelled variant file."""
    return with_annotations(body).select("CHROM", "POS", "REF", "ALT", "CLNSIG", "CLNREVSTAT", "stars", "GENE")


def keep_condition(min_stars=1, include=None, exclude=None, snv_only=True):
    """The filter as one condition over the columns of `with_annotations`.

    Without `include` the four labels are wanted, without `exclude` the ignored labels are left out, also where
    `include` names them; an empty `exclude` leaves nothing out.
    """
    exclude = IGNORED_LABELS if exclude is None else tuple(exclude)
    include = LABELS if include is None else tuple(include)
    condition = F.col("CLNSIG").isin(*include)
    if min_stars is not None:
        condition &= F.col("stars") >= min_stars
    if exclude:
        condition &= ~F.col("CLNSIG").isin(*exclude)
    if snv_only:
        condition &= F.col("CLNVC") == SNV_CLASS
    return condition


def filter_clinvar(body: DataFrame, min_stars=1, include=None, exclude=None, snv_only=True) -> DataFrame:
    """Rows of sufficient review status, wanted significance and single-nucleotide class."""
    return with_annotations(body).where(keep_condition(min_stars, include, exclude, snv_only))


def filter_summary(body: DataFrame, **parameters) -> DataFrame:
    """Total and kept row counts in one pass."""
    kept = F.count_if(keep_condition(**parameters)).alias("kept")
    return with_annotations(body).agg(F.count(F.lit(1)).alias("total"), kept)


def observed_filter(body: DataFrame, **parameters):
    """`(kept, seen, passed)`: the filtered rows, and two observations that are filled when the rows are used.

    `seen` holds the total and the count of each label before the filter, `passed` the rows kept, so a job that writes
    the rows reports its counts without parsing anything again. They are filled by the first action on the rows.
    """
    seen, passed = Observation(), Observation()
    labels = [F.count_if(F.col("CLNSIG") == label).alias(label) for label in LABELS]
    parsed = with_annotations(body).observe(seen, F.count(F.lit(1)).alias("total"), *labels)
    kept = parsed.where(keep_condition(**parameters)).observe(passed, F.count(F.lit(1)).alias("kept"))
    return kept, seen, passed


def count_clinsig(df: DataFrame) -> DataFrame:
    """Rows per label, the four labels always present."""
    counts = df.agg(*[F.count_if(F.col("CLNSIG") == label).alias(label) for label in LABELS])
    return counts.unpivot([], list(LABELS), "CLNSIG", "n")


def with_label(df: DataFrame, strict: bool = True) -> DataFrame:
    """Add `y`: 1 pathogenic, 0 benign. Strict drops every other row, lenient calls it 0."""
    pathogenic = F.col("CLNSIG").isin(*PATHOGENIC_LABELS)
    if not strict:
        return df.withColumn("y", F.coalesce(pathogenic.cast("int"), F.lit(0)))
    label = F.when(pathogenic, 1).when(F.col("CLNSIG").isin(*BENIGN_LABELS), 0)
    return df.where(F.col("CLNSIG").isin(*LABELS)).withColumn("y", label)


def with_x(df: DataFrame) -> DataFrame:
    """Add `x` = -score, so that larger means more pathogenic. Subtraction from 0 gives no negative zero."""
    return df.withColumn("x", F.lit(0.0) - F.col("score"))


def split_stats(split: DataFrame) -> DataFrame:
    """Row and label counts of each part of a split."""
    counts = [F.count_if(F.col("CLNSIG") == label).alias(label) for label in LABELS]
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        *counts,
        F.count_if(F.col("CLNSIG").isin(*PATHOGENIC_LABELS)).alias("Total_P"),
        F.count_if(F.col("CLNSIG").isin(*BENIGN_LABELS)).alias("Total_B"),
    )
