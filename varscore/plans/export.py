"""Annotated and filtered variant text: rows in, text lines or files out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.constants import SCORE_DESCRIPTION, SCORE_INFO_ID, VCF_COLUMNS
from varscore.operators.clinvar import observed_filter
from varscore.operators.lookup import annotate, annotated_info
from varscore.sinks.vcf import info_header, write_vcf_lines


def annotated_header(header: DataFrame, info_id: str = SCORE_INFO_ID, description: str = SCORE_DESCRIPTION):
    """Header lines with the new INFO line placed before the column line."""
    is_columns = F.startswith("value", F.lit("#CHROM"))
    lines = F.when(is_columns, F.array(F.lit(info_header(info_id, description)), F.col("value"))).otherwise(
        F.array("value")
    )
    return header.select(F.explode(lines).alias("value"))


def annotated_lines(body: DataFrame, scores: DataFrame, info_id: str = SCORE_INFO_ID, **options) -> DataFrame:
    """Body lines with the score appended to INFO; columns after INFO are carried along.

    The lines keep the order of `body`, whether the join is broadcast or shuffled: each gets its place (partition and
    number of the scan, whose splits are the same whenever a task runs again) before the join.
    """
    tail = F.slice(F.split("value", "\t"), len(VCF_COLUMNS) + 1, F.size(F.split("value", "\t")))
    placed = body.withColumn("_tail", tail).withColumn("_place", F.monotonically_increasing_id())
    rows = annotate(placed, scores, place_col="_place", **options)
    fixed = [F.col(c).cast("string") for c in VCF_COLUMNS[:-1]]
    return rows.select(F.concat_ws("\t", *fixed, annotated_info(info_id), "_tail").alias("value"))


def filter_file(header: DataFrame, body: DataFrame, path: str, compress: bool = True, mode="error", **parameters) -> dict:
    """Write the filtered lines below their header; returns total, kept and the count of each label, gathered meanwhile."""
    kept, seen, passed = observed_filter(body, **parameters)
    write_vcf_lines(header, kept, path, compress, mode)
    return {**seen.get, **passed.get}
