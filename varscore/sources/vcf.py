"""Variant call text: header lines apart from body rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscore.constants import VCF_COLUMNS
from varscore.functions.once import evaluate_once
from varscore.runtime import spread_in_order
from varscore.sources.members import read_members


def vcf_header(lines: DataFrame) -> DataFrame:
    return lines.where(F.startswith("value", F.lit("#")))


def vcf_body(lines: DataFrame) -> DataFrame:
    """Body lines split at tabs into the eight fixed columns; `value` keeps the line unchanged."""
    body = lines.where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0))
    split = evaluate_once(body.select("value"), _fields=F.split("value", "\t"))
    columns = {name: F.get("_fields", F.lit(i)) for i, name in enumerate(VCF_COLUMNS)}
    columns["POS"] = columns["POS"].try_cast("long")
    return split.select("value", *[c.alias(name) for name, c in columns.items()])


def vcf_rejects(lines: DataFrame) -> DataFrame:
    """Body lines whose POS is no number or whose fields are fewer than eight; `vcf_body` gives null for what is missing."""
    body = lines.where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0))
    fields = F.split("value", "\t")
    return body.where((F.size(fields) < len(VCF_COLUMNS)) | F.get(fields, F.lit(1)).try_cast("long").isNull()).select("value")


def read_vcf(spark: SparkSession, path: str, members: bool = False, **options):
    """Return `(header, body)` of a plain or gzipped file, folder or glob.

    One gzip file cannot be split, so it is read by one task; its raw lines are spread before they are parsed, in
    ranges of their order, so the body has the order of the lines either way. Several files give all their headers;
    `write_vcf_lines` merges them. With `members`, block-compressed files are read by several tasks (see `members.py`).
    """
    lines = read_members(spark, path, **options) if members else spark.read.text(path)
    return vcf_header(lines).select("value"), vcf_body(spread_in_order(lines.select("value")))
