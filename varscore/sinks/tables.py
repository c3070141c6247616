"""CSV, JSON and Parquet sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from varscore import schemas


def write_split(split: DataFrame, path: str, mode="error"):
    """Train and test rows as CSV below `split=train` and `split=test`."""
    columns = schemas.SPLIT.fieldNames()
    split.select(*columns, "split").write.mode(mode).partitionBy("split").csv(path, header=True)


def _fixed(column, kind, decimals):
    """Doubles, also inside sections, as numbers of fixed decimals; what is not finite as null."""
    if isinstance(kind, StructType):
        return F.struct(*[_fixed(column[f.name], f.dataType, decimals).alias(f.name) for f in kind.fields])
    if isinstance(kind, DoubleType):
        finite = ~F.isnan(column) & (F.abs(column) != float("inf"))
        return F.when(finite, column).try_cast(f"decimal(38,{decimals})")
    return column


def report_json(report: DataFrame, decimals=None) -> DataFrame:
    """A one-row report as JSON text, sections as nested objects; an infinite threshold is written as a string.

    With `decimals` every fraction has that many places, so the text is the same whatever prints it; an infinite
    threshold is null then. Missing values are written as null.
    """
    fields = report.schema.fields
    values = ["*"] if decimals is None else [_fixed(F.col(f.name), f.dataType, decimals).alias(f.name) for f in fields]
    return report.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str, mode="error", decimals=None):
    report_json(report, decimals).write.mode(mode).text(path)


def append_scores(scores: DataFrame, path: str):
    """Add generated scores to a Parquet table; `resume_scores` finds what is already there."""
    scores.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.GENERATED_SCORES.fields]
    ).write.mode("append").parquet(path)


def write_mutations(mutations: DataFrame, path: str, mode="error"):
    mutations.select(*schemas.MUTATIONS.fieldNames()).write.mode(mode).parquet(path)


def write_predictions(predictions: DataFrame, path: str, mode="error"):
    columns = [*schemas.SPLIT.fieldNames(), "y"]
    predictions.select(*columns).withColumnRenamed("y", "label").write.mode(mode).csv(path, header=True)
