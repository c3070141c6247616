"""Quantile sketches that can be kept and merged, beside the exact percentiles of `operators.curves`.

A sketch of a day's scores is a few KiB. Percentiles over any days come from their merged sketches, without reading the
scores again. They are approximate: with a probability of 99 % the rank of a returned value is off by at most
`rank_error(k)` of all rows, and repeated runs may return different values. The exact percentiles stay the default.

Nulls and NaN are left out. Sketches are aggregated partially before the shuffle, so a hot group is no burden.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscore.sinks import batches

SIZE = 4096
DAY_SKETCH = "batch string, sketch binary"


def rank_error(k: int = SIZE) -> float:
    """The published error of one quantile of such a sketch, as a share of all rows (99 % confidence)."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, by, x: str = "x", k: int = SIZE) -> DataFrame:
    """One row per group: its columns and `sketch`."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(x).cast("double"), F.lit(k)).alias("sketch"))


def merged(table: DataFrame, by=()) -> DataFrame:
    """Sketches added up over coarser groups, or over all rows."""
    return table.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentiles(table: DataFrame, quantiles, by=()) -> DataFrame:
    """`n`, q0, q1, ... per group of `by`; the percentiles of no values are null."""
    found = merged(table, by).withColumn("n", F.kll_sketch_get_n_double("sketch"))
    some = F.when(F.col("n") > 0, F.col("sketch"))
    return found.select(*by, "n", *[F.kll_sketch_get_quantile_double(some, F.lit(float(q))).alias(f"q{i}") for i, q in enumerate(quantiles)])


def append_day(df: DataFrame, root: str, day: str, x: str = "x", k: int = SIZE) -> bool:
    """Add the sketch of a day exactly once; False where the day is there already."""
    table = sketches(df, [], x, k).select(F.lit(day).alias("batch"), "sketch")
    return batches.append_batch(table, table.select("batch"), root, day)


def read_days(spark: SparkSession, root: str) -> DataFrame:
    """Sketches `(batch, sketch)` of all published days."""
    return batches.read_rows(spark, root, DAY_SKETCH)
