"""Threshold curves over scored labels.

All curves start from `curve_points`: one row per distinct score with running totals from the highest score
down. A running total over an ordering without groups would put every row into one task; here the distinct
scores are range-partitioned, each range is summed on its own, and one row per range carries the sums across.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varscore.runtime import checkpointed


def rows_where(condition: Column, n: str | None = None) -> Column:
    """Number of rows under a condition; with `n`, of rows that stand for so many each."""
    return F.count_if(condition) if n is None else F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0))


def curve_points(df: DataFrame, x: str = "x", y: str = "y", ranges: int | None = None, n: str | None = None) -> DataFrame:
    """One row per distinct `x`: its positives and negatives, totals including it (`tp`, `fp`), the grand
    totals (`P`, `N`), whether it is the first or last point, and the counts of the next lower point.

    Rows whose label is not 0 or 1, or whose `x` is null or not a number, are left out. `n` names a column of counts, for
    rows that stand for several.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = (
        df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(y).isin(0, 1))
        .groupBy(F.col(x).alias("x"))
        .agg(rows_where(F.col(y) == 1, n).alias("pos"), rows_where(F.col(y) == 0, n).alias("neg"))
    )
    ranged = checkpointed(
        counted.repartitionByRange(ranges, F.desc("x")).withColumn("range", F.spark_partition_id())
    )
    across = Window.partitionBy(F.lit(1)).orderBy("range")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    # One row per range, so at most `ranges` rows.
    edges = (
        ranged.groupBy("range")
        .agg(
            F.sum("pos").alias("range_pos"),
            F.sum("neg").alias("range_neg"),
            F.max_by(F.struct("pos", "neg"), "x").alias("head"),
        )
        .select(
            "range",
            F.coalesce(F.sum("range_pos").over(earlier), F.lit(0)).alias("tp_before"),
            F.coalesce(F.sum("range_neg").over(earlier), F.lit(0)).alias("fp_before"),
            F.lead("head").over(across).alias("next_head"),
            F.sum("range_pos").over(whole).alias("P"),
            F.sum("range_neg").over(whole).alias("N"),
        )
    )
    down = Window.partitionBy("range").orderBy(F.desc("x"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.select(
        "*",
        F.sum("pos").over(upto).alias("tp_in"),
        F.sum("neg").over(upto).alias("fp_in"),
        F.lead(F.struct("pos", "neg")).over(down).alias("next_in"),
    )
    following = F.coalesce("next_in", "next_head")
    tp = F.col("tp_before") + F.col("tp_in")
    fp = F.col("fp_before") + F.col("fp_in")
    return inner.join(F.broadcast(edges), "range").select(
        "x",
        "pos",
        "neg",
        tp.alias("tp"),
        fp.alias("fp"),
        "P",
        "N",
        (tp + fp == F.col("pos") + F.col("neg")).alias("is_first"),
        following.isNull().alias("is_last"),
        following["pos"].alias("next_pos"),
        following["neg"].alias("next_neg"),
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null when the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; 0 when the whole is 0."""
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def roc_from_points(points: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """`(threshold, tpr, fpr)`, led by the point (infinity, 0, 0).

    `drop_intermediate` leaves out inner points that continue the line between their neighbours: those whose
    next step up the curve equals their own.
    """
    if drop_intermediate:
        bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        points = points.where(F.col("is_first") | F.col("is_last") | bends)
    here = F.struct(
        F.col("x").alias("threshold"),
        ratio(F.col("tp"), F.col("P")).alias("tpr"),
        ratio(F.col("fp"), F.col("N")).alias("fpr"),
    )
    start = F.struct(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    )
    rows = F.when(F.col("is_first"), F.array(start, here)).otherwise(F.array(here))
    return points.select(F.explode(rows).alias("point")).select("point.*")


def roc_curve(df: DataFrame, x: str = "x", y: str = "y", drop_intermediate: bool = True) -> DataFrame:
    return roc_from_points(curve_points(df, x, y), drop_intermediate)


def auc_from_points(points: DataFrame) -> DataFrame:
    """Area under the ROC curve in its rank form: pairs won plus half the pairs tied, in exact arithmetic."""
    wide = "decimal(19,0)"
    beaten = (F.col("N") - F.col("fp")).cast(wide) * 2 + F.col("neg").cast(wide)
    won = F.sum(F.col("pos").cast(wide) * beaten).cast("double")
    pairs = F.max("P").cast("double") * F.max("N").cast("double") * 2
    return points.agg(F.try_divide(won, pairs).alias("auc"))


def roc_auc(df: DataFrame, x: str = "x", y: str = "y", n: str | None = None) -> DataFrame:
    return auc_from_points(curve_points(df, x, y, n=n))


def pr_curve(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """`(threshold, precision, recall)` per distinct score, and the closing point (null, 1, 0)."""
    here = F.struct(
        F.col("x").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("P")).alias("recall"),
    )
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    rows = F.when(F.col("is_first"), F.array(here, end)).otherwise(F.array(here))
    return curve_points(df, x, y).select(F.explode(rows).alias("point")).select("point.*")


def ppv_from_points(points: DataFrame) -> DataFrame:
    """Running counts from the highest score down and the precision of calling everything so far positive."""
    return points.select("x", "tp", "fp", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"))


def npv_from_points(points: DataFrame) -> DataFrame:
    """Running counts from the lowest score up and the precision of calling everything so far negative."""
    counts = points.select(
        "x",
        (F.col("N") - F.col("fp") + F.col("neg")).alias("tn"),
        (F.col("P") - F.col("tp") + F.col("pos")).alias("fn"),
    )
    return counts.withColumn("npv", ratio(F.col("tn"), F.col("tn") + F.col("fn")))


def percentiles_from_points(points: DataFrame, quantiles) -> DataFrame:
    """Exact percentiles with linear interpolation, one row with columns q0, q1, ...

    A value's rows occupy a known stretch of ascending ranks, so each percentile is two conditional maxima;
    the built-in exact percentile would gather all distinct values in one buffer.
    """
    rows = F.col("P") + F.col("N")
    below = rows - F.col("tp") - F.col("fp")
    columns = []
    for i, q in enumerate(quantiles):
        place = (rows - 1).cast("double") * F.lit(float(q))
        low = F.max(F.when(below <= F.floor(place), F.col("x")))
        high = F.max(F.when(below <= F.ceil(place), F.col("x")))
        # The same place on every row; any aggregate returns it.
        columns.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"q{i}"))
    return points.agg(*columns)


def percentiles(df: DataFrame, quantiles, x: str = "x", y: str = "y") -> DataFrame:
    return percentiles_from_points(curve_points(df, x, y), quantiles)
