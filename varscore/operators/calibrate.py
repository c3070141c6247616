"""Decision-threshold calibration. Each calibrator returns one row and sorts nothing: every choice is a
minimum or maximum over curve points, with the order of the curve as tie-break."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.operators.curves import (
    curve_points,
    npv_from_points,
    percentiles_from_points,
    ppv_from_points,
    roc_from_points,
)

_POINT = ("threshold", "tpr", "fpr")
_P_MARGIN = 0.03
_P_CEILING = 0.99


def _nearest(specificity: float):
    """The curve point whose specificity is nearest; the highest threshold wins a tie."""
    distance = F.abs(F.lit(1.0) - F.col("fpr") - F.lit(specificity))
    return F.min_by(F.struct(*_POINT), F.struct(distance, -F.col("threshold")))


def calibrate_by_specificity(df: DataFrame, target: float = 0.95) -> DataFrame:
    points = roc_from_points(curve_points(df))
    return points.agg(_nearest(target).alias("p")).select(
        F.lit(target).alias("target_specificity"),
        F.col("p.threshold").alias("calibrated_threshold"),
        (F.lit(1.0) - F.col("p.fpr")).alias("actual_specificity"),
        F.col("p.tpr").alias("sensitivity_at_threshold"),
    )


def calibrate_by_youden(df: DataFrame) -> DataFrame:
    """The point with the largest tpr - fpr; the highest threshold wins a tie."""
    points = roc_from_points(curve_points(df))
    best = F.max_by(F.struct(*_POINT), F.struct(F.col("tpr") - F.col("fpr"), F.col("threshold")))
    return points.agg(best.alias("p")).select(
        F.lit("youden").alias("method"),
        F.col("p.threshold").alias("threshold"),
        F.col("p.tpr").alias("sensitivity"),
        (F.lit(1.0) - F.col("p.fpr")).alias("specificity"),
    )


def calibrate_three_class(df: DataFrame, target: float = 0.95, target_b: float = 0.95) -> DataFrame:
    """Pathogenic and benign thresholds in raw score scale.

    Pathogenic side: highest sensitivity among points at or above the median whose specificity reaches the
    raised target. Benign side: specificity nearest its target among points at or below the median. When the
    two cross, the 85th and 15th percentiles of x take their place (`adjusted`).
    """
    points = curve_points(df)
    roc = roc_from_points(points)
    quantiles = percentiles_from_points(points, [0.5, 0.85, 0.15])
    median = quantiles.select("q0").scalar()
    p_target = min(target + _P_MARGIN, _P_CEILING)

    point = F.struct(*_POINT)
    high = F.col("threshold") >= median
    low = F.col("threshold") <= median
    reaches = high & (F.lit(1.0) - F.col("fpr") >= F.lit(p_target))

    def nearest_where(condition, specificity):
        distance = F.abs(F.lit(1.0) - F.col("fpr") - F.lit(specificity))
        return F.min_by(point, F.when(condition, F.struct(distance, -F.col("threshold"))))

    everywhere = F.lit(True)
    p_point = F.coalesce(
        F.max_by(point, F.when(reaches, F.struct("tpr", "threshold"))),
        nearest_where(high, p_target),
        nearest_where(everywhere, p_target),
    )
    b_point = F.coalesce(nearest_where(low, target_b), nearest_where(everywhere, target_b))
    chosen = roc.agg(p_point.alias("p"), b_point.alias("b"))
    # Raw scale is the negative of x, so "pathogenic at or above benign" reads the other way round here.
    adjusted = F.col("p.threshold") <= F.col("b.threshold")
    return chosen.select(
        F.lit(target).alias("target_specificity"),
        (F.lit(1.0) - F.col("p.fpr")).alias("p_actual_specificity"),
        F.col("p.tpr").alias("p_sensitivity"),
        F.lit(target_b).alias("target_specificity_b"),
        (F.lit(1.0) - F.col("b.fpr")).alias("b_actual_specificity"),
        F.col("b.tpr").alias("b_sensitivity"),
        (-F.when(adjusted, quantiles.select("q1").scalar()).otherwise(F.col("p.threshold"))).alias("p_threshold"),
        (-F.when(adjusted, quantiles.select("q2").scalar()).otherwise(F.col("b.threshold"))).alias("b_threshold"),
        adjusted.alias("adjusted"),
    )


def calibrate_by_precision(df: DataFrame, target_ppv: float = 0.90, target_npv: float = 0.90) -> DataFrame:
    """Sliding thresholds in raw score scale.

    From the top down, the last point whose PPV reaches its target; from the bottom up, the last point whose
    NPV does. A target that is never reached takes the best point, the first of the scan on ties. When the two
    cross, the 80th and 20th percentiles of x take their place (`adjusted`).
    """
    points = curve_points(df)
    quantiles = percentiles_from_points(points, [0.80, 0.20])
    ppv = F.struct("x", F.col("ppv").alias("value"))
    npv = F.struct("x", F.col("npv").alias("value"))
    p_side = ppv_from_points(points).agg(
        F.coalesce(
            F.min(F.when(F.col("ppv") >= F.lit(target_ppv), ppv)), F.max_by(ppv, F.struct("ppv", "x"))
        ).alias("p")
    )
    b_side = npv_from_points(points).agg(
        F.coalesce(
            F.max(F.when(F.col("npv") >= F.lit(target_npv), npv)), F.max_by(npv, F.struct("npv", -F.col("x")))
        ).alias("b")
    )
    chosen = p_side.select("p", b_side.scalar().alias("b"))
    adjusted = F.col("p.x") <= F.col("b.x")
    return chosen.select(
        F.lit("precision_sliding").alias("method"),
        F.lit(target_ppv).alias("target_ppv"),
        F.col("p.value").alias("actual_ppv"),
        F.lit(target_npv).alias("target_npv"),
        F.col("b.value").alias("actual_npv"),
        (-F.when(adjusted, quantiles.select("q0").scalar()).otherwise(F.col("p.x"))).alias("p_threshold"),
        (-F.when(adjusted, quantiles.select("q1").scalar()).otherwise(F.col("b.x"))).alias("b_threshold"),
        adjusted.alias("adjusted"),
    )
