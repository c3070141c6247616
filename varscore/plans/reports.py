"""Reports of the calibrators and of both evaluations, as they are written to files: one row, with the thresholds, the
targets that were asked for and sections of metrics. `write_report` writes any of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.operators.calibrate import calibrate_by_precision, calibrate_by_specificity, calibrate_three_class
from varscore.operators.evaluate import evaluate_binary, evaluate_three_class, nested_three_class


def _rest(df: DataFrame, *left_out):
    return F.struct(*[c for c in df.columns if c not in left_out]).alias("metrics")


def specificity_report(train: DataFrame, specificity: float = 0.95) -> DataFrame:
    """Threshold in raw scale and in the scale of `x`, the target, and what was reached."""
    found = calibrate_by_specificity(train, specificity)
    return found.select(
        (F.lit(0.0) - F.col("calibrated_threshold")).alias("threshold"),
        F.col("calibrated_threshold").alias("threshold_negated"),
        F.lit(specificity).alias("specificity"),
        _rest(found, "calibrated_threshold"),
    )


def three_class_report(train: DataFrame, specificity: float = 0.95, specificity_b: float = 0.95) -> DataFrame:
    """Both thresholds of the specificity calibration for three classes, their targets, and what was reached."""
    found = calibrate_three_class(train, specificity, specificity_b)
    return found.select(
        "p_threshold",
        "b_threshold",
        F.lit(specificity).alias("specificity"),
        F.lit(specificity_b).alias("specificity_b"),
        _rest(found, "p_threshold", "b_threshold"),
    )


def precision_report(train: DataFrame, ppv: float = 0.90, npv: float = 0.90) -> DataFrame:
    """Both thresholds of the precision calibration, their targets, and what was reached."""
    found = calibrate_by_precision(train, ppv, npv)
    return found.select(
        "p_threshold",
        "b_threshold",
        F.lit(ppv).alias("ppv_target"),
        F.lit(npv).alias("npv_target"),
        _rest(found, "p_threshold", "b_threshold"),
    )


def binary_evaluation_report(test: DataFrame, threshold: float) -> DataFrame:
    """The raw threshold and the metrics of the two-class evaluation."""
    found = evaluate_binary(test, threshold)
    return found.select(F.lit(float(threshold)).alias("threshold"), _rest(found))


def three_class_evaluation_report(test: DataFrame, p_threshold: float, b_threshold: float) -> DataFrame:
    """The thresholds and the five sections of the three-class evaluation."""
    found = nested_three_class(evaluate_three_class(test, p_threshold, b_threshold))
    return found.select(F.lit(float(p_threshold)).alias("p_threshold"), F.lit(float(b_threshold)).alias("b_threshold"), "*")
