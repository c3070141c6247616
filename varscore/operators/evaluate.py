"""Predictions and evaluation reports.

A report goes through the rows once: they are counted by score and label, and the counts of the predictions and the area under
the curve are both taken from the counted rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscore.operators.clinvar import with_x
from varscore.operators.curves import roc_auc, rows_where, safe_ratio
from varscore.runtime import stored


def _column(value) -> Column:
    if value is None:
        raise ValueError("a threshold is required")
    return value if isinstance(value, Column) else F.lit(float(value))


def predict_binary(df: DataFrame, threshold, positive_when: str = "lt", on: str = "score") -> DataFrame:
    """Add `prediction`: 1 below the threshold (`lt`, raw scores) or above it (`gt`)."""
    if positive_when not in ("lt", "gt"):
        raise ValueError("positive_when is 'lt' or 'gt'")
    limit = _column(threshold)
    positive = F.col(on) < limit if positive_when == "lt" else F.col(on) > limit
    return df.withColumn("prediction", positive.cast("int"))


def predict_three(df: DataFrame, p_threshold, b_threshold) -> DataFrame:
    """Add `prediction`: 1 pathogenic, 0 benign, -1 uncertain. Thresholds are in raw score scale; where they
    overlap, benign is decided first."""
    x = F.lit(0.0) - F.col("score")
    p, b = F.lit(0.0) - _column(p_threshold), F.lit(0.0) - _column(b_threshold)
    return df.withColumn("prediction", F.when(x < b, 0).when(x > p, 1).otherwise(-1))


def _counted(df: DataFrame, *columns) -> DataFrame:
    """The rows counted by the given columns and the label, as `n`, and kept."""
    return stored(df.groupBy(*dict.fromkeys([*columns, "y"])).agg(F.count(F.lit(1)).alias("n")), "counted")


def confusion(df: DataFrame, n: str | None = None) -> DataFrame:
    """tn, fp, fn, tp of `prediction` against `y`; a class that never occurs counts 0. `n`: see `curve_points`."""

    def cell(y, prediction):
        return rows_where((F.col("y") == y) & (F.col("prediction") == prediction), n)

    return df.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def evaluate_binary(df: DataFrame, threshold, positive_when: str = "lt", on: str = "score") -> DataFrame:
    """AUC, sensitivity, specificity, precision, NPV and the confusion counts, in one row."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    counted = _counted(df, "score", on)
    return confusion(predict_binary(counted, threshold, positive_when, on), "n").select(
        roc_auc(with_x(counted), n="n").scalar().alias("auc"),
        safe_ratio(tp, tp + fn).alias("sensitivity"),
        safe_ratio(tn, tn + fp).alias("specificity"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tn, tn + fn).alias("npv"),
        "tp",
        "tn",
        "fp",
        "fn",
    )


def evaluate_three_class(df: DataFrame, p_threshold, b_threshold) -> DataFrame:
    """The three-class report as one flat row; `nested_three_class` gives its nested form."""

    def cell(prediction, y=None):
        condition = F.col("prediction") == prediction
        return rows_where(condition if y is None else condition & (F.col("y") == y), "n")

    counted = _counted(df, "score")
    counts = predict_three(counted, p_threshold, b_threshold).agg(
        cell(1).alias("predicted_P"),
        cell(0).alias("predicted_B"),
        cell(-1).alias("VUS"),
        cell(1, 1).alias("true_P_predicted_P"),
        cell(-1, 1).alias("true_P_in_VUS"),
        cell(0, 0).alias("true_B_predicted_B"),
        cell(-1, 0).alias("true_B_in_VUS"),
        rows_where(F.col("y") == 1, "n").alias("total_P"),
        rows_where(F.col("y") == 0, "n").alias("total_B"),
    )
    c = {name: F.col(name) for name in counts.columns}
    return counts.select(
        _column(p_threshold).alias("p_threshold"),
        _column(b_threshold).alias("b_threshold"),
        *counts.columns[:7],
        roc_auc(with_x(counted), n="n").scalar().alias("AUC"),
        safe_ratio(c["true_P_predicted_P"], c["predicted_P"]).alias("PPV_P"),
        safe_ratio(c["true_B_predicted_B"], c["predicted_B"]).alias("NPV_B"),
        safe_ratio(c["true_P_predicted_P"], c["total_P"]).alias("sensitivity_P"),
        safe_ratio(c["true_B_predicted_B"], c["total_B"]).alias("specificity_B"),
        safe_ratio(c["predicted_P"], c["total_P"]).alias("coverage_P"),
        safe_ratio(c["predicted_B"], c["total_B"]).alias("coverage_B"),
        "total_P",
        "total_B",
    )


_REPORT = {
    "thresholds": ("p_threshold", "b_threshold"),
    "predictions": ("predicted_P", "predicted_B", "VUS"),
    "true_labels_in_prediction": (
        "true_P_predicted_P",
        "true_P_in_VUS",
        "true_B_predicted_B",
        "true_B_in_VUS",
    ),
    "performance": ("AUC", "PPV_P", "NPV_B", "sensitivity_P", "specificity_B", "coverage_P", "coverage_B"),
    "totals": ("total_P", "total_B"),
}


def nested_three_class(report: DataFrame) -> DataFrame:
    """The flat three-class report grouped into its five sections."""
    return report.select(*[F.struct(*names).alias(section) for section, names in _REPORT.items()])
