"""End-to-end evaluation: filter, score, split, calibrate on the train part, evaluate on the test part."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.operators.calibrate import calibrate_by_precision, calibrate_by_specificity
from varscore.operators.clinvar import filter_clinvar, with_label, with_x
from varscore.operators.evaluate import evaluate_binary, evaluate_three_class
from varscore.operators.lookup import score_variants
from varscore.operators.split import stratified_split
from varscore.runtime import checkpointed

COLUMNS = ["CHROM", "POS", "REF", "ALT", "CLNSIG", "score"]


def scored_labels(body: DataFrame, scores: DataFrame, min_stars: int = 1) -> DataFrame:
    """Filtered variants with a score, a label `y` and `x`. The narrow rows are kept: they are read twice, and parsed once."""
    kept = checkpointed(filter_clinvar(body, min_stars=min_stars).select("CHROM", "POS", "REF", "ALT", "CLNSIG"))
    return with_label(score_variants(kept, scores).where(F.col("score").isNotNull()).select(*COLUMNS))


def split_labels(body, scores, min_stars=1, test_size=0.8, seed=42) -> DataFrame:
    """Scored labels with their `split`, materialised because train and test are used several times."""
    return checkpointed(stratified_split(scored_labels(body, scores, min_stars), test_size, seed))


def _part(split, name):
    return with_x(split.where(F.col("split") == name))


def run_benchmark(
    body: DataFrame,
    scores: DataFrame,
    min_stars: int = 1,
    test_size: float = 0.8,
    target_specificity: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Two-class evaluation as one flat row: parameters, calibration and test metrics."""
    split = split_labels(body, scores, min_stars, test_size, seed)
    train, test = _part(split, "train"), _part(split, "test")
    calibrated = checkpointed(calibrate_by_specificity(train, target_specificity))
    threshold = calibrated.select("calibrated_threshold").scalar()
    report = evaluate_binary(test, threshold, positive_when="gt", on="x")
    return report.select(
        F.lit(min_stars).alias("min_stars"),
        F.lit(test_size).alias("test_size"),
        F.lit(target_specificity).alias("target_specificity"),
        train.agg(F.count(F.lit(1))).scalar().alias("n_train"),
        (F.lit(0.0) - threshold).alias("threshold"),
        calibrated.select("actual_specificity").scalar().alias("actual_specificity"),
        calibrated.select("sensitivity_at_threshold").scalar().alias("sensitivity_at_threshold"),
        test.agg(F.count(F.lit(1))).scalar().alias("n_test"),
        *report.columns,
    )


def run_benchmark_three(
    body: DataFrame,
    scores: DataFrame,
    min_stars: int = 1,
    test_size: float = 0.8,
    target_ppv: float = 0.95,
    target_npv: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Three-class evaluation with precision-calibrated thresholds, as one flat row."""
    split = split_labels(body, scores, min_stars, test_size, seed)
    limits = checkpointed(calibrate_by_precision(_part(split, "train"), target_ppv, target_npv))
    return evaluate_three_class(
        _part(split, "test"), limits.select("p_threshold").scalar(), limits.select("b_threshold").scalar()
    )


def predictions(split: DataFrame) -> DataFrame:
    """The test part with each row's own label."""
    return split.where(F.col("split") == "test").select(*COLUMNS, "y")
