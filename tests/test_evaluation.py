import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from varscore.operators import calibrate, clinvar, curves, evaluate
from varscore.operators.split import stratified_split


def labelled(spark, seed, n=400, levels=60, shift=0.8):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = np.round((rng.normal(0, 1, n) + shift * y) * levels / 8) / 4
    return x, y, spark.createDataFrame([(float(a), int(b), -float(a)) for a, b in zip(x, y)], "x double, y int, score double")


def roc(x, y, drop=True):
    """The curve by brute force: distinct scores from the top, collinear inner points left out."""
    levels = np.unique(x)[::-1]
    tps = np.array([((x >= t) & (y == 1)).sum() for t in levels])
    fps = np.array([((x >= t) & (y == 0)).sum() for t in levels])
    if drop and len(levels) > 2:
        keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
        levels, tps, fps = levels[keep], tps[keep], fps[keep]
    return np.r_[np.inf, levels], np.r_[0, tps] / (y == 1).sum(), np.r_[0, fps] / (y == 0).sum()


@pytest.mark.parametrize("seed,levels,ranges", [(1, 60, 7), (2, 4, 3), (3, 400, 1)])
def test_curve_and_auc(spark, seed, levels, ranges):
    x, y, df = labelled(spark, seed, levels=levels)
    points = curves.curve_points(df, ranges=ranges)
    for drop in (True, False):
        t, tpr, fpr = roc(x, y, drop)
        got = sorted(map(tuple, curves.roc_from_points(points, drop).collect()), reverse=True)
        assert [g[0] for g in got] == list(t)
        assert np.array_equal([g[1] for g in got], tpr) and np.array_equal([g[2] for g in got], fpr)
    t, tpr, fpr = roc(x, y, False)
    assert np.isclose(curves.auc_from_points(points).first()[0], np.trapezoid(tpr, fpr))
    q = [0.0, 0.15, 0.5, 0.85, 1.0]
    assert np.allclose(curves.percentiles_from_points(points, q).first(), np.percentile(x, np.array(q) * 100))


@pytest.mark.parametrize("seed,shift", [(5, 0.8), (6, 0.0), (7, 3.0), (8, -1.5)])
def test_calibrators(spark, seed, shift):
    x, y, df = labelled(spark, seed, shift=shift)
    t, tpr, fpr = roc(x, y)
    spec = 1 - fpr
    i = np.argmin(np.abs(spec - 0.95))
    assert tuple(calibrate.calibrate_by_specificity(df).first()) == (0.95, t[i], spec[i], tpr[i])
    i = np.argmax(tpr - fpr)
    assert tuple(calibrate.calibrate_by_youden(df).first()) == ("youden", t[i], tpr[i], spec[i])



@pytest.mark.parametrize("seed,shift", [(5, 0.8), (6, 0.0), (7, 3.0), (8, -1.5)])
def test_three_class_calibrator(spark, seed, shift):
    """Each side's threshold by its definition: count the calls of every candidate and take the best."""
    x, y, df = labelled(spark, seed, shift=shift)

    def cell(t):
        called = [v >= t for v in x]
        hits = sum(c for c, label in zip(called, y) if label == 1) / sum(y == 1)
        return {"t": t, "sensitivity": hits, "specificity": 1 - sum(c for c, label in zip(called, y) if label == 0) / sum(y == 0)}

    cells = [cell(t) for t in roc(x, y)[0]]
    middle = np.median(x)
    strict = [c for c in cells if c["t"] >= middle and c["specificity"] >= 0.98]
    p = max(strict, key=lambda c: (c["sensitivity"], c["t"]))
    b = min((c for c in cells if c["t"] <= middle), key=lambda c: (abs(c["specificity"] - 0.95), -c["t"]))
    crossed = p["t"] <= b["t"]
    limits = np.percentile(x, [85, 15]) if crossed else np.array([p["t"], b["t"]])
    got = calibrate.calibrate_three_class(df).first()
    assert np.allclose((got.p_actual_specificity, got.p_sensitivity), (p["specificity"], p["sensitivity"]))
    assert np.allclose((got.b_actual_specificity, got.b_sensitivity), (b["specificity"], b["sensitivity"]))
    assert np.allclose((got.p_threshold, got.b_threshold), -limits) and got.adjusted == crossed


@pytest.mark.parametrize("seed,shift,ppv_t,npv_t", [(5, 0.8, 0.9, 0.9), (6, 0.0, 0.9, 0.9), (7, 3.0, 0.95, 0.95), (9, 0.5, 1.1, 1.1)])
def test_precision_calibrator(spark, seed, shift, ppv_t, npv_t):
    x, y, df = labelled(spark, seed, shift=shift)
    above = {t: np.mean(y[x >= t] == 1) for t in set(x)}
    below = {t: np.mean(y[x <= t] == 0) for t in set(x)}
    # The widest class that meets its target; where none does, the purest, and of equally pure ones the narrowest.
    p = min((t for t in above if above[t] >= ppv_t), default=max(above, key=lambda t: (above[t], t)))
    b = max((t for t in below if below[t] >= npv_t), default=max(below, key=lambda t: (below[t], -t)))
    crossed = p <= b
    limits = np.percentile(x, [80, 20]) if crossed else np.array([p, b])
    got = calibrate.calibrate_by_precision(df, ppv_t, npv_t).first()
    assert np.allclose((got.actual_ppv, got.actual_npv), (above[p], below[b]))
    assert np.allclose((got.p_threshold, got.b_threshold), -limits) and got.adjusted == crossed


def test_evaluators(spark):
    x, y, df = labelled(spark, 11)
    got = evaluate.evaluate_binary(df, -1.0).first()
    pred = x > 1.0
    assert (got.tp, got.fp) == ((pred & (y == 1)).sum(), (pred & (y == 0)).sum())
    assert np.isclose(got.sensitivity, got.tp / (y == 1).sum())
    # Overlapping thresholds: benign is decided first.
    three = evaluate.predict_three(df, 0.0, -1.0)
    assert rows(three.select("score", "prediction").distinct()) == sorted(
        {(-a, 0 if a < 1.0 else 1) for a in x.tolist()}, key=repr
    )
    report = evaluate.evaluate_three_class(df, -1.0, 0.5)
    nested = evaluate.nested_three_class(report).first()
    assert nested.predictions.predicted_P == (x > 1.0).sum() and nested.totals.total_P == (y == 1).sum()
    with pytest.raises(ValueError):
        evaluate.evaluate_binary(df, None)


def test_single_class_gives_zeros_not_errors(spark):
    df = spark.createDataFrame([(1.0, 1, -1.0), (2.0, 1, -2.0)], "x double, y int, score double")
    got = evaluate.evaluate_binary(df, -1.5).first()
    assert (got.tp, got.fn, got.tn, got.fp, got.specificity, got.auc) == (1, 1, 0, 0, 0.0, None)
    assert evaluate.evaluate_three_class(df, -1.5, -1.2).first().NPV_B == 0.0


def expected_train(counts, test_size):
    n = sum(counts)
    train = n - int(np.ceil(test_size * n))
    floors = [c * train // n for c in counts]
    rest = [c * train % n for c in counts]
    for i in sorted(range(len(counts)), key=lambda i: (-rest[i], i))[: train - sum(floors)]:
        floors[i] += 1
    return floors


@pytest.mark.parametrize("n0,n1,test_size", [(41, 18, 0.8), (7, 3, 0.7), (100, 1, 0.5), (1, 1, 0.5), (50, 50, 1 / 3)])
def test_split_counts(spark, n0, n1, test_size):
    df = spark.createDataFrame([(i, int(i >= n0)) for i in range(n0 + n1)], "id int, y int")
    split = stratified_split(df, test_size)
    assert rows(split.select("id", "y")) == rows(df)
    counts = {(r.y, r.split): r.n for r in split.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert [counts.get((y, "train"), 0) for y in (0, 1)] == expected_train([n0, n1], test_size)


def test_split_divides_a_large_group_of_copies(spark):
    df = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS id", "cast(id % 3 = 0 AS int) AS y")
    split = stratified_split(df, 0.8).cache()
    assert rows(split.select("id", "y")) == rows(df)
    counts = {(r.y, r.split): r.n for r in split.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, "train"): 120, (0, "test"): 480, (1, "train"): 60, (1, "test"): 240}
    assert rows(stratified_split(df.repartition(3), 0.8)) == rows(split)


def test_split_keeps_rows_whose_joined_texts_agree(spark):
    data = [("a|b", "c", 0), ("a", "b|c", 0), ("1:a", None, 0), (None, "1:a", 0), ("\\N", "", 0), (None, "", 0)] * 3
    df = spark.createDataFrame(data, "a string, b string, y int")
    split = stratified_split(df, 0.5)
    assert rows(split.select("a", "b", "y")) == rows(df)
    assert split.where("split = 'train'").count() == 9


def test_zero_score_gives_no_negative_zero(spark):
    df = clinvar.with_x(spark.createDataFrame([(0.0,)], "score double"))
    assert str(df.first().x) == "0.0"
