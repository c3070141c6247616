"""Merged quantile sketches against exact ranks."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from varscore.operators import sketches

QUANTILES = [0.0, 0.05, 0.2, 0.5, 0.8, 0.99, 1.0]


def off(values, q, found):
    """How far the ranks of `found` are from `q`, as a share of all values."""
    low, high = bisect.bisect_left(values, found) / len(values), bisect.bisect_right(values, found) / len(values)
    return max(0.0, low - q, q - high)


@pytest.mark.parametrize("shape", ["even", "ties", "skewed", "sorted"])
def test_rank_error_of_merged_days(spark, shape):
    rnd = random.Random(shape)
    make = {"even": rnd.random, "ties": lambda: float(rnd.randrange(5)), "skewed": lambda: rnd.random() ** 9, "sorted": iter(map(float, range(60_000))).__next__}[shape]
    values = [make() for _ in range(60_000)]
    days = spark.createDataFrame([(0 if i % 3 == 0 else i % 20, v) for i, v in enumerate(values)], "day int, x double")
    row = sketches.sketched_percentiles(sketches.sketches(days, ["day"], k=200), QUANTILES).first()
    values.sort()
    assert row.n == len(values) and (row.q0, row.q6) == (values[0], values[-1])
    assert all(off(values, q, row[f"q{i}"]) <= 2 * sketches.rank_error(200) for i, q in enumerate(QUANTILES))


def test_small_groups_are_exact_and_nulls_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), ("b", None), (None, 2.0)], "g string, x double")
    got = {r.g: (r.n, r.q0, r.q1) for r in sketches.sketched_percentiles(sketches.sketches(df, ["g"]), [0.0, 1.0], ["g"]).collect()}
    assert got == {"a": (2, 1.0, 3.0), "b": (0, None, None), None: (1, 2.0, 2.0)}
    none = sketches.sketched_percentiles(sketches.sketches(df.limit(0), []), [0.5]).collect()
    assert [tuple(r) for r in none] == [(0, None)]


def test_days_are_added_once(spark, tmp_path):
    root = str(tmp_path / "days")
    days = [spark.range(i * 100, i * 100 + 100).select(F.col("id").cast("double").alias("x")) for i in range(3)]
    assert [sketches.append_day(d, root, f"day{i}") for i, d in enumerate(days)] == [True] * 3
    assert not sketches.append_day(days[0], root, "day0")
    row = sketches.sketched_percentiles(sketches.read_days(spark, root), [0.0, 0.5, 1.0]).first()
    assert (row.n, row.q0, row.q2) == (300, 0.0, 299.0) and abs(row.q1 - 150) <= 2
