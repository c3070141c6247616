import random

from pyspark.sql import functions as F

from varscore.functions.info import score_text


def test_score_text_at_midpoints(spark):
    """Values on and beside midpoints, which the shortest decimal form does not decide; no lambda, which would be interpreted."""
    rng = random.Random(5)
    values = [(2 * rng.randrange(20_000) + 1) / 20_000 + rng.choice([0, 0, 3, 1e5, 1e9]) for _ in range(4000)]
    values += [k / 2**p for p in (6, 13, 17, 30) for k in (1, 3, 5, 2**p - 1)] + [rng.randrange(10**7) / 10**5 for _ in range(4000)]
    values += [v * (1 + s * 2.0**-52) for v in values[:2000] for s in (-1, 1)] + [5e-324, 1 - 2.0**-53, 2.0**52 + 0.5, 9.1e18]
    values = [v * rng.choice([1, -1]) for v in values] + [-0.0, 0.0, 1e19, -1e300, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", score_text(F.col("v")).alias("t"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        large = r["v"] is not None and abs(r["v"]) >= 9.2e18  # printed by the built-in formatter
        assert r["t"] == ("null" if r["v"] is None else r["t"] if large else f"{r['v']:.4f}") is not None
