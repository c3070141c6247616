"""Joins against a side that holds each key once, safe for hot keys on the other side."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows; so there are at most 1/share hot keys.
HOT_SHARE = 1e-4
# Below this many rows a key is no burden for one task, whatever its share.
HOT_ROWS = 100_000


def key_counts(rows: DataFrame, on) -> DataFrame:
    """Distinct keys with their row counts. Copies of a key collapse before the shuffle."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows"))


def join_unique(
    rows: DataFrame, unique: DataFrame, on, counts: DataFrame, how: str = "inner", small: bool = False
) -> DataFrame:
    """Join `rows` with `unique`, which has at most one row per key.

    `counts` holds the rows' own key counts (materialised, it is read more than once). With `small` (a size the
    caller has measured) the unique side is broadcast. Otherwise the join is shuffled; when some keys hold more
    than HOT_SHARE of all rows, those keys (at most 1/HOT_SHARE, whatever the data) are joined by broadcast and
    only the other rows are shuffled, so no task receives a hot key whole.
    """
    if small:
        return rows.join(F.broadcast(unique), on, how)
    seen = counts.agg(F.sum("n_rows").alias("total"), F.max("n_rows").alias("most")).first()
    limit = max(HOT_ROWS, (seen["total"] or 0) * HOT_SHARE)
    if (seen["most"] or 0) <= limit:
        return rows.join(unique, on, how)
    hot = F.broadcast(counts.where(F.col("n_rows") > limit).select(*on))
    hot_side = F.broadcast(unique.join(hot, on, "left_semi"))
    hot_rows = rows.join(hot, on, "left_semi").join(hot_side, on, how)
    return hot_rows.unionByName(rows.join(hot, on, "left_anti").join(unique, on, how))
