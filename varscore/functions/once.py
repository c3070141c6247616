"""Evaluate expensive columns and intermediate values once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, **columns) -> DataFrame:
    """Add columns that later filters and projections use by value.

    The optimizer copies a projected expression into every filter above it, so a parsed field would be parsed
    again for each use. A one-element generator ends that: what it yields is computed once.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """As `evaluate_once` for one column, by a generator that stays in the generated code of the steps around it: cheaper
    where many small rows pass."""
    return df.select(*[F.col(c) for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
