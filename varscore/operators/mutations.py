"""Protein-space mutation tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore import schemas

INDEX = ["protein_id", "protein_pos", "alt_aa"]


def last_mutations(mutations: DataFrame, order_col: str) -> DataFrame:
    """The last score of each (protein, position, alternative)."""
    order = F.struct(F.col(order_col), F.col("score"))
    return mutations.groupBy(*INDEX).agg(F.max_by("score", order).alias("score"))


def query_mutation(mutations: DataFrame, protein_id: str, pos: int, alt_aa: str, order_col: str) -> DataFrame:
    """Score of one protein change, the last entry winning; no row when there is none."""
    match = (F.col("protein_id") == protein_id) & (F.col("protein_pos") == pos) & (F.col("alt_aa") == alt_aa)
    return last_mutations(mutations.where(match), order_col)


def upsert_mutations(base: DataFrame, new: DataFrame, order_col: str) -> DataFrame:
    """The index after adding rows: a new row replaces a base row of its key; within one side the last wins."""
    both = base.withColumn("added", F.lit(0)).unionByName(new.withColumn("added", F.lit(1)))
    order = F.struct("added", F.col(order_col), F.col("score"))
    return both.groupBy(*INDEX).agg(F.max_by("score", order).alias("score"))


def mutation_table(mutations: DataFrame) -> DataFrame:
    """The export columns of a mutation table, duplicates kept."""
    return mutations.select(*schemas.MUTATIONS.fieldNames())
