"""Helpers shared by the operators of this subpackage: names, written tables, ranks, components, word caches."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varscore.runtime import BROADCAST_BYTES, measured_bytes, scratch_path

#: Largest number of words held by one generation of a word cache (two generations live in a worker).
CACHE_WORDS = 250_000


def col(name):
    """A column by its exact name, also when the name holds dots."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until it clashes with no column of `df` (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Only `id` and `text`, so that no other column of the input can clash with the columns of an operator."""
    return df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder: computed once, safe from lost executors, without a
    known partitioning, so that skewed joins on it can still be split at run time."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """A join side, with a hint to broadcast it if its measured size allows that; otherwise both sides are shuffled."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: str, order: list, rank: str, cell_bits=10) -> DataFrame:
    """Add `rank`: 0, 1, ... within each `group` in ascending `order`, whose first column is a uniform 64-bit hash.

    A group is cut into 2^cell_bits ranges of the hash. Cells are ranked on their own, and the counts of the cells
    before (one row per cell) are added, so no group is ever ordered in one task. Ties get any order among themselves.
    """
    cell, before, n, g, c = (fresh(df, name) for name in ("cell", "before", "n", "g", "c"))
    df = df.withColumn(cell, F.shiftright(F.col(order[0]), 64 - cell_bits))
    counts = df.groupBy(group, cell).agg(F.count("*").alias(n))
    w = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias(g), F.col(cell).alias(c), F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before))
    counts = small_or_shuffled(counts)
    local = df.withColumn(rank, F.row_number().over(Window.partitionBy(group, cell).orderBy(*order)) - 1)
    joined = local.join(counts, F.col(group).eqNullSafe(F.col(g)) & (F.col(cell) == F.col(c)))
    return joined.withColumn(rank, (F.col(rank) + F.col(before)).cast("long")).drop(cell, before, g, c)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): rows (node, root), `root` the smallest node; no row for a root.

    Alternating large and small stars: every round rewires all neighbours of a node to the smallest one, until nothing
    changes (a logarithmic number of rounds). Only links are shuffled; minima are pre-aggregated.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def texts_of(column: pa.Array) -> list:
    """The UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def values_of(column: pa.Array) -> list:
    """The bytes of each value of a binary Arrow array without nulls; much faster than `to_pylist`."""
    return column.to_numpy(zero_copy_only=False).tolist()


class WordCache:
    """Values of words, kept in two generations: when the young one is full it becomes the old one.

    Words in use move back to the young generation, so the memory is bounded and frequent words stay.
    """

    def __init__(self, compute, limit=CACHE_WORDS):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def values(self, words: list) -> list:
        """The values of the words, one lookup for each that is known."""
        found = list(map(self.young.get, words))
        if None not in found:
            return found
        new = list(dict.fromkeys(w for w, v in zip(words, found) if v is None))
        if len(self.young) + len(new) > self.limit and self.young:
            self.old, self.young = self.young, {}
            new = list(dict.fromkeys(words))
        fetched = dict(zip(new, map(self.old.get, new)))
        missing = [w for w, v in fetched.items() if v is None]
        if missing:
            fetched.update(zip(missing, self.compute(missing)))
        self.young.update(fetched)
        return list(map(self.young.__getitem__, words))


def pieces_by_bytes(sizes, limit):
    """Consecutive ranges [a, b) of items whose sizes sum to `limit` at most (one item at least)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
