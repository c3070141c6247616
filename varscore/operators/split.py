"""Exact stratified train/test split without ranking all rows.

A row's place is decided by a hash of its content. Per label, the rows with the smallest hashes go to the train
part; the hash at which the exact count is reached is found by counting hash prefixes first and then ranking
the hashes of one prefix only. Rows with equal hashes are copies of each other and are kept as one counted row,
so neither a hot variant nor a large group of copies is ever sorted in one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varscore.runtime import checkpointed

PREFIX_DIGITS = 4
_COPIES_PER_BLOCK = 100_000


def train_counts(class_counts: DataFrame, label: str, test_size: float) -> DataFrame:
    """Rows per label that go to the train part; largest remainders fill up, the lower label first on ties."""
    everything = Window.partitionBy(F.lit(1))
    wide = "decimal(38,0)"
    n = F.sum("n").over(everything)
    sized = class_counts.withColumn("total", n).withColumn(
        "n_train", F.col("total") - F.ceil(F.lit(test_size) * F.col("total"))
    )
    product = F.col("n").cast(wide) * F.col("n_train").cast(wide)
    shares = sized.withColumn("share", F.floor(product / F.col("total")).cast("long")).withColumn(
        "rest", (product % F.col("total")).cast("long")
    )
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), F.col(label)))
    missing = F.col("n_train") - F.sum("share").over(everything)
    return shares.select(label, (F.col("share") + F.when(place <= missing, 1).otherwise(0)).alias("k"))


def content_hash(fields, seed: int):
    """md5 over the seed and the texts of all columns, each behind its length, so only equal rows give equal hashes.

    Nested values go in as JSON and binary ones as hexadecimal text.
    """

    def measured(field):
        kind, column = field.dataType.typeName(), F.col(field.name)
        if kind in ("array", "map", "struct"):
            text = F.when(column.isNotNull(), F.to_json(F.struct(column)))
        else:
            text = F.hex(column) if kind == "binary" else column.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(F.lit(f"{seed};"), *[measured(f) for f in fields]))


def stratified_split(df: DataFrame, test_size: float = 0.8, seed: int = 42, label: str = "y") -> DataFrame:
    """Add `split` ('train' / 'test') with exact per-label counts."""
    keyed = checkpointed(df.withColumn("_hash", content_hash(df.schema.fields, seed)))

    prefix = F.substring("_hash", 1, PREFIX_DIGITS)
    by_prefix = keyed.groupBy(label, prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    wanted = train_counts(by_prefix.groupBy(label).agg(F.sum("n").alias("n")), label, test_size)
    # At most 16^PREFIX_DIGITS rows per label.
    up_to = Window.partitionBy(label).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    border = (
        by_prefix.withColumn("upto", F.sum("n").over(up_to))
        .join(F.broadcast(wanted), label)
        .where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        .select(label, "prefix", (F.col("k") - F.col("upto") + F.col("n")).alias("k"))
    )
    # Hashes of the one prefix per label in which the count is reached; copies are already collapsed.
    inside = (
        keyed.withColumn("prefix", prefix)
        .join(F.broadcast(border), [label, "prefix"])
        .groupBy(label, "_hash", "k")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    upto_hash = Window.partitionBy(label).orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        inside.withColumn("upto", F.sum("copies").over(upto_hash))
        .where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("copies") < F.col("k")))
        .select(
            label,
            F.col("_hash").alias("cut"),
            (F.col("k") - F.col("upto") + F.col("copies")).alias("into_train"),
            "copies",
        )
    )
    # One row per label: a label without a cut sends no row to the train part.
    cuts = F.broadcast(checkpointed(cuts))
    placed = keyed.join(cuts, label, "left")
    undivided = F.col("cut").isNull() | (F.col("_hash") != F.col("cut")) | (F.col("into_train") == F.col("copies"))
    in_train = F.coalesce(F.col("_hash") <= F.col("cut"), F.lit(False))
    part = F.when(in_train, "train").otherwise("test").alias("split")
    whole = placed.where(undivided).select(*df.columns, part)
    return whole.unionByName(_divided_copies(placed.where(~undivided), df.columns, label))


def _divided_copies(rows: DataFrame, columns, label: str) -> DataFrame:
    """The one group of copies per label that the cut divides, rebuilt from a counted row in blocks."""
    one = rows.groupBy(label, "into_train", "copies").agg(F.first(F.struct(*columns)).alias("row"))
    parts = one.select(
        "row",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("split"), F.col("into_train").alias("n")),
                F.struct(F.lit("test").alias("split"), (F.col("copies") - F.col("into_train")).alias("n")),
            )
        ).alias("part"),
    ).select("row", "part.split", "part.n")
    last_block = F.floor((F.col("n") - 1) / _COPIES_PER_BLOCK)
    blocks = parts.select("row", "split", "n", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block"))
    size = F.least(F.col("n") - F.col("block") * _COPIES_PER_BLOCK, F.lit(_COPIES_PER_BLOCK))
    copies = blocks.select("row", "split", F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("copy"))
    return copies.select("row.*", "split")
