"""Reference sequence text, read line by line in parallel and cut into fixed chunks.

A contig may be hundreds of megabytes long, so it is never held in one row. Every text split is a contiguous
piece of its file: lines are placed inside their split by a running sum, and a small table of one row per split
carries the open contig and its length across split borders.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varscore.runtime import checkpointed
from varscore.sources.members import read_members

CHUNK_BASES = 10_000


def place_lines(lines: DataFrame) -> DataFrame:
    """Lines `(file, split, line, value)` -> sequence pieces `(contig, start, seq)`, `start` 0-based.

    `split` orders the pieces of a file, `line` the lines of a split.
    """
    is_header = F.startswith("value", F.lit(">"))
    here = Window.partitionBy("file", "split").orderBy("line")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns(
        {
            "name": F.when(is_header, F.regexp_extract("value", r"^>(\S*)", 1)),
            "size": F.when(is_header, 0).otherwise(F.length(F.trim("value"))).cast("long"),
        }
    )
    inside = marked.withColumns(
        {
            "total": F.coalesce(F.sum("size").over(before), F.lit(0)),
            "contig": F.last("name", ignorenulls=True).over(here),
        }
    ).withColumn(
        "base", F.last(F.when(F.col("name").isNotNull(), F.col("total")), ignorenulls=True).over(here)
    )

    # One row per split: the contig left open at its end, and how many bases follow the last header.
    tails = inside.groupBy("file", "split").agg(
        F.max_by("contig", "line").alias("open"),
        (F.max(F.col("total") + F.col("size")) - F.coalesce(F.max("base"), F.lit(0))).alias("tail"),
    )
    order = Window.partitionBy("file").orderBy("split")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tails.withColumn("segment", F.count("open").over(order))
        .withColumn(
            "sum_in_segment",
            F.sum("tail").over(
                Window.partitionBy("file", "segment").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .select(
            "file",
            "split",
            F.last("open", ignorenulls=True).over(prior).alias("carry_contig"),
            F.lag("sum_in_segment").over(order).alias("carry_bases"),
        )
    )
    placed = inside.join(carried, ["file", "split"]).where(F.col("name").isNull() & (F.col("size") > 0))
    start = F.when(F.col("contig").isNotNull(), F.col("total") - F.col("base")).otherwise(
        F.col("carry_bases") + F.col("total")
    )
    return placed.select(
        F.coalesce("contig", "carry_contig").alias("contig"), start.alias("start"), F.trim("value").alias("seq")
    ).where(F.col("contig").isNotNull())


def chunk_sequence(pieces: DataFrame, bases: int = CHUNK_BASES) -> DataFrame:
    """Pieces `(contig, start, seq)` -> chunks `(contig, bin, chunk)`: bin `b` holds bases b*size ... ."""
    first = F.floor(F.col("start") / bases)
    last = F.floor((F.col("start") + F.length("seq") - 1) / bases)
    cut = pieces.select("*", F.explode(F.sequence(first, last)).alias("bin"))
    lo = F.greatest(F.col("bin") * bases - F.col("start"), F.lit(0))
    hi = F.least((F.col("bin") + 1) * bases - F.col("start"), F.length("seq").cast("long"))
    parts = cut.select(
        "contig",
        "bin",
        F.struct(
            (F.col("start") + lo).alias("at"),
            F.substr("seq", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("text"),
        ).alias("part"),
    )
    # A chunk is at most `bases` long, whatever the length of its contig.
    return parts.groupBy("contig", "bin").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "").alias("chunk")
    )


def read_fasta(spark: SparkSession, path: str, bases: int = CHUNK_BASES) -> DataFrame:
    """Read FASTA text into `(contig, bin, chunk)`.

    Gzip files are read by their members where they have blocks; one without is read by one task, but its lines come in
    numbered blocks, so that it is placed block by block, not as a whole.
    """
    if path.endswith((".gz", ".bgz")):
        return chunk_sequence(place_lines(checkpointed(read_members(spark, path))), bases)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    # Line numbers come from the scan itself; fix them before they are used in several places.
    return chunk_sequence(place_lines(checkpointed(lines)), bases)
