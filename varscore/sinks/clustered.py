"""Score tables kept in the order of their keys, with a table of what each file holds.

Rows are dealt to files by ranges of (CHROM, POS) and sorted within each; `files` has one row for each file and contig in
it, with the least and the greatest position. Lookups read that table first and then only files that may hold a match.

Copies of one position may fill several files, so that no file grows with a hot one; each of them names the position in
its range and is read. Rows with a null in CHROM or POS are stored and never looked up. The file table is written last and
names the files of its own run only: a store that was broken off halfway ends with an error, not with fewer rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscore.functions.info import strip_chr
from varscore.operators import lookup

#: Positions that share a bin of a key-set lookup.
BIN = 1 << 16


def write_clustered(scores: DataFrame, path: str, n_files: int | None = None, mode="error") -> None:
    """Store `scores`, with all their columns, as `path/rows` and `path/files`."""
    spark, copy = scores.sparkSession, "_copy"
    while copy in scores.columns:
        copy += "_"
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scores.withColumn(copy, F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(n_files, "CHROM", "POS", copy).sortWithinPartitions("CHROM", "POS", "REF", "ALT")
    dealt.drop(copy).write.mode(mode).parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").select("CHROM", "POS", F.col("_metadata.file_name").alias("file"))
    spans = held.groupBy("file", "CHROM").agg(
        F.min("POS").alias("min_pos"), F.max("POS").alias("max_pos"), F.count(F.lit(1)).alias("n_rows")
    )
    spans.write.mode(mode).parquet(f"{path}/files")


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """`(file, CHROM, min_pos, max_pos, n_rows)`, one row for each file and contig in it."""
    return spark.read.parquet(f"{path}/files")


def read_clustered(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The rows of all files, or of those named by `wanted` (column `file`)."""
    rows = spark.read.parquet(f"{path}/rows")
    if wanted is None:
        return rows
    names = sorted(r.file for r in wanted.select("file").distinct().collect())  # at most one name per file
    if not names:
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(*[f"{path}/rows/{name}" for name in names])


def in_interval(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of a contig from `start` to `end`, both included."""
    files = file_table(spark, path).where((F.col("CHROM") == chrom) & (F.col("min_pos") <= end) & (F.col("max_pos") >= start))
    return read_clustered(spark, path, files).where((F.col("CHROM") == chrom) & F.col("POS").between(start, end))


def query_variant(spark: SparkSession, path: str, chrom: str, pos: int, ref: str, alt: str) -> DataFrame:
    """Exact point lookup."""
    return lookup.query_variant(in_interval(spark, path, chrom, pos, pos), chrom, pos, ref, alt)


def _bin(column):
    return F.floor(F.col(column) / F.lit(BIN))


def files_with(files: DataFrame, keys: DataFrame, normalize_chrom: bool = True) -> DataFrame:
    """The rows of the file table that may hold one of the keys.

    Keys are first reduced to the least and the greatest position of each bin, and files are spread over the bins that
    they cover, so both sides of the join are bounded by the number of bins and files, whatever the number of keys.
    """
    name = strip_chr(F.col("CHROM")) if normalize_chrom else F.col("CHROM")
    bins = keys.select(name.alias("CHROM"), "POS").groupBy("CHROM", _bin("POS").alias("bin"))
    wanted = bins.agg(F.min("POS").alias("first"), F.max("POS").alias("last"))
    covered = F.explode(F.sequence(_bin("min_pos"), _bin("max_pos"))).alias("bin")
    spans = files.where("min_pos IS NOT NULL").select("file", name.alias("CHROM"), "min_pos", "max_pos", covered)
    met = spans.join(wanted, ["CHROM", "bin"]).where("min_pos <= last AND max_pos >= first")
    return met.select("file").distinct()


def lookup_scores(spark: SparkSession, path: str, variants: DataFrame, normalize_chrom: bool = True, **options) -> DataFrame:
    """As `operators.lookup.lookup_scores`, reading only files that may hold one of the variants."""
    files = files_with(file_table(spark, path), variants, normalize_chrom)
    return lookup.lookup_scores(read_clustered(spark, path, files), variants, normalize_chrom, **options)
