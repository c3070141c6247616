"""Batches that are added exactly once.

Each run writes the rows of its batch, and the keys that it has finished, to folders of its own, and then adds one row to
the manifest. A manifest row is a single file that Spark renames into place when it is complete, so a batch is either
published as a whole or not at all; what a run left behind before that is never read. A batch that is published is not
written again, and if two runs of one batch race, all readers take the same one of the two.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch string, attempt string, n_rows long"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Published batches (batch, attempt, n_rows), one row each; none where nothing has been published."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    return rows.groupBy("batch").agg(F.min(F.struct("attempt", "n_rows")).alias("first")).select("batch", "first.*")


def write_batch(df: DataFrame, keys: DataFrame, root: str, batch: str) -> str:
    """Write a batch without publishing it; returns its attempt."""
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{root}/rows/{batch}-{attempt}")
    keys.distinct().write.parquet(f"{root}/keys/{batch}-{attempt}")
    return attempt


def publish(spark: SparkSession, root: str, batch: str, attempt: str) -> None:
    """Add the manifest row of a written batch."""
    n_rows = spark.read.parquet(f"{root}/rows/{batch}-{attempt}").count()  # from the files' footers
    spark.createDataFrame([(batch, attempt, n_rows)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def append_batch(df: DataFrame, keys: DataFrame, root: str, batch: str) -> bool:
    """Write and publish `df` with the keys it finishes; False if the batch is there already, whose rows then stay."""
    spark = df.sparkSession
    if not manifest(spark, root).where(F.col("batch") == batch).isEmpty():
        return False
    publish(spark, root, batch, write_batch(df, keys, root, batch))
    return True


def _read(spark, root, kind, schema):
    published = manifest(spark, root).orderBy("batch").collect()  # one row per run
    if not published:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{kind}/{r.batch}-{r.attempt}" for r in published])


def read_rows(spark: SparkSession, root: str, schema) -> DataFrame:
    """Rows of all published batches."""
    return _read(spark, root, "rows", schema)


def read_keys(spark: SparkSession, root: str, schema) -> DataFrame:
    """Keys that the published batches have finished."""
    return _read(spark, root, "keys", schema)
