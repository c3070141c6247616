"""Session set-up, lineage cuts in the shared checkpoint folder, and the broadcast size check."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A join side is broadcast only when its measured size stays below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 48


def build_session(app_name="varscore", master=None, **conf):
    """A session with adaptive execution and skew handling; anything set on the cluster stays."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark):
    """The shared folder named by `spark.checkpoint.dir`; a temporary one only for local masters."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="varscore-checkpoint-")
        context.setCheckpointDir(configured)
    return configured or current


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably, so that several uses share one computation and survive lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark, name):
    """A fresh path below the shared checkpoint folder."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder: computed once, read by column, and a fraction of the size of
    a checkpoint, which holds uncompressed rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Size of a narrow table, measured in one distributed pass (text columns by their length)."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    width = sum(text, F.lit(_ROW_OVERHEAD + 8 * len(df.columns))).cast("long")
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]


def spread_in_order(scan: DataFrame) -> DataFrame:
    """As `spread`, but the rows keep the order of the scan, over partitions and within them."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    placed = scan.withColumn("_place", F.monotonically_increasing_id())
    return placed.repartitionByRange(cores, "_place").sortWithinPartitions("_place").drop("_place")


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of a scan that has fewer tasks than there are cores.

    That happens with small inputs and with gzip text, which cannot be split; larger scans stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def even_partitions(df: DataFrame) -> int:
    """The configured number of shuffle partitions, up to a multiple of the cores. A table stored from so many is read again by
    all cores in even shares; with another number of files some cores get two and others none, or `spread` shuffles it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return -(-shuffle_partitions(df) // cores) * cores


def shuffle_partitions(df: DataFrame) -> int:
    """The configured number, for shuffles before work in Python: partitions merged by size may be a few more than cores."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
