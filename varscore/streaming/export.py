"""Chunk-wise export of a growing score table.

Score files that arrive one after another are exported as they come. The stream's checkpoint remembers what
was written, so a stopped export goes on where it was; each run ends when it has caught up.
"""

from pyspark.sql import SparkSession

from varscore import schemas
from varscore.constants import SCORE_INFO_ID
from varscore.sinks.vcf import to_vcf_lines


def export_new_scores(
    spark: SparkSession, source: str, target: str, checkpoint: str, info_id: str = SCORE_INFO_ID, files_per_batch=None
):
    """Start exporting Parquet score files below `source` as VCF body lines below `target`."""
    reader = spark.readStream.schema(schemas.SCORES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = to_vcf_lines(reader.parquet(source), info_id)
    return (
        lines.writeStream.format("text")
        .option("path", target)
        .option("compression", "gzip")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
