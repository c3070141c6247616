"""One block-compressed text file, compressed by many tasks."""

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from varscore.runtime import scratch_path
from varscore.sinks.vcf import merged_header
from varscore.sources.members import END_MEMBER, opened, write_members

#: Bytes that are copied at a time.
COPY_BYTES = 8 << 20


def _blocks(part: str, size: int):
    """The first `size` bytes of a part."""
    system, path = opened(part)
    with system.open_input_stream(path, compression=None) as source:
        while size:
            data = source.read(min(size, COPY_BYTES))
            if not data:
                raise OSError(f"{part} is shorter than when it was written")
            size -= len(data)
            yield data


def _copied(size: int):
    return pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["copied"])


def write_member_file(lines: DataFrame, path: str, mode: str = "error", at_offsets: bool | None = None) -> int:
    """Write text lines, in their order, as the one file `path`; returns its size in bytes.

    Each partition is compressed into a part of its own in the shared checkpoint folder. The running sum of the parts'
    sizes says where each of them begins in the file, and the parts are copied there as they are, without the empty
    member at their end; the file gets one. On a mounted file system tasks copy side by side to their offsets. Object
    stores and HDFS cannot write at an offset: there one task streams the parts in order, COPY_BYTES in memory at a
    time, so the copy (not the compression) takes as long as the file is large. `at_offsets` overrules this choice.

    The file appears under its name when it is complete. Copying a part again writes the same bytes to the same place.
    """
    from pyarrow import fs

    spark = lines.sparkSession
    system, target = opened(path)
    if mode != "overwrite" and system.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    if at_offsets is None:
        at_offsets = isinstance(system, fs.LocalFileSystem)
    folder = scratch_path(spark, "members")
    parts = sorted(write_members(lines, folder).collect(), key=lambda p: (len(p.part), p.part))  # one row per partition
    placed, end = [], 0
    for part in parts:
        size = part.bytes - len(END_MEMBER)
        if size:
            placed.append((f"{folder}/{part.part}", end, size))
        end += size
    base, name = os.path.split(target)
    system.create_dir(base, recursive=True)
    hidden = f"{base}/.{name}-{uuid.uuid4().hex}"
    table = spark.createDataFrame(placed, "part string, at long, size long")
    if at_offsets:
        with open(hidden, "wb") as out:
            out.seek(end)
            out.write(END_MEMBER)

        def copy(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    with open(hidden, "r+b") as out:
                        out.seek(row["at"])
                        for data in _blocks(row["part"], row["size"]):
                            out.write(data)
                    yield _copied(row["size"])

        tasks = max(1, min(len(placed), 4 * spark.sparkContext.defaultParallelism))
        done = table.repartition(tasks).mapInArrow(copy, "copied long")
    else:

        def stream(batches):
            system, _ = opened(path)
            attempt, size = f"{hidden}-{uuid.uuid4().hex}", 0
            with system.open_output_stream(attempt, compression=None) as out:
                for batch in batches:
                    for row in batch.to_pylist():
                        for data in _blocks(row["part"], row["size"]):
                            out.write(data)
                        size += row["size"]
                out.write(END_MEMBER)
            system.move(attempt, hidden)
            yield _copied(size)

        done = table.repartition(1).sortWithinPartitions("at").mapInArrow(stream, "copied long")
    copied = sum(r.copied for r in done.collect())
    if copied != end:
        raise OSError(f"{copied} of {end} bytes were copied to {path}")
    system.move(hidden, target)
    if parts:
        system, folder = opened(folder)
        system.delete_dir(folder)
    return end + len(END_MEMBER)


def write_vcf_file(header: DataFrame, body: DataFrame, path: str, **options) -> int:
    """Header and body lines as one `.vcf.gz`, the header first and the body in its order."""
    return write_member_file(merged_header(header).unionAll(body.select("value")), path, **options)
