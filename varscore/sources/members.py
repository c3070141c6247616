"""Lines of gzip text, read by several tasks where the file is made of blocks.

A block-compressed file is a sequence of small gzip members, each of which names its own size in an extra header field
(`BC`), so a scan can start at any of them. A partition is a byte range of a file: it looks for the first member that starts
in its range and reads whole members from there. As in any split text, it leaves the first, broken line to the partition
before, and completes its own last line from the members behind its range. A gzip file without such members is one
partition, as it can only be read from the start; its lines are numbered and cut into blocks, so that what follows can
work block by block.

Files are opened with Arrow's file systems (local paths, hdfs://, s3://, gs://), never through the driver.
"""

import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Compressed bytes of a partition, lines of a block, and lines of an Arrow batch.
SPLIT_BYTES, BLOCK_LINES, BATCH_LINES = 32 << 20, 100_000, 10_000
SCHEMA = "file string, split long, line long, value string"
_ARROW = pa.schema([("file", pa.string()), ("split", pa.int64()), ("line", pa.int64()), ("value", pa.string())])
# The start of a gzip member with extra fields, the name of the size field, and the header before the fields.
_MAGIC, _FIELD, _HEADER = b"\x1f\x8b\x08\x04", b"BC", 12
#: Bytes of text of a member, below the limit of the two-byte size field.
MEMBER_BYTES = 65_280
#: Fixed value: the empty member that ends a block-compressed file.
END_MEMBER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def member_size(head: bytes) -> int | None:
    """Bytes of the member that starts with `head`, if it names them."""
    if len(head) < _HEADER or head[:4] != _MAGIC:
        return None
    at, end = _HEADER, _HEADER + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == _FIELD and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def first_member(file, start: int, end: int) -> int | None:
    """The first member that starts in [start, end): one that names a size at which the next one starts or the file ends."""
    step, whole = 1 << 17, file.size()
    for at in range(start, end, step):
        file.seek(at)
        data = file.read(step + 1024)
        k = data.find(_MAGIC)
        while 0 <= k < step and at + k < end:
            size = member_size(data[k : k + 1024])
            if size:
                file.seek(at + k + size)
                if at + k + size == whole or member_size(file.read(1024)):
                    return at + k
            k = data.find(_MAGIC, k + 1)
    return None


def members(file, at: int):
    """(start, text) of the members from `at` on."""
    while True:
        file.seek(at)
        size = member_size(file.read(1024))
        if not size:
            return
        file.seek(at)
        yield at, zlib.decompress(file.read(size), 31)
        at += size


def member_lines(file, start: int, end: int):
    """The lines that start behind the first member's first byte (or with it, at the start of the file) and not behind the
    range."""
    at = 0 if start == 0 else first_member(file, start, end)
    if at is None:
        return
    skip, carry = start > 0, b""
    for place, text in members(file, at):
        if place >= end:  # only the line under way is completed
            if skip:
                return
            head, found, _ = text.partition(b"\n")
            carry += head
            if found:
                yield carry
                return
            continue
        lines = (carry + text).split(b"\n")
        carry = lines.pop()
        if skip and lines:
            lines, skip = lines[1:], False
        yield from lines
    if carry and not skip:
        yield carry


def plain_lines(file):
    """The lines of a gzip file of any members, from its start."""
    codec, carry = zlib.decompressobj(31), b""
    while data := file.read(1 << 20):
        while data:
            lines = (carry + codec.decompress(data)).split(b"\n")
            carry, data = lines.pop(), codec.unused_data
            yield from lines
            if codec.eof:
                codec = zlib.decompressobj(31)
    if carry:
        yield carry


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    blocks: bool


class MembersReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self):
        from pyarrow import fs

        system, path = opened(self.path)
        prefix = self.path[: len(self.path) - len(path)] if "://" in self.path else ""
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        files = [f for f in files if f.type == fs.FileType.File and f.base_name.endswith((".gz", ".bgz"))]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with system.open_input_file(f.path) as file:
                blocks = member_size(file.read(1024)) is not None
            step = self.bytes if blocks else max(1, f.size)
            out += [Range(prefix + f.path, at, min(f.size, at + step), blocks) for at in range(0, f.size, step)]
        return out or [Range("", 0, 0, False)]

    def read(self, partition):
        if not partition.path:
            return
        system, path = opened(partition.path)
        with system.open_input_file(path) as file:
            lines = member_lines(file, partition.start, partition.end) if partition.blocks else plain_lines(file)
            held, first = [], 0

            def batch():
                numbers = range(first, first + len(held))
                splits = [(partition.start << 20) + n // BLOCK_LINES for n in numbers]
                texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in held]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([partition.path] * len(held), splits, numbers, texts), _ARROW)], schema=_ARROW)

            for line in lines:
                held.append(line)
                if len(held) == BATCH_LINES:
                    yield batch()
                    first, held = first + len(held), []
            if held:
                yield batch()


class GzipMembers(DataSource):
    """`spark.read.format("gzip_members").load(path)`: lines of one `.gz` or `.bgz` file, or of those in a folder, in order.

    `split` and `line` place a line in its file; the option `splitBytes` sets the compressed bytes of a partition.
    """

    @classmethod
    def name(cls):
        return "gzip_members"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MembersReader(self.options)


def read_members(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines `(file, split, line, value)` of block-compressed or plain gzip text."""
    spark.dataSource.register(GzipMembers)
    return spark.read.format("gzip_members").option("splitBytes", split_bytes).load(path)


def member(text: bytes) -> bytes:
    """One member of at most MEMBER_BYTES of text."""
    codec = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = codec.compress(text) + codec.flush()
    head = _MAGIC + bytes(5) + b"\xff" + struct.pack("<H", 6) + _FIELD + struct.pack("<HH", 2, len(data) + 25)
    return head + data + struct.pack("<II", zlib.crc32(text), len(text))


def write_members(lines: DataFrame, path: str) -> DataFrame:
    """Write text lines as block-compressed parts below `path`, one file per partition in the order of the partitions;
    returns one row per part: (part, lines, bytes). A part appears under its name when it is complete, so a task that is
    run again replaces it."""

    def run(batches):
        import os
        import uuid

        from pyspark import TaskContext

        part, count, held = TaskContext.get().partitionId(), 0, []
        system, base = opened(path)
        system.create_dir(base, recursive=True)
        target = f"{base}/part-{part:05d}.gz"
        hidden = f"{base}/.part-{part:05d}-{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as out:
            rest = b""
            for batch in batches:
                texts = batch.column(0).to_pylist()
                count += len(texts)
                rest += "".join(f"{t}\n" for t in texts).encode()
                whole = len(rest) - len(rest) % MEMBER_BYTES
                for at in range(0, whole, MEMBER_BYTES):
                    out.write(member(rest[at : at + MEMBER_BYTES]))
                rest = rest[whole:]
            if rest:
                out.write(member(rest))
            out.write(END_MEMBER)
        system.move(hidden, target)
        held = [pa.array([os.path.basename(target)]), pa.array([count], pa.int64()), pa.array([system.get_file_info(target).size], pa.int64())]
        yield pa.RecordBatch.from_arrays(held, names=["part", "lines", "bytes"])

    from varscore.runtime import checkpointed

    return checkpointed(lines.select("value").mapInArrow(run, "part string, lines long, bytes long"))
