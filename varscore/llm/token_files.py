"""Token files: ids in ascending order of documents, stored as compressed byte or bit planes with a chunk index.

Rows are dealt to ranges of ids, one file each, in order. A file is a sequence of chunks of whole documents. The ids of a
chunk are cut into blocks of BLOCK ids; each block is transposed into planes (byte b, or bit b, of every id), and each
plane is compressed with zstandard on its own. The index of a chunk holds its place in the file, the ids and lengths of
its documents, and the sizes of its planes, so any chunk can be read alone. Chunks are rows that Spark writes as Parquet
in the shared folder: a task that is lost is written again, and no half file is ever seen.

Each document ends with the id END. Null and empty texts are that id alone. Null document ids come first; equal ids are
ordered by text. An empty table gives no rows.
"""

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.llm.common import WordCache, narrow, pieces_by_bytes, shuffle_partitions, texts_of, values_of
from varscore.runtime import scratch_path

#: Ids of a block, ids at which a chunk is closed, and the id that ends a document.
BLOCK, CHUNK_IDS, END = 8192, 1 << 18, 2
#: Words that each of the two generations of a worker's cache holds, about 200 bytes each.
CACHE = 600_000
#: Bytes of text whose words are looked up together; words longer than LONG are not kept.
BATCH_BYTES, LONG = 4 << 20, 256
SCHEMA = "file int, chunk int, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, index binary, planes binary"
_RUNS = [c + b" " for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")]
_BEYOND = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f"]
#: In front of a line end that stands between two words, where the tokenizer's pattern splits on both sides of it.
_LINE = b"\x00\n"
_LINE_RUNS = [x for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c") for x in (c + b"\n", b"\n" + c)]
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_ODD_SPACE = re.compile(r"[^\S \t\n\r\x0b\x0c]")
_PIECES = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")


def pack(ids: np.ndarray, kind="byte") -> tuple:
    """(index, planes) of unsigned 32-bit ids."""
    compress, sizes, out = zstandard.ZstdCompressor(level=3).compress, [], []
    for at in range(0, len(ids), BLOCK):
        block = np.ascontiguousarray(ids[at : at + BLOCK], dtype="<u4").view(np.uint8).reshape(-1, 4)
        table = block.T if kind == "byte" else np.packbits(np.unpackbits(block, axis=1, bitorder="little").T, axis=1, bitorder="little")
        for plane in table:
            data = compress(plane.tobytes())
            sizes.append(len(data))
            out.append(data)
    return struct.pack("<BII", kind == "bit", BLOCK, len(ids)) + np.array(sizes, "<u4").tobytes(), b"".join(out)


def unpack(index: bytes, planes: bytes) -> np.ndarray:
    """The ids of a chunk."""
    bits, block, n = struct.unpack_from("<BII", index)
    sizes, at, parts = np.frombuffer(index, "<u4", offset=9), 0, []
    decompress, per = zstandard.ZstdDecompressor().decompress, 32 if bits else 4
    for k, start in enumerate(range(0, n, block)):
        count, table = min(block, n - start), []
        for size in sizes[k * per : (k + 1) * per].tolist():
            table.append(np.frombuffer(decompress(planes[at : at + size]), np.uint8))
            at += size
        table = np.stack(table)
        if bits:
            table = np.packbits(np.unpackbits(table, axis=1, bitorder="little")[:, :count].T, axis=1, bitorder="little").T
        parts.append(np.ascontiguousarray(table.T).view("<u4").ravel())
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


class Encoder:
    """Ids of a text under a byte-level tokenizer, from its parts between spaces.

    The tokenizer's pattern splits before a run of white space and before a space in front of a word, so texts are cut
    there, and at line ends between words; the ids of the parts, kept in a bounded cache, are the ids of the text. Texts
    with a zero byte or white space beyond ASCII are encoded in one piece. A part under the key b" " + part stands without its leading space.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        led = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            led[i] = token.startswith("Ġ")
        self.led, self.cache = led, WordCache(self.fetch, CACHE)
        self.line = np.arange(len(led)) == self.tokenizer.token_to_id("Ċ")

    def ids(self, texts: list) -> list:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fetch(self, keys: list) -> list:
        """Ids of space-led words are read off one text per batch, split where tokens begin with a space; those of words at
        the start of a line likewise, split at the line ends."""
        out = dict.fromkeys(keys)
        plain, lines = [k for k in keys if k and k[0] > 32], [k for k in keys if k[:2] == _LINE]
        for some, lead, begins in ((plain, b" ", self.led), (lines, b"", self.line)):
            for at in range(0, len(some), 512):
                part = some[at : at + 512]
                text = (lead + lead.join(part)).replace(_LINE, b"\n").decode()
                (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
                ids = np.array(found.ids, "<u4")
                cuts = np.flatnonzero(begins[ids])
                if len(cuts) == len(part) and cuts[0] == 0:
                    packed, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
                    out.update(zip(part, (packed[a:b] for a, b in zip([0, *ends], ends))))
        rest = [k for k in keys if out[k] is None]
        out.update(zip(rest, self.ids([k.decode()[1:] if k[:1] == b" " or k[:2] == _LINE else " " + k.decode() for k in rest])))
        return [out[k] for k in keys]

    def encode(self, data: bytes) -> bytes:
        if not data:
            return b""
        if b"\x00" in data or any(x in data for x in _BEYOND) and _ODD_SPACE.search(data.decode()):
            return self.ids([data.decode()])[0]
        if any(x in data for x in _RUNS) and _UNSAFE.search(data.decode()):
            return b"".join(self.ids(_PIECES.findall(data.decode())))
        words = data.split(b" ")
        words[0] = b" " + words[0]
        long = max(map(len, words)) > LONG
        if words[0] == b" ":  # the text begins with a space
            words = words[1:]
        if long:
            return b"".join(self.ids([w[1:].decode() if w[:1] == b" " else " " + w.decode() for w in words]))
        return b"".join(self.cache.values(words))


    def splits(self, data: bytes) -> bool:
        """Whether every space of the text is a safe boundary."""
        if b"\x00" in data or any(x in data for x in _BEYOND) and _ODD_SPACE.search(data.decode()):
            return False
        return bool(data) and not (any(x in data for x in _RUNS) and _UNSAFE.search(data.decode()))

    def encode_all(self, texts: list) -> list:
        """The ids of many texts: the words of about BATCH_BYTES are told apart by Arrow, each different one is looked up
        once, and the ids of the texts are gathered from them."""
        out = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.splits(t)]
        for i in set(range(len(texts))).difference(plain):
            out[i] = self.encode(texts[i])
        whole, texts = texts, list(texts)
        for i in plain:
            data = texts[i]
            if b"\n" in data and data[:1] != b"\n" and data[-1:] != b"\n" and not any(x in data for x in _LINE_RUNS):
                texts[i] = data.replace(b"\n", b" " + _LINE)
        for a, b in pieces_by_bytes([len(texts[i]) for i in plain], BATCH_BYTES):
            docs = plain[a:b]
            words = pc.split_pattern(pa.array([texts[i] for i in docs], pa.large_binary()), pattern=b" ")
            bounds = words.offsets.to_numpy()
            coded = words.flatten().dictionary_encode()
            codes, different = coded.indices.to_numpy(), values_of(coded.dictionary)
            long = np.fromiter(map(len, different), np.int64, len(different)) > LONG
            values = self.cache.values([w if not x else b"" for w, x in zip(different, long.tolist())])
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
            ids, starts = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
            n = sizes[codes]
            n[bounds[:-1]] = 0  # first words have no space in front
            first = self.cache.values([b" " + w if w and len(w) <= LONG else b"" for w in map(different.__getitem__, codes[bounds[:-1]].tolist())])
            ends = np.cumsum(n)
            places = np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1])
            gathered, stops = ids[places], np.append(0, ends)[bounds].tolist()
            heavy = np.logical_or.reduceat(long[codes], bounds[:-1]).tolist()
            for k, i in enumerate(docs):
                if heavy[k]:
                    out[i] = self.encode(whole[i])
                else:
                    lead = first[k] if texts[i][:1] != b" " else b""
                    out[i] = lead + gathered[stops[k] : stops[k + 1]].tobytes()
        return out


_ENCODERS: dict = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once in a worker process: the tokens of frequent words stay known from task to
    task. Only the last path is kept."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col="doc_id", text_col="text", kind="byte", end=END) -> None:
    """Encode and store the documents at `path`, a folder that all executors reach."""

    def run(batches):
        encoder, place = encoder_of(tokenizer), {"chunk": 0, "first": 0}
        file, held, ids, lengths, size = TaskContext.get().partitionId(), [], [], [], 0

        def close():
            whole = np.frombuffer(b"".join(held), "<u4")
            index, planes = pack(whole, kind)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([file], pa.int32()), pa.array([place["chunk"]], pa.int32()), pa.array([place["first"]], pa.int64()),
                    pa.array([len(whole)], pa.int64()), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(lengths)], pa.list_(pa.int64())),
                    pa.array([index], pa.binary()), pa.array([planes], pa.binary()),
                ],
                names=["file", "chunk", "first", "n_ids", "doc_ids", "doc_lengths", "index", "planes"],
            )
            place["chunk"] += 1
            place["first"] += len(whole)
            held.clear(), ids.clear(), lengths.clear()
            return row

        last = struct.pack("<I", end)
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), encoder.encode_all(texts_of(batch.column(1)))):
                held.append(own + last)
                ids.append(key)
                lengths.append(len(held[-1]) // 4)
                size += lengths[-1]
                if size >= CHUNK_IDS:
                    yield close()
                    size = 0
        if held:
            yield close()

    rows = narrow(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    ranged = rows.repartitionByRange(shuffle_partitions(docs), "id").sortWithinPartitions("id", "text")
    ranged.mapInArrow(run, SCHEMA).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """Rows (id, start, n_tokens, ids binary) of the documents stored at `path`, ids as little-endian 32-bit numbers."""
    chunks = spark.read.schema(SCHEMA).parquet(path)
    sizes = chunks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("file", (F.expr("sum(n) over (order by file)") - F.col("n")).alias("before"))  # one row per file

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["index"], row["planes"])
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                cut = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + row["before"] + starts, pa.int64()), pa.array(row["doc_lengths"], pa.int64()), pa.array(cut, pa.binary())],
                    names=["id", "start", "n_tokens", "ids"],
                )

    placed = chunks.join(before, "file").select("first", "before", "doc_ids", "doc_lengths", "index", "planes")
    return placed.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the documents as token files in the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
