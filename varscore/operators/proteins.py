"""Protein text of whole coding sequences, translated from the bytes of each text in one pass."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.constants import codon_table
from varscore.runtime import shuffle_partitions

PROTEINS = "protein_id string, sequence string"
_PROTEINS = pa.schema([("protein_id", pa.string()), ("sequence", pa.string())])
_TABLE, _BASES = codon_table(), "ACGT"
_PAIRS = str.maketrans(_BASES, _BASES[::-1])


def _places(order: str) -> bytes:
    """The place of each base in `order`, 128 for any other byte, so that only three bases add up to less than 64."""
    return bytes(order.find(c) if (c := chr(b).upper()) in _BASES else 128 for b in range(256))


_PLUS, _MINUS = _places(_BASES), _places(_BASES[::-1])
_LETTERS = np.full(128 * 21 + 1, ord("X"), "uint8")
for _codon, _aa in _TABLE.items():
    _LETTERS[sum(_BASES.index(base) * w for base, w in zip(_codon, (16, 4, 1)))] = ord(_aa)
#: Line ends belong to no codon, as for the `.` of the column function.
_ANY_CODON = re.compile(r"[^\n\r\u0085\u2028\u2029]{3}")
CODING = "transcript_id string, found long, coding long, sequence string"
_CODING = pa.schema([("transcript_id", pa.string()), ("found", pa.int64()), ("coding", pa.int64()), ("sequence", pa.string())])
RESIDUES = "transcript_id string, codon_idx long, ref_aa string"
_RESIDUES = pa.schema([("transcript_id", pa.string()), ("codon_idx", pa.int64()), ("ref_aa", pa.string())])
#: Residues of an Arrow batch of the functions below, at the least, except for the last of a task.
_BATCH = 65_536


def translate(cds: str | None, minus: bool = False) -> str | None:
    """What `functions.sequence.translate_cds` gives for a text, or with `minus` for its reverse complement: unknown codons
    become X, a partial codon is left out."""
    if cds is None:
        return None
    if not cds.isascii() or "\n" in cds or "\r" in cds:
        read = cds.upper().translate(_PAIRS)[::-1] if minus else cds.upper()
        return "".join(_TABLE.get(codon, "X") for codon in _ANY_CODON.findall(read))
    return _residues(cds.encode().translate(_MINUS)[::-1] if minus else cds.encode().translate(_PLUS)).tobytes().decode()


def _residues(read: bytes) -> np.ndarray:
    """The letters of whole codons, as bytes, of a text given as places of bases."""
    size = len(read) // 3
    places = np.frombuffer(read, "uint8")[: size * 3].reshape(size, 3).astype("uint16")
    return _LETTERS[places[:, 0] * 16 + places[:, 1] * 4 + places[:, 2]]


def _objects(column: pa.Array) -> list:
    """As `to_pylist`, in a fraction of its time for text. Numbers must not be null."""
    return column.to_numpy(zero_copy_only=False).tolist()


def translated(pieces: DataFrame) -> DataFrame:
    """Pieces of coding regions -> `(protein_id, sequence)`: what `translate_cds` gives for `extract_cds`, but texts are turned
    and translated whole, not letter by letter and codon by codon. Pieces are sorted and read one after the other, which
    takes less than gathering them in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sequences, size, name, turned, parts = [], [], 0, None, False, []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sequences, pa.string())], schema=_PROTEINS)

        for rows in batches:
            for transcript, strand, text in zip(*map(_objects, rows.columns)):
                if parts and transcript != name:
                    names.append(name)
                    sequences.append(translate("".join(parts), turned))
                    size, parts = size + len(sequences[-1]), []
                    if size >= _BATCH:
                        yield batch_of()
                        names, sequences, size = [], [], 0
                if not parts:
                    name, turned = transcript, strand == "-"
                parts.append(text or "")
        if parts:
            names.append(name)
            sequences.append(translate("".join(parts), turned))
        if names:
            yield batch_of()

    wanted = pieces.select(F.col("transcript_id").cast("string"), "strand", "seq", "piece_start")
    dealt = wanted.repartition(shuffle_partitions(pieces), "transcript_id").sortWithinPartitions("transcript_id", "piece_start", "seq")
    return dealt.drop("piece_start").mapInArrow(run, PROTEINS)


def _turned(texts: list, minus: bool) -> bytes:
    """Places of the bases of a text in pieces that follow each other in reading direction; a letter is one byte."""
    whole = "".join(texts[::-1] if minus else texts).encode("ascii", "replace")
    return whole.translate(_MINUS)[::-1] if minus else whole.translate(_PLUS)


def _read_through(parts: list) -> np.ndarray:
    """Residues of pieces `((chrom, strand), text)` in reading order. Codons of bases on two contigs or strands become X."""
    places = {place: i for i, place in enumerate({place for place, _ in parts})}
    if len(places) == 1:
        return _residues(_turned([text for _, text in parts], parts[0][0][1] == "-"))
    read = [_turned([text], place[1] == "-") for place, text in parts]
    found = _residues(b"".join(read))
    owner = np.repeat([places[place] for place, _ in parts], [len(text) for text in read])[: len(found) * 3].reshape(-1, 3)
    found[(owner != owner[:, :1]).any(axis=1)] = ord("X")
    return found


def coding_residues(pieces: DataFrame) -> DataFrame:
    """Pieces of coding regions -> one row per transcript: bases found, codons of amino acids, and its letters, where `*` is a
    stop and X any other codon.

    The letters are those of the codons of `genome.placed_codons`, at their `codon_idx`: exons follow each other in reading
    direction, each read on its own strand. Pieces are sorted and read one after the other; no offsets are needed.
    """

    def batch_of(done):
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*done), _CODING.types)], schema=_CODING)

    def row(name, parts, found):
        letters = _read_through(parts).tobytes()
        return name, found, len(letters) - letters.count(b"X") - letters.count(b"*"), letters.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, name, parts, found = [], 0, None, [], 0
        for rows in batches:
            names, chroms, strands, bases, texts = map(_objects, rows.columns)
            for transcript, place, size_of, text in zip(names, zip(chroms, strands), bases, texts):
                if parts and transcript != name:
                    done.append(row(name, parts, found))
                    size, parts, found = size + found // 3, [], 0
                    if size >= _BATCH:
                        yield batch_of(done)
                        done, size = [], 0
                name, found = transcript, found + size_of
                parts.append((place, text))
        if parts:
            done.append(row(name, parts, found))
        if done:
            yield batch_of(done)

    minus = F.col("strand") == "-"
    along = F.when(minus, -F.col("end_pos")).otherwise(F.col("start_pos"))
    at = F.when(minus, F.col("end_pos") - F.col("piece_end")).otherwise(F.col("piece_start") - F.col("start_pos"))
    size = (F.col("piece_end") - F.col("piece_start") + 1).cast("long")
    wanted = pieces.select("transcript_id", "chrom", "strand", size.alias("size"), "seq", along.alias("along"), at.alias("at"))
    read = wanted.repartition(shuffle_partitions(pieces), "transcript_id").sortWithinPartitions("transcript_id", "along", "at").drop("along", "at")
    return read.mapInArrow(run, CODING)


def residues(sequences: DataFrame) -> DataFrame:
    """Rows of `coding_residues` -> one row per codon of an amino acid, without stops and X."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names, texts = rows.column(0), rows.column(1).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and size < _BATCH:
                    size, end = size + len(texts[end]), end + 1
                sizes = [len(text) for text in texts[start:end]]
                letters = np.frombuffer("".join(texts[start:end]).encode(), "uint8")
                kept = np.flatnonzero((letters != ord("X")) & (letters != ord("*")))
                owner = np.repeat(np.arange(start, end), sizes)[kept]
                place = np.concatenate([np.arange(n) for n in sizes])[kept]
                letter = pa.StringArray.from_buffers(len(kept), pa.py_buffer(np.arange(len(kept) + 1, dtype="int32")), pa.py_buffer(letters[kept].tobytes()))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), pa.array(place.astype("int64")), letter], schema=_RESIDUES)
                start = end

    return sequences.select(F.col("transcript_id").cast("string"), "sequence").mapInArrow(run, RESIDUES)
