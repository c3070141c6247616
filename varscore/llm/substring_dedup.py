"""Removal of repeated word passages by seed and extend.

A word goes if some window of WINDOW words that covers it also starts earlier: in a document with a smaller id, or earlier in
the same one. Words are runs of characters other than ASCII white space; windows never leave their document.

1. Seeds are SEED words long and winnowed: of the seeds of each window the smallest hash is its anchor, so equal windows have
   equal anchors. The neighbouring windows of one anchor are the reach of its extension: up to WINDOW - SEED words both ways.
2. Documents are joined on anchors that occur more than once. Occurrences that extend alike over their whole reach are one
   class, and all of a class but the first are repeats as a whole.
3. Where an anchor has several classes, the first occurrence of each is extended over its own text window by window; a window
   that another class has earlier is repeated. However many documents share a passage, each class brings its text once.
4. Repeated windows of a document that touch or overlap form its maximal repeats, which are cut out.

Copies of a whole text are set aside first: all but the one with the smallest id are one repeat from end to end. No step
pairs the members of a group with each other: each looks up the first of its kind, which is aggregated before the shuffle.
Classes are told apart by 128 bits (anchor and extension), windows and texts by 128-bit hashes.

Null and empty texts, and texts of fewer than WINDOW words, lose nothing. Null ids come last; documents of one id are ordered
by a hash of their text, and of rows that repeat id and text one counts as the first. Texts are whole; a very long one is
worked through in pieces of PIECE words that overlap by a window. An empty table gives no rows.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.llm.common import narrow, small_or_shuffled, texts_of, written
from varscore.llm.suffix_dedup import mixed, prefix_sums, sliding
from varscore.runtime import BROADCAST_BYTES, measured_bytes

#: Words of a repeated passage, of a seed, and of a piece of a long text.
WINDOW, SEED, PIECE = 20, 6, 1 << 15
_ONE_SPACE = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
_SPACES = re.compile(rb" {2,}")


class Words:
    """A text as its words joined by single spaces, with the byte range of each word."""

    def __init__(self, text: bytes):
        text = text.translate(_ONE_SPACE).strip(b" ")
        self.text = _SPACES.sub(b" ", text) if b"  " in text else text
        gaps = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
        self.starts, self.ends = np.append(0, gaps + 1), np.append(gaps, len(self.text))
        self.n = len(self.starts) if self.text else 0

    def part(self, first: int, last: int) -> bytes:
        return self.text[self.starts[first] : self.ends[last]]


def seed_hashes(words: Words, a: int, b: int, seed: int) -> np.ndarray:
    """Hashes of the seeds within the words a to b - 1."""
    at = words.starts[a]
    sums, down = prefix_sums(np.frombuffer(words.text[at : words.ends[b - 1]], np.uint8))
    starts = words.starts[a:b] - at
    word = mixed((sums[words.ends[a:b] - at] - sums[starts]) * down[starts])
    out = word[: b - a - seed + 1]
    for step in range(1, seed):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word[step : step + len(out)])
    return out


def classes_of(words: Words, window: int, seed: int):
    """(anchor's hash, first window, last window) of each anchor of a text, in order."""
    out = [[np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]]
    for a in range(0, words.n - window + 1, PIECE):
        b = min(words.n, a + PIECE + window - 1)
        keys = seed_hashes(words, a, b, seed)
        ranked = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
        anchor = (sliding(ranked, window - seed + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.append(0, cuts), np.append(cuts - 1, len(anchor) - 1)
        out.append([keys[anchor[first]], first + a, last + a])
    return [np.concatenate(x) for x in zip(*out)]


def _taken(column, counts):
    return column.take(pa.array(np.repeat(np.arange(len(counts)), counts)))


def anchors(base: DataFrame, window: int, seed: int) -> DataFrame:
    """Rows (id, tie, h, x, at, last): each anchor of each document, its extension's hash, and its first and last window."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, reach, first, last, counts = [], [], [], [], []
                for text in texts_of(part.column(2)):
                    words = Words(text)
                    h, a, b = classes_of(words, window, seed)
                    keys.append(h)
                    first.append(a)
                    last.append(b)
                    counts.append(len(h))
                    spans = zip(words.starts[a].tolist(), words.ends[b + window - 1].tolist()) if len(h) else ()
                    reach += [xxhash.xxh3_64_intdigest(words.text[s:e]) for s, e in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        _taken(part.column(0), counts), _taken(part.column(1), counts), pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.array(reach, np.uint64).view(np.int64)), pa.array(np.concatenate(first).astype(np.int32)), pa.array(np.concatenate(last).astype(np.int32)),
                    ],
                    names=["id", "tie", "h", "x", "at", "last"],
                )

    kind = base.schema["id"].dataType.simpleString()
    return base.select("id", "tie", "text").mapInArrow(run, f"id {kind}, tie long, h long, x long, at int, last int")


def window_hashes(rows: DataFrame, window: int) -> DataFrame:
    """Rows (id, tie, w1, w2, at) of the windows of rows (id, tie, text, spans), spans being (first, last) windows."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                words, digest = Words(texts_of(part.column(2))[0]), xxhash.xxh3_128_digest
                starts = [w for s in part.column(3)[0].as_py() for w in range(s["at"], s["last"] + 1)]
                for at in range(0, len(starts), PIECE):
                    some = starts[at : at + PIECE]
                    both = np.frombuffer(b"".join(digest(words.part(w, w + window - 1)) for w in some), np.int64).reshape(-1, 2)
                    arrays = [_taken(part.column(0), [len(some)]), _taken(part.column(1), [len(some)]), *[pa.array(both[:, j]) for j in (0, 1)], pa.array(some, pa.int32())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "tie", "w1", "w2", "at"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "tie", "text", "spans").mapInArrow(run, f"id {kind}, tie long, w1 long, w2 long, at int")


def cut(rows: DataFrame, window: int) -> DataFrame:
    """Rows (id, n_words, n_removed, n_repeats, kept) of rows (id, text, spans); null spans remove nothing, and an empty
    list stands for the whole of a text that has a window."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
                words = Words(text)
                if spans is None or words.n < window:
                    out.append((words.n, 0, 0, words.text))
                    continue
                edge = np.zeros(words.n + 1, np.int64)
                for s in spans or [{"at": 0, "last": words.n - window}]:
                    edge[s["at"]] += 1
                    edge[s["last"] + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[1], gone, [1]])))  # kept runs [turns[0], turns[1]), ...
                kept = b" ".join(words.part(a, b - 1) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()))
                out.append((words.n, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_removed", "n_repeats", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "spans").mapInArrow(run, f"id {kind}, n_words long, n_removed long, n_repeats long, kept binary")


def _first(*more):
    """The smallest occurrence of a group: null ids last, then by id and text, then by place."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tie", *more)).alias("best")


def _spans(df: DataFrame, most: int) -> DataFrame:
    """Window ranges (id, tie, at, last) gathered per document, with a hint to broadcast them up to `most` bytes."""
    out = written(df.groupBy("id", "tie").agg(F.collect_list(F.struct("at", "last")).alias("spans")), "spans")
    inside = out.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0] * 32
    out = out.select(F.col("id").alias("s_id"), F.col("tie").alias("s_tie"), "spans")
    return F.broadcast(out) if measured_bytes(out) + inside <= most else out


def _same_document():
    return F.col("id").eqNullSafe(F.col("s_id")) & (F.col("tie") == F.col("s_tie"))


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, seed=SEED) -> DataFrame:
    """Rows (id, n_words, n_removed, n_repeats, kept binary), one per document: kept words are joined by one space."""
    rows = narrow(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("tie2", F.xxhash64(F.lit(1), "text"))
    texts = written(rows.groupBy("id", "tie", "tie2").agg(F.count("*").alias("n")), "texts")
    firsts = texts.groupBy("tie", "tie2").agg(_first(), F.count("*").alias("k")).where("k > 1")
    firsts = written(firsts.select("tie", "tie2", F.col("best.id").alias("first_id")), "firsts")
    copies = texts.join(small_or_shuffled(firsts), ["tie", "tie2"]).where(~F.col("id").eqNullSafe(F.col("first_id")))
    copies = written(copies.select(*[F.col(c).alias(f"s_{c}") for c in ("id", "tie", "tie2")]), "copies")
    again = written(texts.where("n > 1").select(*[F.col(c).alias(f"s_{c}") for c in ("id", "tie", "tie2")], "n"), "again")
    own = _same_document()
    same = own & (F.col("tie2") == F.col("s_tie2"))
    near_copies, near_again = small_or_shuffled(copies), small_or_shuffled(again)
    single = rows.join(near_copies, same, "left_anti")
    repeated = single.join(near_again, same).groupBy("id", "tie", "tie2", "n").agg(F.first("text").alias("text"))
    base = single.join(near_again.drop("n"), same, "left_anti").unionByName(repeated.drop("n"))

    found = written(anchors(base, window, seed), "anchors")
    seeds = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "seeds")
    hits = written(found.join(seeds, "h"), "hits")
    classes = hits.groupBy("h", "x").agg(_first("at", "last"), F.count("*").alias("n"))
    classes = written(classes.select("h", "x", "best.id", "best.tie", "best.at", "best.last", "n"), "classes")
    shared = classes.where("n > 1").select("h", "x", *[F.col(c).alias(f"first_{c}") for c in ("id", "tie", "at")])
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")) & (F.col("at") == F.col("first_at"))
    whole = hits.join(small_or_shuffled(shared), ["h", "x"]).where(~is_first).select("id", "tie", "at", "last")

    forks = written(classes.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "forks")
    extended = classes.join(small_or_shuffled(forks), "h").select("id", "tie", "at", "last")
    windows = written(window_hashes(base.join(_spans(extended, BROADCAST_BYTES), own), window), "windows")
    shared = windows.groupBy("w1", "w2").agg(_first("at"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select("w1", "w2", *[F.col(f"best.{c}").alias(f"first_{c}") for c in ("id", "tie", "at")]), "shared")
    partly = windows.join(small_or_shuffled(shared), ["w1", "w2"]).where(~is_first).select("id", "tie", "at", F.col("at").alias("last"))

    repeats = _spans(whole.unionByName(partly), 0)  # grows with the corpus, so texts are shuffled at any size
    kept = cut(base.join(repeats, own, "left"), window)
    nothing = F.array().cast("array<struct<at:int,last:int>>").alias("spans")
    gone = rows.join(near_copies, same, "left_semi").select("id", "text", nothing)
    gone = gone.unionByName(repeated.select("id", "text", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).select("id", "text", nothing))
    return kept.unionByName(cut(gone, window))
