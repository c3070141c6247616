"""Collocations by set-oriented mining of occurrence relations (SETM).

R1, the relation of all word occurrences (piece, place, word), is written sorted by piece and place; a row of the table holds
the occurrences of whole pieces of one language as packed columns, with their words as indices into the row's own vocabulary.
Level by level:

1. R(k) is the merge join of R(k-1) with itself on equal piece and adjacent place; pieces do not span rows, so it is a join
   of sorted arrays inside a task.
2. Its groups are counted by 40-bit hashes, which are dealt to ranges and added up range by range; those that reach `least` go
   into a bitmap of BITS bits at most.
3. The semi-join of R(k) with the bitmap is written: the relation that the next level extends. What the bitmap lets through
   by chance falls in the next step, so its size only matters for speed.
4. The exact phrases of the written relation are counted per row, then range by range of their hashes over all rows; L(k) has
   those that reach `least`.

Text is lower-cased (A-Z), cut into pieces at ASCII punctuation and line ends, and into words at spaces and tabs; null text is
empty, a null language is `und`. Rows that repeat are counted singly; doc_id plays no part. An empty table gives no rows. A very
long text is dealt to several rows, at the end of a piece, or within one, with the words after the cut as context that extends
phrases but is not counted. Every count covers all occurrences.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varscore.llm.common import col, small_or_shuffled, values_of, written

#: Bytes of text of a row of R1, bytes held by a task over all languages, and bits of a bitmap at most.
ROW_BYTES, HELD_BYTES, BITS = 1 << 20, 8 << 20, 1 << 27
#: Hashes, or phrases, that a task adds up before it passes them on, and occurrences in a range of hashes.
GATHERED, RANGE = 400_000, 4_000_000
#: Words of a phrase at most, occurrences of a phrase at least, and phrases listed per language.
WORDS, LEAST, TOP = 3, 10, 2000
#: Characters that end a piece, and the name of an unknown language.
ENDS, UNKNOWN = b".,;:!?\n\x0b\x0c\r", "und"
_HASH_BITS = 40
_TABLE = bytes(10 if c in ENDS else 32 if c == 9 else c for c in bytes(range(256)).lower())
_NAMES, _KINDS = ["lang", "vocabulary", "occurrences", "own"], [pa.string(), pa.binary(), pa.binary(), pa.int32()]
_RELATION = "lang string, vocabulary binary, occurrences binary, own int"


def slices(data: bytes, context: int, limit: int):
    """(part, words it owns or None for all) of a translated text, cut after a piece if possible, else after a word."""
    ahead, at = re.compile(rb" *(?:[^ \n]+ *){0,%d}" % context), 0
    while len(data) - at > 2 * limit:
        cut, own = data.rfind(b"\n", at, at + limit) + 1, None
        if cut <= at:
            cut = data.rfind(b" ", at, at + limit)
            if cut <= at:
                found = re.compile(rb"[ \n]").search(data, at + limit)
                cut = found.start() if found else len(data)
            own = len(data[at:cut].split())
        yield data[at:cut] + (ahead.match(data, cut)[0] if own is not None else b""), own
        at = cut
    yield data[at:], None


def relation_row(lang, data: bytes, own):
    """A row of R1 from translated text."""
    tokens = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
    codes, known = tokens.indices.to_numpy(), values_of(tokens.dictionary)
    word = np.array([w not in (b"", b"\n") for w in known], bool)
    ends = np.array([w == b"\n" for w in known], bool)
    if not word.any():
        return None
    mine = word[codes]
    piece = np.cumsum(ends[codes])[mine].astype(np.int32)
    words = (np.cumsum(word) - 1)[codes[mine]].astype(np.int32)
    new = np.append(True, piece[1:] != piece[:-1])
    place = np.arange(len(piece)) - np.maximum.accumulate(np.where(new, np.arange(len(piece)), 0))
    vocabulary = [w for w, x in zip(known, word.tolist()) if x]
    return packed_row(lang, vocabulary, words, piece, place, len(words) if own is None else own)


def packed_row(lang, vocabulary, words, pieces, places, own):
    """A row of a relation: its words in order, piece and place of each occurrence, compressed."""
    columns = (np.asarray(x, np.int32).tobytes() for x in (np.diff(pieces, prepend=0), places, words.ravel()))
    return lang, zstandard.compress(b"\n".join(vocabulary), 1), zstandard.compress(np.int64(len(places)).tobytes() + b"".join(columns), 1), own


def unpacked_row(vocabulary: bytes, occurrences: bytes):
    """(vocabulary, words, pieces, places) of a row."""
    data = zstandard.decompress(occurrences)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    numbers = np.frombuffer(data, np.int32, offset=8)
    return zstandard.decompress(vocabulary).split(b"\n"), numbers[2 * n :], np.cumsum(numbers[:n]), numbers[n : 2 * n]


def batch_of(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def occurrences(docs: DataFrame, context: int, row_bytes=ROW_BYTES) -> DataFrame:
    """R1 of rows (lang, text)."""

    def run(batches):
        held, size = {}, {}

        def rows(lang):
            data = b"\n".join(held.pop(lang)).translate(_TABLE)
            size.pop(lang)
            for part, own in slices(data, context, row_bytes):
                row = relation_row(lang, part, own)
                if row:
                    yield batch_of([row])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= row_bytes:
                    yield from rows(lang)
                elif sum(size.values()) >= HELD_BYTES:
                    for lang in list(held):
                        yield from rows(lang)
        for lang in list(held):
            yield from rows(lang)

    return docs.select("lang", "text").mapInArrow(run, _RELATION)


class Level:
    """The occurrences of phrases of `k` words in one row of a relation."""

    def __init__(self, lang, vocabulary, words, pieces, places, own, k):
        self.lang, self.vocabulary, self.k, self.own = lang, vocabulary, k, own
        self.words, self.key = words.reshape(-1, k), (pieces.astype(np.int64) << 32) | places

    @staticmethod
    def of(batch, k):
        for r in range(batch.num_rows):
            lang, vocabulary, occurrences, own = (column[r].as_py() for column in batch.columns)
            yield Level(lang, *unpacked_row(vocabulary, occurrences), own, k)

    def where(self, keep):
        out = object.__new__(Level)
        out.lang, out.vocabulary, out.k, out.own = self.lang, self.vocabulary, self.k, int(keep[: self.own].sum())
        out.words, out.key = self.words[keep], self.key[keep]
        return out

    def extended(self):
        """The merge join on adjacent places: phrases of one word more."""
        after = np.minimum(np.searchsorted(self.key, self.key + 1), len(self.key) - 1)
        mine = np.flatnonzero(self.key[after] == self.key + 1) if len(self.key) else np.zeros(0, np.int64)
        out = object.__new__(Level)
        out.lang, out.vocabulary, out.k, out.own = self.lang, self.vocabulary, self.k + 1, int((mine < self.own).sum())
        out.words, out.key = np.concatenate([self.words[mine], self.words[after[mine], -1:]], axis=1), self.key[mine]
        return out

    def of_words(self, words: np.ndarray):
        """The same row with other phrases, which have no places."""
        out = object.__new__(Level)
        out.lang, out.vocabulary, out.k, out.own, out.words, out.key = self.lang, self.vocabulary, self.k, len(words), words, None
        return out

    def hashes(self) -> np.ndarray:
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        each = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary], np.uint64)
        h = each[self.words[:, 0]]
        for j in range(1, self.k):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + each[self.words[:, j]]
        return ((h ^ (h >> np.uint64(32))) & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64)

    def counted(self):
        """Different phrases of the owned occurrences as rows of words, and their counts."""
        words, v = self.words[: self.own], len(self.vocabulary)
        code = words[:, 0].astype(np.int64)
        for j in range(1, self.k):
            if len(code) and int(code.max()) >= (1 << 62) // v:
                code = np.unique(code, return_inverse=True)[1]
            code = code * v + words[:, j]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        return words[first], n

    def row(self):
        used, words = np.unique(self.words, return_inverse=True)
        return packed_row(self.lang, [self.vocabulary[i] for i in used.tolist()], words, self.key >> 32, self.key & 0xFFFFFFFF, self.own)


def slots(h: np.ndarray, bits: int):
    """The two places of a hash in a bitmap."""
    return h & (bits - 1), (h >> 13) & (bits - 1)


def inside(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for s in slots(h, 8 * len(bitmap)):
        out &= (bitmap[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
    return out


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the hashes (h): BITS bits at most, whatever their number, so it may be broadcast."""
    bits = min(BITS, max(1 << 15, 1 << (16 * hashes.count()).bit_length()))
    places = F.explode(F.array(*[(x.bitwiseAND(F.lit(bits - 1)) + 1) for x in (F.col("h"), F.shiftrightunsigned("h", 13))])).alias("s")
    chunks = hashes.select(places).groupBy(F.expr("bitmap_bucket_number(s)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("data"))
    out = np.zeros(bits // 8, np.uint8)
    for row in chunks.collect():  # 4 KiB each
        out[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["data"], np.uint8)
    return out


def _summed(h, n):
    """Different hashes in order, and the sums of their counts."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[: len(h)]
    return h[first], np.add.reduceat(n, first) if len(h) else n


def passes(k: int, known, whole: bool):
    """A function from Arrow batches of a relation to the occurrences of phrases of `k` words.

    The relation is R(k) if `whole`, else R(k-1), which is extended. `known` is the pair of the bitmaps of the relation as it
    is (needed for R1 only) and of the result.
    """
    before, now = known

    def occurrences_of(batches):
        for batch in batches:
            for rows in Level.of(batch, k if whole else k - 1):
                if before is not None:
                    rows = rows.where(inside(rows.hashes(), before.value))
                rows = rows if whole else rows.extended()
                yield rows if now is None else rows.where(inside(rows.hashes(), now.value))

    return occurrences_of


def frequent_hashes(relation: DataFrame, occurrences_of, ranges: int, least: int) -> DataFrame:
    """Hashes (h) of the groups that occur `least` times (or that share a hash with others)."""

    def dealt(batches):
        held, size = [], 0

        def flush():
            h, n = _summed(*[np.concatenate(x) for x in zip(*held)])
            cuts = np.searchsorted(h, (np.arange(ranges + 1) << _HASH_BITS) // ranges).tolist()
            full = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            blobs = [zstandard.compress(np.diff(h[a:b], prepend=0).tobytes() + n[a:b].tobytes(), 1) for _, a, b in full]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in full], pa.int32()), pa.array(blobs, pa.binary())], names=["r", "data"])

        for rows in occurrences_of(batches):
            held.append(np.unique(rows.hashes()[: rows.own], return_counts=True))
            size += len(held[-1][0])
            if size >= GATHERED:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def add(table):
        parts = [np.frombuffer(zstandard.decompress(x), np.int64).reshape(2, -1) for x in table.column("data").to_pylist()]
        h, n = _summed(np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]))
        return pa.table({"h": h[n >= least]})

    return relation.mapInArrow(dealt, "r int, data binary").groupBy("r").applyInArrow(add, "h long")


def extended_relation(relation: DataFrame, occurrences_of) -> DataFrame:
    """R(k), semi-joined with its frequent groups."""

    def run(batches):
        for rows in occurrences_of(batches):
            if len(rows.words):
                yield batch_of([rows.row()])

    return relation.mapInArrow(run, _RELATION)


def exact_phrases(relation: DataFrame, occurrences_of, k: int, ranges: int, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases whose owned occurrences reach `least`, each range of their hashes on its own."""

    def dealt(batches):
        held, size = [], 0

        def flush():
            table = pa.concat_tables(held).group_by(["r", "lang", "phrase"]).aggregate([("n", "sum")])
            table = table.select(["r", "lang", "phrase", "n_sum"]).rename_columns(["r", "lang", "phrase", "n"])
            table = table.sort_by([("r", "ascending"), ("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()
            r = table.column("r").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
            blobs = []
            for a, b in zip(cuts, cuts[1:]):
                part, sink = table.slice(a, b - a).drop_columns(["r"]), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(r[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["r", "data"])

        for rows in occurrences_of(batches):
            if not rows.own:
                continue
            words, n = rows.counted()
            known = pa.array(rows.vocabulary, pa.binary())
            parts = [known.take(pa.array(words[:, j])) for j in range(k)]
            phrase = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
            h = rows.of_words(words).hashes()
            lang = pa.array([rows.lang] * len(n), pa.string())
            held.append(pa.table([pa.array((h * ranges >> _HASH_BITS).astype(np.int32)), lang, phrase, pa.array(n)], names=["r", "lang", "phrase", "n"]))
            size += len(n)
            if size >= GATHERED:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def add(table):
        parts = [pa.ipc.open_stream(x).read_all() for x in table.column("data").to_pylist()]
        total = pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        total = total.filter(pc.greater_equal(total.column("n_sum"), least))
        return pa.table([total.column("lang"), total.column("phrase").cast(pa.string()), total.column("n_sum")], names=["lang", "phrase", "f"])

    return relation.mapInArrow(dealt, "r int, data binary").groupBy("r").applyInArrow(add, "lang string, phrase string, f long")


def frequent(docs: DataFrame, words=WORDS, least=LEAST, row_bytes=ROW_BYTES):
    """(phrases, totals): (lang, k, phrase, f) of all phrases of up to `words` words that occur `least` times, and (lang, n)."""
    context = docs.sparkSession.sparkContext
    first = written(occurrences(docs, words - 1, row_bytes), "occurrences")
    totals = written(first.groupBy("lang").agg(F.sum("own").cast("long").alias("n")), "totals")
    ranges = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // RANGE))
    out, relation, before = None, first, None
    for k in range(1, words + 1):
        hashes = frequent_hashes(relation, passes(k, (before, None), k == 1), ranges, least)
        now = context.broadcast(bitmap_of(written(hashes, "hashes")))
        if k > 1:
            relation = written(extended_relation(relation, passes(k, (before, now), False)), "relation")
        phrases = exact_phrases(relation, passes(k, (None, now if k == 1 else None), True), k, 4 * ranges, least)
        phrases = written(phrases.select("lang", F.lit(k).alias("k"), "phrase", "f"), "phrases")
        out = phrases if out is None else out.unionByName(phrases)
        before = now if k == 1 else None  # relations after R1 are already semi-joined
    return out, totals


def _part(first, size):
    """Words first to first + size - 1 of a phrase, by SQL text, `first` from 0."""
    return F.array_join(F.slice(F.split("phrase", " "), first + 1, size), " ")


def collocations(docs: DataFrame, text_col="text", lang_col="lang", words=WORDS, least=LEAST, top=TOP, share=50, row_bytes=ROW_BYTES) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score) of the best phrases of two words or more of each language.

    The score of a cut into two parts is floor(10^6 a a / (l r)); a phrase has that of its lowest cut. Phrases inside a longer
    one that has `share` percent of their occurrences are dropped.
    """
    rows = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    phrases, totals = frequent(rows, words, least, row_bytes)
    named = phrases.where("k > 1")
    cuts = named.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "k", "phrase", F.col("f").alias("a"), "cut", _part(F.lit(0), F.col("cut")).alias("left"), _part(F.col("cut"), F.col("k") - F.col("cut")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        known = phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(known, ["lang", side])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r"))
    cuts = cuts.withColumn("score", F.call_function("div", a * a * F.lit(1_000_000), l * r).cast("long"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = phrases.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("size"))))
    inner = inner.groupBy("lang", _part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    kept = written(kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), "candidates")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)  # a language is never ranked whole
    best = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    best = best.join(small_or_shuffled(totals), "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
