"""Word-frequency divergence of the sources of each language, by single-pass in-memory indexing.

1. A task reads its documents once and adds the terms of each to a block of postings in memory. When the block holds
   RUN_TERMS entries it is spilled as a run: for every hash shard of the terms, in the order of (lang, term), the number of
   documents and the occurrences in each source, compressed in chunks.
2. The runs of a shard are merged by a heap, chunk by chunk; equal terms come together, their postings are added up, and
   terms in fewer than `min_docs` documents of their language end there. What is left is the table of frequencies.
3. Smoothed frequencies are whole numbers p = 1 + floor(10^9 (count + a) / (N + a V)). For two sources the sum of |p - q|
   over all V terms is V times the difference of their values for count 0, plus corrections for the terms that either of
   them has. Corrections are streamed by term shards and blocks of sources and added up by Spark.

Null text, lang and source count as ''. Terms are runs of ASCII letters and non-ASCII characters; only A-Z are lower-cased.
Rows that repeat are counted singly; doc_id plays no part, so it may be null or missing. A group without terms takes part.
An empty table gives no rows. Documents are read as they come, one at a time, so a very long one only takes its own
memory. A run has at most one posting per term and source, so that no frequent term weighs on one shard.
"""

import heapq
from collections import Counter
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varscore.llm.common import col, small_or_shuffled, values_of, written

#: Entries of the index in memory (terms of documents), terms of a chunk of a run, bytes of text for one hash shard.
RUN_TERMS, CHUNK, SHARD_BYTES = 2_000_000, 4096, 16 << 20
#: Smoothing (added to each count), scale of the frequencies, and documents a term must have.
ADDED, SCALE, MIN_DOCS = 5, 1_000_000_000, 30
#: Sources of a block, frequencies of a shard of corrections, and numbers of one difference array.
SOURCES, FREQUENCIES, CELLS = 512, 20_000, 1 << 22
#: Bytes of terms, A-Z lower-cased; all others separate terms.
_TABLE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in bytes(range(256)).lower())
_RUN = "shard int, run string, chunk int, data binary"


def packed(keys, docs, ends, sources, counts) -> bytes:
    """A chunk of a run: terms in order, their documents, and their postings, which end at `ends`."""
    offsets = pa.array(np.append(0, ends), pa.int32())
    used, codes = np.unique(sources.indices.to_numpy(), return_inverse=True)
    named = pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), sources.dictionary.take(pa.array(used)))
    columns = [keys, pa.array(docs), pa.ListArray.from_arrays(offsets, named), pa.ListArray.from_arrays(offsets, pa.array(counts))]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "docs", "sources", "counts"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def distinct(x: np.ndarray, size: int):
    """The different values of whole numbers below `size`, in order, and the place of each number among them."""
    if size > 16 * len(x):
        return np.unique(x, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]


class Chunk:
    """The postings of a chunk, read one term at a time."""

    def __init__(self, data: bytes):
        with pa.ipc.open_stream(data) as reader:
            (batch,) = reader
        self.keys, self.docs = values_of(batch.column(0)), batch.column(1).to_numpy().tolist()
        sources, counts = batch.column(2), batch.column(3)
        self.offsets, self.names = sources.offsets.to_numpy(), sources.values.dictionary.to_pylist()
        self.codes, self.counts = sources.values.indices.to_numpy(), counts.values.to_numpy()

    def add(self, k: int, total: Counter):
        for at in range(self.offsets[k], self.offsets[k + 1]):
            total[self.names[self.codes[at]]] += int(self.counts[at])


class Index:
    """Postings in memory, spilled as runs of chunks sorted by term in each shard. A term's key is its language, a zero byte
    (which no term has) and the term."""

    def __init__(self, shards: int):
        self.shards, self.terms, self.counts, self.groups, self.sizes = shards, [], [], [], []

    def add(self, lang: bytes, source: bytes, text: bytes):
        found = Counter(text.translate(_TABLE).split())
        self.terms += found
        self.counts += found.values()
        self.groups.append((lang, source))
        self.sizes.append(len(found))

    def spill(self):
        """(shard, chunk number, data) of one run; the index is empty afterwards."""
        coded = pa.array(self.terms, pa.binary()).dictionary_encode()
        doc, counts = np.repeat(np.arange(len(self.sizes)), self.sizes), np.array(self.counts, np.int64)
        langs, sources = (pa.array([g[k] for g in self.groups], pa.binary()).dictionary_encode() for k in (0, 1))
        self.terms, self.counts, self.groups, self.sizes = [], [], [], []
        if not len(doc):
            return
        width, lang, source = len(coded.dictionary), langs.indices.to_numpy()[doc].astype(np.int64), sources.indices.to_numpy()[doc]
        pairs, where = distinct(lang * width + coded.indices.to_numpy(), len(langs.dictionary) * width)
        names, words = values_of(langs.dictionary), values_of(coded.dictionary)
        keys = [names[p // width] + b"\0" + words[p % width] for p in pairs.tolist()]
        shard = np.fromiter((xxhash.xxh3_64_intdigest(k) % self.shards for k in keys), np.int64, len(keys))
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        order = order[np.argsort(shard[order], kind="stable")]  # by shard, then by key
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs = np.bincount(place[where], minlength=len(order))  # a document has one entry for each of its terms
        postings, at = distinct(place[where] * len(sources.dictionary) + source, len(order) * len(sources.dictionary))
        counts = np.bincount(at, counts).astype(np.int64)
        owner, source = postings // len(sources.dictionary), (postings % len(sources.dictionary)).astype(np.int32)
        keys, shard = pa.array(keys, pa.binary()).take(pa.array(order)), shard[order]
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            for k, first in enumerate(range(a, b, CHUNK)):
                last = min(b, first + CHUNK)
                start, end = np.searchsorted(owner, [first, last])
                ends = np.searchsorted(owner, np.arange(first + 1, last + 1)) - start
                named = pa.DictionaryArray.from_arrays(pa.array(source[start:end]), sources.dictionary)
                yield int(shard[a]), k, packed(keys[first:last], docs[first:last], ends, named, counts[start:end])


def indexed(docs: DataFrame, shards: int, run_terms=RUN_TERMS) -> DataFrame:
    """Runs of postings (shard, run, chunk, data) of rows (lang, source, text)."""

    def run(batches):
        index, part, number = Index(shards), TaskContext.get().partitionId(), 0

        def spilled():
            for shard, k, data in index.spill():
                row = [pa.array([shard], pa.int32()), pa.array([f"{part}.{number}"]), pa.array([k], pa.int32()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["shard", "run", "chunk", "data"])

        for batch in batches:
            for lang, source, text in zip(*[c.cast(pa.binary()).to_pylist() for c in batch.columns]):
                index.add(lang, source, text)
                if len(index.terms) >= run_terms:
                    yield from spilled()
                    number += 1
        yield from spilled()

    return docs.select("lang", "source", "text").mapInArrow(run, _RUN)


def merged(runs: DataFrame, min_docs=MIN_DOCS) -> DataFrame:
    """Frequencies (lang, term, source, n) of the terms in at least `min_docs` documents of their language."""
    names = ["lang", "term", "source", "n"]

    def stream(number, way):
        for _, data in sorted(way):
            chunk = Chunk(data)
            for k, (key, docs) in enumerate(zip(chunk.keys, chunk.docs)):
                yield key, number, docs, chunk, k

    def merge(table):
        ways = {}
        for run, chunk, data in zip(*[table.column(c).to_pylist() for c in ("run", "chunk", "data")]):
            ways.setdefault(run, []).append((chunk, data))
        out = []
        for key, rows in groupby(heapq.merge(*[stream(i, way) for i, way in enumerate(ways.values())]), key=itemgetter(0)):
            rows = list(rows)  # one of each run at most
            if sum(row[2] for row in rows) >= min_docs:
                total = Counter()
                for row in rows:
                    row[3].add(row[4], total)
                lang, _, term = key.rpartition(b"\0")
                out += [(lang, term, source, n) for source, n in total.items()]
        columns = list(zip(*out)) or [[]] * 4
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    found = runs.groupBy("shard").applyInArrow(merge, "lang binary, term binary, source binary, n long")
    return found.select(*[F.col(c).cast("string").alias(c) for c in names[:3]], "n")


def smoothed(count, total, terms):
    """p = 1 + floor(SCALE (count + ADDED) / (total + ADDED terms)), in exact decimals."""
    wide = [c.cast("decimal(20,0)") for c in (count, total, terms)]
    return F.expr("1L") + F.call_function("div", (wide[0] + ADDED) * F.lit(SCALE), wide[1] + wide[2] * ADDED)


def corrections(freqs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, i, j, value) for i < j: the sum over terms of |p - q| less that of the sources' values for count 0.

    `freqs` are (lang, term, i, p), `groups` are (lang, i, base). Each group of the shuffle has the frequencies of a shard of
    terms for two blocks of sources, so neither many terms nor many sources meet in one task.
    """
    shards = max(1, -(-freqs.count() // FREQUENCIES))
    blocks = F.sequence(F.lit(0), F.floor((F.col("size") - 1) / SOURCES).cast("int"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("size"))
    sizes = small_or_shuffled(written(sizes, "sizes"))
    own = F.floor(F.col("i") / SOURCES).cast("int")
    keys = F.explode(F.transform(blocks, lambda b: F.struct(F.least(b, own).alias("bi"), F.greatest(b, own).alias("bj"))))
    left = freqs.join(sizes, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")).withColumn("k", keys)
    left = left.select("lang", "shard", "k.bi", "k.bj", "term", "i", "p")
    right = groups.join(sizes, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("k", keys)
    right = right.select("lang", "shard", "k.bi", "k.bj", "i", "base")

    def add(freqs, groups):
        empty = pa.table({"lang": pa.array([], pa.string()), "i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "value": pa.array([], pa.int64())})
        if not freqs.num_rows:
            return empty
        lang, bi, bj = (groups.column(c)[0].as_py() for c in ("lang", "bi", "bj"))
        i, base = groups.column("i").to_numpy(), groups.column("base").to_numpy()
        order = np.argsort(i)
        i, base = i[order], base[order]
        rows, columns = np.flatnonzero(i // SOURCES == bi), np.flatnonzero(i // SOURCES == bj)
        place = np.searchsorted(i, freqs.column("i").to_numpy())
        term = freqs.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        p, order = freqs.column("p").to_numpy(), np.argsort(term, kind="stable")
        term, place, p = term[order], place[order], p[order]
        n = int(term[-1]) + 1
        apart = np.abs(base[rows][:, None] - base[columns][None, :])
        total = np.zeros(apart.shape, np.int64)
        step = max(1, CELLS // apart.size)
        for at in range(0, n, step):
            a, b = np.searchsorted(term, [at, at + step])
            dense = np.tile(base, (min(step, n - at), 1))
            dense[term[a:b] - at, place[a:b]] = p[a:b]
            total += np.abs(dense[:, rows][:, :, None] - dense[:, columns][:, None, :]).sum(axis=0) - len(dense) * apart
        r, c = np.nonzero(i[rows][:, None] < i[columns][None, :])
        return pa.table({"lang": pa.array([lang] * len(r), pa.string()), "i": i[rows][r], "j": i[columns][c], "value": total[r, c]})

    key = ["lang", "shard", "bi", "bj"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(add, "lang string, i long, j long, value long")
    return found.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", min_docs=MIN_DOCS, top=50, run_terms=RUN_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part `pair`: the sum of |p - q| over all kept terms, for each other source of the language. Part `term`: the `top` terms
    that the source has and uses more than its language does, by p - q.
    """
    text = {"lang": lang_col, "source": source_col, "text": text_col}
    rows = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for n, c in text.items()])
    sized = rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sized = written(sized, "groups")
    shards = max(1, -(-(sized.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    runs = written(indexed(rows, shards, run_terms), "runs")
    freqs = written(merged(runs, min_docs), "frequencies")
    terms = written(freqs.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = freqs.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = sized.select("lang", "source").join(totals, ["lang", "source"], "left").join(small_or_shuffled(written(langs, "langs")), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"), F.coalesce("lang_total", zero).alias("lang_total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row per source
    base = F.when(F.col("v") > 0, smoothed(F.lit(0), F.col("total"), F.col("v"))).otherwise(0).cast("long")
    groups = written(groups.withColumn("i", place.cast("long")).withColumn("base", base), "sources")
    near = small_or_shuffled(groups)
    known = freqs.join(near, ["lang", "source"])
    known = written(known.select("lang", "term", "source", "i", "total", "v", "lang_total", "n", smoothed(F.col("n"), F.col("total"), F.col("v")).alias("p")), "known")
    by = [F.col("value").desc(), "item"]

    used = known.join(small_or_shuffled(terms), ["lang", "term"])
    used = used.select("lang", "source", F.col("term").alias("item"), (F.col("p") - smoothed(F.col("lang_n"), F.col("lang_total"), F.col("v"))).alias("value"))
    most = used.where("value > 0").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by)))
    most = most.where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    added = corrections(known.select("lang", "term", "i", "p"), groups.select("lang", "i", "base"))
    added = written(added.unionByName(added.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value")), "corrections")
    other = groups.select("lang", F.col("i").alias("j"), F.col("source").alias("item"), F.col("base").alias("other"))
    pairs = groups.join(other, "lang").where("i <> j").join(added, ["lang", "i", "j"], "left")  # as many rows as the result has
    value = (F.col("v") * F.abs(F.col("base") - F.col("other")) + F.coalesce(F.col("value"), zero)).alias("value")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by)))
    return pairs.unionByName(most)
