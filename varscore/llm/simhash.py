"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles: numpy exclusive-or and bit counts over blocks of two tiles. Distinct fingerprints
are dealt into cells by the population counts of their parts (and, where sets are compared, by their size). The
distance of two fingerprints is at least the sum of the differences of their population counts, so only cells within
the radius meet; other tile pairs are skipped. A tile pair yields a spanning forest of its links, never all pairs.

Nulls and empty texts have the fingerprint zero and are linked like any other. Texts of fewer words than a shingle give
the whole sequence as one shingle. Equal texts share one fingerprint, so copies never meet pairwise. Rows that repeat
an id count as one document; rows without an id take part, but a class is named by its smallest id that is not null.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.llm.common import col, components, fresh, narrow, shuffle_partitions, small_or_shuffled, texts_of, written

#: Fingerprints per tile, and per tile where candidates for a similarity join are searched.
TILE, WIDE_TILE = 4096, 8192
#: The eight bits of each byte, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
#: Bands of set size within the ratio that the similarity allows.
BANDS = 4
#: Sets compared at once, and shingles per product, where similarities are computed exactly.
BLOCK, SLICE = 2048, 512
#: Hits kept before a tile pair reduces them to a forest.
HITS = 1_000_000


def shingle_hashes(data: bytes, words: int, seed=42):
    """XXH64 of each shingle of a text, in order, with its lower-cased (A-Z) ASCII-split words joined by spaces."""
    tokens = data.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(tokens), len(tokens)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n - words + 1)


def mix(h: np.ndarray, k: int) -> np.ndarray:
    """Word k of a longer hash: the shingle hash itself, then bijective remixes of it with odd constants."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray, n_words: int) -> list:
    """The fingerprint's 64-bit words: a bit is set if it is set in over half the hashes."""
    n_bytes = 8 * n_words
    byte_counts = np.zeros(256 * n_bytes, np.int64)
    for at in range(0, len(h), 16384):
        part = np.stack([mix(h[at : at + 16384], k) for k in range(n_words)], axis=1).astype("<u8")
        places = part.view(np.uint8).reshape(-1, n_bytes) + 256 * np.arange(n_bytes)
        byte_counts += np.bincount(places.ravel(), minlength=256 * n_bytes)
    counts = byte_counts.reshape(n_bytes, 256).astype(float) @ BITS  # set bits of each place, exact in doubles
    return np.packbits(2 * counts > len(h), axis=1, bitorder="little").ravel().view("<u8").tolist() if len(h) else [0] * n_words


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", words=3, bits=64, distinct=False) -> DataFrame:
    """Rows (id, fp, size): hexadecimal SimHash over word shingles and the number of shingles.

    `distinct` counts each different shingle once. `bits` is a multiple of 64.
    """
    work = narrow(docs, id_col, text_col)
    return _prints(work, words, bits, distinct)


def _prints(work: DataFrame, words, bits, distinct) -> DataFrame:
    """Fingerprints of rows (id, text)."""

    def run(batches):
        for batch in batches:
            fps, sizes = [], []
            for data in texts_of(batch.column(1)):
                h = shingle_hashes(data, words)
                h = np.unique(h) if distinct else h
                fps.append("".join(f"{x:016x}" for x in majority(h, bits // 64)))
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.string()), pa.array(sizes, pa.int64())], names=["id", "fp", "size"])

    return work.mapInArrow(run, f"id {work.schema['id'].dataType.simpleString()}, fp string, size long")


def decode(blob: bytes, n_words: int) -> np.ndarray:
    return np.frombuffer(blob, ">u8").astype(np.uint64).reshape(-1, n_words)


def in_hex(blob: bytes, rows, n_words: int) -> list:
    """Rows of a tile as hexadecimal fingerprints."""
    w = 8 * n_words
    return [blob[k * w : (k + 1) * w].hex() for k in rows.tolist()]


def hits(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Blocks of (i, j, distance) with distance <= radius between rows of two tiles (i < j within one tile)."""
    step = max(1, 262144 // max(1, len(b)))
    other = np.ascontiguousarray(b.T)
    for at in range(0, len(a), step):
        block = a[at : at + step]
        distance = np.bitwise_count(block[:, None, 0] ^ other[0]).astype(np.uint16)
        for k in range(1, a.shape[1]):
            distance += np.bitwise_count(block[:, None, k] ^ other[k])
        i, j = np.nonzero(distance <= radius)
        d = distance[i, j]
        i = i + at
        if same:
            keep = i < j
            i, j, d = i[keep], j[keep], d[keep]
        if len(i):
            yield i, j, d


def forest(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Indices of a minimum spanning forest of the weighted links (Boruvka rounds on arrays)."""
    label, chosen, index = np.arange(n), [], np.arange(len(i))
    while len(index):
        li, lj = label[i[index]], label[j[index]]
        index = index[li != lj]
        if not len(index):
            break
        li, lj = label[i[index]], label[j[index]]
        key = d[index].astype(np.int64) * len(i) + index  # all different, so no cycles but mutual choices
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, li, key)
        np.minimum.at(best, lj, key)
        picked = np.unique(best[best < np.iinfo(np.int64).max]) % len(i)
        chosen.append(picked)
        parent = np.arange(n)
        mine = best[li] == key
        parent[li[mine]] = lj[mine]
        mine = best[lj] == key
        parent[lj[mine]] = li[mine]
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.arange(n)[mutual]
        while (jumped := parent[parent]).tobytes() != parent.tobytes():
            parent = jumped
        label = parent[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def tile_forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """A spanning forest of the links between two tiles as index pairs."""
    offset = 0 if same else len(a)
    n = len(a) if same else len(a) + len(b)
    held = [np.zeros(0, np.int64)] * 3

    def reduced():
        keep = forest(*held, n)
        return [x[keep] for x in held]

    for i, j, d in hits(a, b, radius, same):
        held = [np.concatenate(x) for x in zip(held, (i, j + offset, d.astype(np.int64)))]
        if len(held[0]) > HITS:
            held = reduced()
    held = reduced()
    return held[0], held[1] - offset


def cells(nodes: DataFrame, radius: int, parts: int, size_ratio=None) -> DataFrame:
    """Add `cell` to rows (fp, size): the population counts of the parts and the band of the size.

    Sizes of two sets with a Jaccard similarity of `size_ratio` or more lie in bands that are at most BANDS apart.
    """
    names = nodes.columns

    def run(batches):
        for batch in batches:
            out = []
            for fp, size in zip(batch.column("fp").to_pylist(), batch.column("size").to_pylist()):
                width = len(fp) // parts if parts else 0
                counts = [int(fp[k * width : (k + 1) * width], 16).bit_count() for k in range(parts)]
                band = 0 if size_ratio is None else int(np.floor(np.log(max(size, 1)) / -np.log(size_ratio) * (BANDS - 1e-6)))
                out.append(" ".join(map(str, [band, *counts])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(run, f"{schema}, cell string")


def partners(cell: str, radius: int, sized: bool) -> list:
    """The cells from `cell` on, in their order, whose population counts differ by the radius at most."""
    band, *own = map(int, cell.split())
    shifts = [()]
    for _ in own:
        shifts = [s + (x,) for s in shifts for x in range(-radius, radius + 1) if sum(map(abs, s)) + abs(x) <= radius]
    out = []
    for step, shift in itertools.product(range(BANDS + 1) if sized else (0,), shifts):
        if (step, shift) >= (0, (0,) * len(own)):
            other = [a + b for a, b in zip(own, shift)]
            if min(other, default=0) >= 0:
                out.append(" ".join(map(str, [band + step, *other])))
    return out


def parts_for(count: int, bits: int, radius: int) -> int:
    """Parts whose population counts are told apart: more fingerprints, more and smaller cells; 0 where the radius is
    too wide for population counts to rule anything out. The result is the same for any number."""
    if radius * 4 > bits:
        return 0
    return next((p for p, most in ((1, 2**17), (2, 2**22), (4, 2**29)) if count <= most), 8)


def tile_pairs(nodes: DataFrame, radius: int, parts: int, size_ratio=None, tile=TILE) -> DataFrame:
    """Rows (left, right, fps_l, fps_r) of all tile pairs that may hold a link.

    The right tile of each pair is sent once, to where its left tiles are; the pairs of a left tile share that one.
    """
    dealt = written(cells(nodes.select("fp", "size"), radius, parts, size_ratio), "cells")
    counts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("k"))
    tiles = dealt.join(counts, "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), "k"))
    tiles = tiles.groupBy("cell", "sub").agg(F.unhex(F.array_join(F.array_sort(F.collect_list("fp")), "")).alias("fps"))
    tiles = written(tiles.select(F.concat_ws("#", "cell", "sub").alias("tile"), "cell", "fps"), "tiles")
    sized = size_ratio is not None

    def near(batches):
        for batch in batches:
            left, cell = [], []
            for tile, own in zip(*(c.to_pylist() for c in batch.columns)):
                found = partners(own, radius, sized)
                left += [tile] * len(found)
                cell += found
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(cell, pa.string())], names=["left", "cell"])

    wanted = tiles.select("tile", "cell").mapInArrow(near, "left string, cell string")
    pairs = wanted.join(tiles.select(F.col("tile").alias("right"), "cell"), "cell")
    own = F.substring_index("left", "#", 1) == F.col("cell")
    pairs = written(pairs.where(~own | (F.col("left") <= F.col("right"))).select("left", "right"), "pairs")
    sent = pairs.join(tiles.select(F.col("tile").alias("right"), F.col("fps").alias("fps_r")), "right")
    sent = sent.repartition(shuffle_partitions(nodes) * 4, "left")
    own = tiles.select(F.col("tile").alias("left"), F.col("fps").alias("fps_l")).hint("shuffle_hash")
    return sent.join(own, "left").select("left", "right", "fps_l", "fps_r")


def links(nodes: DataFrame, radius: int, bits=64, size_ratio=None) -> DataFrame:
    """Links (a, b) between distinct fingerprints: in each tile pair a spanning forest of those within the radius."""
    n_words = bits // 64

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                same = row["left"] == row["right"]
                a, b = decode(row["fps_l"], n_words), decode(row["fps_r"], n_words)
                i, j = tile_forest(a, b, radius, same)
                left, right = in_hex(row["fps_l"], i, n_words), in_hex(row["fps_r"], j, n_words)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])

    pairs = tile_pairs(nodes, radius, parts_for(nodes.count(), bits, radius), size_ratio)
    return pairs.mapInArrow(run, "a string, b string")


def classes(docs: DataFrame, id_col="doc_id", text_col="text", words=3, bits=64, radius=3) -> DataFrame:
    """One row per document: id, fingerprint and component_id, the smallest id reachable over links."""
    prints = written(fingerprints(docs, id_col, text_col, words, bits).select("id", "fp", "size"), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.max("size").alias("size")), "nodes")
    roots = written(components(links(nodes, radius, bits)), "roots")
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    smallest = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    owner = written(named.join(smallest, "root").select("fp", "component_id"), "owner")
    return prints.join(owner, "fp").select("id", F.col("fp").alias("fingerprint"), "component_id")


# Near-duplicates by similarity: candidates within a wide radius, then the exact Jaccard similarity of the shingle sets.


def exact_links(sets: list, candidates: list, threshold: float):
    """Index pairs (a spanning forest) of sets with a Jaccard similarity of `threshold` or more.

    `candidates` are lists of set indices that may be alike. Intersections of a list come from products of 0/1 matrices
    over slices of the shared shingles, block by block, so a large group of copies costs no pairwise loop and the memory
    is bounded by a block times the two tiles.
    """
    for members in candidates:
        size = np.array([len(sets[m]) for m in members])
        values, owner = np.concatenate([sets[m] for m in members]), np.repeat(np.arange(len(members)), size)
        _, shingle, often = np.unique(values, return_inverse=True, return_counts=True)
        shared = often > 1
        column = np.cumsum(shared) - 1
        keep = shared[shingle]
        owner, shingle = owner[keep], column[shingle[keep]]
        order = np.argsort(shingle, kind="stable")
        owner, shingle = owner[order], shingle[order]
        found = [[np.zeros(0, np.int64), np.zeros(0, np.int64)]]
        for top in range(0, len(members), BLOCK):
            rest, block = len(members) - top, min(BLOCK, len(members) - top)
            both = np.zeros((block, rest), np.float32)
            for at in range(0, int(shared.sum()), SLICE):
                a, b = np.searchsorted(shingle, [at, at + SLICE])
                here = owner[a:b] >= top
                part = np.zeros((rest, SLICE), np.float32)
                part[owner[a:b][here] - top, shingle[a:b][here] - at] = 1
                both += part[:block] @ part.T
            total = size[top : top + block, None] + size[None, top:]
            i, j = np.nonzero(np.triu(both >= threshold * (total - both) - 1e-3, 1))
            exact = both[i, j].astype(np.int64)
            good = exact >= threshold * (total[i, j] - exact)
            found.append([i[good] + top, j[good] + top])
            if len(found) > 1 and sum(len(x) for x, _ in found) > HITS:
                i, j = (np.concatenate(x) for x in zip(*found))
                least = forest(i, j, np.zeros(len(i), np.int64), len(members))
                found = [[i[least], j[least]]]
        i, j = (np.concatenate(x) for x in zip(*found))
        kept = forest(i, j, np.zeros(len(i), np.int64), len(members))
        for k in kept.tolist():
            yield members[i[k]], members[j[k]]


def groups_of(i, j, n):
    """Connected index groups (of two or more) of the links i-j."""
    label = np.arange(n)
    kept = forest(i, j, np.zeros(len(i), np.int64), n)
    for a, b in zip(i[kept].tolist(), j[kept].tolist()):
        label[label == label[b]] = label[a]
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    return [g.tolist() for g in np.split(order, cuts) if len(g) > 1]


def keyed(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id, text) whose `id` is a struct (no_id, id, tie, tie2): the order of documents, and all that tells two apart
    where ids are missing or repeat. The ties are hashes of the text."""
    rows = narrow(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", F.xxhash64(text).alias("tie"), F.xxhash64(F.lit(1), text).alias("tie2"))
    return rows.select(own.alias("id"), "text")


def similar_classes(docs: DataFrame, id_col="doc_id", text_col="text", words=5, threshold=0.8, bits=256, radius=76) -> DataFrame:
    """One row per document: id, component_id and `key`, `first`, over links of a Jaccard similarity of `threshold` or more.

    A document is an id with a text: rows without an id take part, and different texts under one id are different documents.
    `key` is the struct of `keyed` for the row, `first` that of the document its class keeps; component_id is the id in it.

    SimHash over the set of shingles finds the candidates: at similarity 0.8 two 256-bit fingerprints differ in 39 bits
    on average with a deviation of 5.7 (48 and 6.2 for sets of four and five), unrelated ones in 128 with 8. A radius of
    76 is more than four deviations from each. The exact similarity decides. Only documents with a candidate bring their
    shingle sets, once per tile pair in which they have one. Texts with one 256-bit fingerprint are taken for one set.
    """
    n_words = bits // 64
    rows = keyed(docs, id_col, text_col)
    prints = written(_prints(rows, words, bits, distinct=True), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.max("size").alias("size")), "nodes")

    def candidates(batches):
        for batch in batches:
            for row in batch.to_pylist():
                same = row["left"] == row["right"]
                i, j = tile_forest(decode(row["fps_l"], n_words), decode(row["fps_r"], n_words), radius, same)
                found = sorted({*in_hex(row["fps_l"], i, n_words), *in_hex(row["fps_r"], j, n_words)})
                pair = [f"{row['left']}|{row['right']}"] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.string()), pa.array(found, pa.string())], names=["pair", "fp"])

    pairs = tile_pairs(nodes, radius, parts_for(nodes.count(), bits, radius), threshold, WIDE_TILE)
    found = written(pairs.mapInArrow(candidates, "pair string, fp string"), "candidates")
    wanted = written(found.select("fp").distinct().join(nodes.select("fp", F.col("first").alias("id")), "fp").select("fp", "id"), "wanted")

    def sets(batches):
        for batch in batches:
            out = [np.unique(shingle_hashes(data, words)).astype("<u8").tobytes() for data in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["fp", "shingles"])

    ties = [F.col(f"id.{c}").alias(c) for c in ("tie", "tie2")]
    near = small_or_shuffled(wanted.select("fp", F.col("id.id").alias("w_id"), *[t.alias(f"w_{n}") for n, t in zip(("tie", "tie2"), ties)]))
    same = F.col("id.id").eqNullSafe(F.col("w_id")) & (F.col("id.tie") == F.col("w_tie")) & (F.col("id.tie2") == F.col("w_tie2"))
    picked = rows.join(near, same).select("fp", "text")
    shingles = written(picked.mapInArrow(sets, "fp string, shingles binary").groupBy("fp").agg(F.max("shingles").alias("shingles")), "sets")

    def verify(table):
        fps = table.column("fp").to_pylist()
        hashes = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        points = decode(bytes.fromhex("".join(fps)), n_words)
        groups = groups_of(*tile_forest(points, points, radius, True), len(fps))
        found = list(exact_links(hashes, groups, threshold))
        return pa.table({"a": pa.array([fps[x] for x, _ in found], pa.string()), "b": pa.array([fps[y] for _, y in found], pa.string())})

    linked = found.join(shingles, "fp").groupBy("pair").applyInArrow(verify, "a string, b string")
    roots = written(components(linked), "roots")
    named = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "named")
    smallest = written(named.groupBy("root").agg(F.min("first").alias("first")), "smallest")
    owner = written(named.drop("first").join(smallest, "root").select("fp", "first"), "owner")
    return prints.join(owner, "fp").select("id.id", F.col("first.id").alias("component_id"), F.col("id").alias("key"), "first")


def drop_near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """`docs` with one document of each class, the one with the smallest id (null ids last, then by a hash of the text); its
    columns are unchanged. Rows go by id and text, so another text under the same id is not affected; rows that repeat both
    are one document and stay or go together."""
    found = similar_classes(docs, id_col, text_col, **options).where("key <> first")
    names = {n: fresh(docs, n) for n in ("own", "d_id", "d_tie", "d_tie2")}
    dropped = found.select("key.id", "key.tie", "key.tie2").distinct().toDF(names["d_id"], names["d_tie"], names["d_tie2"])
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    same = col(id_col).eqNullSafe(F.col(names["d_id"]))
    same &= (F.xxhash64(text) == F.col(names["d_tie"])) & (F.xxhash64(F.lit(1), text) == F.col(names["d_tie2"]))
    return docs.join(small_or_shuffled(written(dropped, "dropped")), same, "left_anti")
