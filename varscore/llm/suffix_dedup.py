"""Removal of repeated passages with suffix arrays.

A byte goes if some string of LENGTH bytes that covers it also starts earlier: in a document with a smaller id, or
earlier in the same one. Documents are dealt to shards, ranges of ids, once. Then:

1. Each shard picks anchors, the smallest KGRAM-byte hash of every window of LENGTH bytes, and cuts its texts into blocks
   of the neighbouring windows with one anchor. Equal windows have equal anchors. Buckets of the anchors' hash tell each
   shard which blocks an earlier shard has too, as a whole, and which anchors stand in different blocks.
2. For anchors that a shard has more than once it builds the suffix array of their blocks by Larsson-Sadakane refinement,
   and common prefixes by Kasai's rule, which decides repeats within the shard.
3. Windows of anchors that stand in different blocks are sent on, each once per shard. Buckets of the windows' hash merge
   the sorted lists of the shards by binary search: what an earlier shard has too is repeated.
4. Each shard gets the places back and cuts its documents.

Copies of whole texts are taken out first: all but the one with the smallest id lose everything. No bucket gets more
than one entry per shard for a passage, however many documents share it.

Texts are whole and UTF-8; nulls and empty texts keep nothing and lose nothing. Documents with null ids come last;
documents with equal ids are ordered by text, so of repeated rows only the first keeps its bytes. Windows of different
shards are compared by 96 bits of hash. Shards and lists only grow in number with the input.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.llm.common import narrow, pieces_by_bytes, small_or_shuffled, written
from varscore.llm.order_minhash import id_ranges

#: Length of a repeated string, bytes of an anchor, and bytes of text a shard is aimed at.
LENGTH, KGRAM, SHARD_BYTES = 100, 32, 1 << 20
#: Bytes of text hashed at a time.
PIECE_BYTES = 65_536
_TABLE = np.random.default_rng(4).integers(0, 1 << 64, (2, 256), np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict = {}
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... (modulo 2^64), kept for the next call."""
    known = _POWERS.get(int(base))
    if known is None or len(known) <= n:
        known = _POWERS[int(base)] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1 << 17), base, np.uint64))])
    return known[: n + 1]


def prefix_sums(t: np.ndarray, table=0):
    """Prefix sums of a polynomial hash, and the powers that bring a difference of two to the same place."""
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(_TABLE[table][t] * powers(_BASE, len(t))[: len(t)], out=sums[1:])
    return sums, powers(_INVERSE, len(t))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def rolling(t: np.ndarray, width: int, table=0) -> np.ndarray:
    """Hashes of all substrings of a width; entry i belongs to t[i : i + width]."""
    sums, down = prefix_sums(t, table)
    return mixed((sums[width:] - sums[:-width]) * down[: len(t) + 1 - width])


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours: entry i covers x[i : i + width]."""
    step = 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


class Shard:
    """The concatenated texts of a shard in document order, and the blocks of windows with one anchor."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i], texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.ends = np.cumsum([len(t) for t in self.texts])
        self.starts = self.ends - [len(t) for t in self.texts]
        self.text = np.frombuffer(b"".join(self.texts), np.uint8)

    def blocks(self):
        """(first window, last window, anchor's hash, block's hash) of the blocks in text order."""
        out = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2]
        long = np.flatnonzero(self.ends - self.starts >= LENGTH).tolist()
        for a, b in pieces_by_bytes([int(self.ends[i] - self.starts[i]) for i in long], PIECE_BYTES):
            docs = long[a:b]
            data = np.frombuffer(b"".join([self.texts[i] for i in docs]), np.uint8)
            sizes = np.array([len(self.texts[i]) for i in docs])
            ends = np.cumsum(sizes)
            first, last, key, block = blocks_of(data, ends - sizes, ends)
            shift = (self.starts[docs] - (ends - sizes))[np.searchsorted(ends, first, side="right")]
            out.append([first + shift, last + shift, key, block])
        return [np.concatenate(x) for x in zip(*out)]


def blocks_of(t: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The blocks of a few documents that lie one after the other in `t`."""
    valid = np.zeros(len(t) - LENGTH + 2, np.int8)
    valid[starts] += 1
    valid[ends - LENGTH + 1] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    sums, down = prefix_sums(t)
    keys = mixed((sums[KGRAM:] - sums[:-KGRAM]) * down[: len(t) + 1 - KGRAM])
    ranked = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    anchor = (sliding(ranked, LENGTH - KGRAM + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    stop = valid & ~np.append(valid[1:] & ~new[1:], False)
    last = np.flatnonzero(stop)
    block = mixed((sums[last + LENGTH] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return first, last, keys[anchor[first]], block


def packed_words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    out = np.zeros(len(t), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(t)]
    return out


def suffix_array(t: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes in order: sorted by their first eight bytes, then groups of ties are refined by the ranks of what
    follows, with doubled depth in each round and only among those still tied."""
    n = len(t)
    sa = np.argsort(words)
    ordered = words[sa]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    depth = 8
    tied = np.flatnonzero(~head | ~np.append(head[1:], True))
    while len(tied):
        p = sa[tied]
        after = np.where(p + depth < n, rank[np.minimum(p + depth, n - 1)] + n, n - p)  # a suffix that ends comes first
        key = (rank[p].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        order = np.argsort(key)
        p, key = p[order], key[order]
        sa[tied] = p
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        rank[p] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        tied = tied[~new | ~np.append(new[1:], True)]
        depth *= 2
    return sa


def common_prefixes(t: np.ndarray, words: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order.

    Kasai's rule: in text order it falls by at most one from a position to the next, and by exactly one where both
    suffixes are preceded by the same byte. Only the other positions are compared, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = (i == 0) | (before <= 0)
    inner = ~fresh
    fresh[inner] = t[i[inner] - 1] != t[before[inner] - 1]
    at = np.flatnonzero(fresh)
    length = np.zeros(len(at), np.int64)
    active = np.flatnonzero(before[at] >= 0)
    while len(active):
        a, b = at[active] + length[active], before[at[active]] + length[active]
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
        x = words[a] ^ words[b]
        same = x == 0
        rest, y = active[~same], x[~same]
        for _ in range(7):
            more = y >> np.uint64(56) == 0
            rest, y = rest[more], y[more] << np.uint64(8)
            length[rest] += 1
        length[active[same]] += 8
        active = active[same]
    other = before[at]
    length = np.minimum(length, n - np.maximum(at, other))
    length[other < 0] = 0
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    slot = np.cumsum(fresh) - 1
    return (length[slot] - (i - last))[sa]


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All window starts of the given blocks."""
    n = last - first + 1
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def covered(starts: np.ndarray) -> np.ndarray:
    """The places of the bytes under the windows (ascending starts)."""
    if not len(starts):
        return starts
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return spread(starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + LENGTH - 1)


def repeats_within(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Those of the (ascending) window starts whose window also starts earlier in the list."""
    if not len(starts):
        return starts
    place = covered(starts)
    t = text[place]
    words = packed_words(t)
    sa = suffix_array(t, words)
    group = np.cumsum(common_prefixes(t, words, sa) < LENGTH)
    mine = np.zeros(len(t), bool)
    mine[np.searchsorted(place, starts)] = True
    sa, group = sa[mine[sa]], group[mine[sa]]
    order = np.lexsort((sa, group))
    sa, group = sa[order], group[order]
    return np.sort(place[sa[1:][group[1:] == group[:-1]]])


def window_hashes(text: np.ndarray, starts: np.ndarray):
    """(64-bit keys, further 32 bits) of the windows."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    place = covered(starts)
    t, at = text[place], np.searchsorted(place, starts)
    return rolling(t, LENGTH)[at], (rolling(t, LENGTH, 1)[at] >> np.uint64(32)).astype(np.uint32)


def squeeze(*arrays) -> bytes:
    """Arrays of one length as a compressed text."""
    return zstandard.compress(np.int64(len(arrays[0])).tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def unsqueeze(data: bytes, *kinds) -> list:
    raw = zstandard.decompress(data)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def bucketed(keys: np.ndarray, bits: int):
    """Ranges of sorted keys by their highest bits: (bucket, start, end)."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, int)
    bounds = [0, *cuts.tolist(), len(keys)]
    return [(b, bounds[b], bounds[b + 1]) for b in range(1 << bits) if bounds[b] < bounds[b + 1]]


def merge(lists: list):
    """Merge sorted lists [keys, checks, owners, places], earlier shards first, by binary search; what the earlier list
    of a pair has too is dropped from the later one. Returns the dropped (owners, places)."""
    owners, places = [], []
    while len(lists) > 1:
        out = []
        for k in range(0, len(lists) - 1, 2):
            a, b = lists[k], lists[k + 1]
            at = np.searchsorted(a[0], b[0])
            inside = np.minimum(at, len(a[0]) - 1)
            twice = (a[0][inside] == b[0]) & (a[1][inside] == b[1])
            owners.append(b[2][twice])
            places.append(b[3][twice])
            at, b = at[~twice], [x[~twice] for x in b]
            out.append([np.insert(x, at, y) for x, y in zip(a, b)])
        lists = out + lists[len(lists) - len(lists) % 2 :] if len(lists) % 2 else out
    return np.concatenate(owners or [np.zeros(0, np.int32)]), np.concatenate(places or [np.zeros(0, np.uint32)])


def _rows(**columns):
    kinds = {"bucket": pa.int32(), "shard": pa.int32(), "kind": pa.int32(), "data": pa.binary()}
    return pa.table({name: pa.array(values, kinds[name]) for name, values in columns.items()})


def pairs_of(key: np.ndarray, block: np.ndarray):
    """Different (key, block) pairs in order, how often their key occurs, and the pair of each entry."""
    order = np.lexsort((block, key))
    k, b = key[order], block[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return k[new], b[new], inverse


def judged(owner: np.ndarray, key: np.ndarray, block: np.ndarray):
    """For pairs of several shards: whether an earlier shard has the pair, and whether its key has other blocks."""
    order = np.lexsort((owner, block, key))
    k, b = key[order], block[order]
    later = np.zeros(len(k), bool)
    later[1:] = (k[1:] == k[:-1]) & (b[1:] == b[:-1])
    edge = np.ones(len(k), bool)
    edge[1:] = k[1:] != k[:-1]
    group = np.cumsum(edge) - 1
    other = (np.bincount(group, weights=~later) > 1)[group]
    out = np.zeros((2, len(k)), bool)
    out[:, order] = later, other
    return out


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", shard_bytes=SHARD_BYTES) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept binary), one per document."""
    rows = narrow(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sized = written(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "sized")
    firsts = written(sized.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "firsts")
    copies = sized.where(F.col("n_bytes") >= LENGTH).join(firsts, "sha").where("first is not null and (id is null or id > first)")
    copies = written(copies.select("id", "n_bytes", "sha"), "copies")
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    bits = (shards // 8).bit_length()
    known = small_or_shuffled(copies.select(F.col("id").alias("c_id"), F.col("sha").alias("c_sha")))
    rows = rows.join(known, F.col("id").eqNullSafe(F.col("c_id")) & (F.sha2("text", 256) == F.col("c_sha")), "left_anti")
    base = rows.withColumn("shard", id_ranges(sized, shards).cast("int")).repartition(max(1, -(-shards // 2)), "shard")

    def anchors(table):
        key, block, _ = pairs_of(*Shard(table).blocks()[2:])
        own, found = table.column("shard")[0].as_py(), bucketed(key, bits)
        blobs = [squeeze(np.diff(key[a:b], prepend=np.uint64(0)), block[a:b]) for _, a, b in found]
        return _rows(bucket=[b for b, _, _ in found], shard=[own] * len(found), data=blobs)

    def repeated(table):
        rows = sorted(zip(table.column("shard").to_pylist(), table.column("data").to_pylist()))
        lists = [unsqueeze(data, np.uint64, np.uint64) for _, data in rows]
        sizes = [len(k) for k, _ in lists]
        key = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in lists])
        owner = np.repeat(np.array([s for s, _ in rows]), sizes)
        later, other = judged(owner, key, np.concatenate([b for _, b in lists]))
        bucket, flags, ends = table.column("bucket")[0].as_py(), (later + 2 * other).astype(np.uint8), np.cumsum(sizes)
        held = [(s, np.flatnonzero(flags[e - n : e]), flags[e - n : e]) for (s, _), n, e in zip(rows, sizes, ends)]
        held = [(s, squeeze(at.astype(np.uint32), f[at])) for s, at, f in held if len(at)]
        return _rows(bucket=[bucket] * len(held), shard=[s for s, _ in held], data=[d for _, d in held])

    def local(left, right):
        if not left.num_rows:
            return _rows(bucket=[], shard=[], kind=[], data=[])
        shard, own = Shard(left), left.column("shard")[0].as_py()
        first, last, key, block = shard.blocks()
        pair_key, _, pair = pairs_of(key, block)
        flags, start = np.zeros(len(pair_key), np.uint8), {b: a for b, a, _ in bucketed(pair_key, bits)}
        for bucket, data in zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()):
            at, f = unsqueeze(data, np.uint32, np.uint8)
            flags[start[bucket] + at.astype(np.int64)] = f
        later, other = (flags & 1 > 0)[pair], (flags & 2 > 0)[pair]
        _, inverse, often = np.unique(key, return_inverse=True, return_counts=True)
        twice = (often > 1)[inverse]
        again = repeats_within(shard.text, spread(first[twice], last[twice]))
        decided = np.union1d(again, spread(first[later], last[later]))
        ask = other & ~later
        ask = np.setdiff1d(spread(first[ask], last[ask]), again, assume_unique=True)
        key, check = window_hashes(shard.text, ask)
        order = np.argsort(key)
        key, check, ask = key[order], check[order], ask[order].astype(np.uint32)
        parts = bucketed(key, bits)
        blobs = [squeeze(key[a:b], check[a:b], ask[a:b]) for _, a, b in parts]
        decided = squeeze(np.diff(decided, prepend=0).astype(np.uint32))
        return _rows(bucket=[*[b for b, _, _ in parts], own % (1 << bits)], shard=[own] * (len(parts) + 1), kind=[0] * len(parts) + [1], data=[*blobs, decided])

    def across(table):
        out, held, lists = [], [], []
        for row in sorted(table.to_pylist(), key=lambda r: r["shard"]):
            if row["kind"]:
                out.append(row["shard"])
                held.append(row["data"])
            else:
                key, check, place = unsqueeze(row["data"], np.uint64, np.uint32, np.uint32)
                lists.append([key, check, np.full(len(key), row["shard"], np.int32), place])
        owners, places = merge(lists)
        order = np.lexsort((places, owners))
        owners, places = owners[order], places[order].astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners)) + 1
        for part, own in zip(np.split(places, cuts), np.split(owners, cuts)):
            if len(part):
                out.append(int(own[0]))
                held.append(squeeze(np.diff(part, prepend=0).astype(np.uint32)))
        return _rows(shard=out, data=held)

    def cut(left, right):
        kinds = {"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        if not left.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        shard = Shard(left)
        edge = np.zeros(len(shard.text) + 1, np.int32)
        for data in right.column("data").to_pylist():
            starts = np.cumsum(unsqueeze(data, np.uint32)[0], dtype=np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept, removed, spans = [], [], []
        for a, b, data in zip(shard.starts.tolist(), shard.ends.tolist(), shard.texts):
            own = gone[a:b]
            n = int(own.sum())
            removed.append(n)
            spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if n else 0)
            kept.append(shard.text[a:b][~own].tobytes() if n else data)
        values = (shard.ids, (shard.ends - shard.starts).tolist(), removed, spans, kept)
        return pa.table({name: pa.array(v, kind) for (name, kind), v in zip(kinds.items(), values)})

    by_shard = base.groupBy("shard")
    known = by_shard.applyInArrow(anchors, "bucket int, shard int, data binary").groupBy("bucket").applyInArrow(repeated, "bucket int, shard int, data binary")
    windows = by_shard.cogroup(known.groupBy("shard")).applyInArrow(local, "bucket int, shard int, kind int, data binary")
    places = windows.groupBy("bucket").applyInArrow(across, "shard int, data binary")
    found = by_shard.cogroup(places.groupBy("shard")).applyInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    gone = copies.select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit("").cast("binary").alias("kept"))
    return found.unionByName(gone)
