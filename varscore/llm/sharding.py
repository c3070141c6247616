"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each partition gives to each shard is drawn exactly as a full random permutation would give it
(multivariate hypergeometric). Every partition permutes its rows and cuts them at these counts, rows are exchanged, and
each shard permutes again. Only the counts of the partitions, a bounded number, pass the driver.

The law is `rows`: shard sizes differ by one row at most. Nulls count as empty texts; rows that repeat are shuffled one
by one; an empty table gives no rows. The same rows, seed and shard count give the same result, in whatever order rows
arrive: partitions are ranges of a hash of id and text.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varscore.llm.common import narrow, ranked, written

#: Rows a logical partition is aimed at, and the largest number of partitions (the matrix has one row for each).
PARTITION_ROWS, MOST_PARTITIONS = 32_768, 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` from `good + bad`, by inversion around the mean; any population size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mean = draws * (good / total)
    spread = 12 * (mean * (bad / total) * max(0.0, (total - draws) / max(1, total - 1))) ** 0.5 + 40
    low, high = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(log_p - log_p.max())
    return low + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, len(p) - 1))


def communication_matrix(counts, shards: int, seed: int) -> np.ndarray:
    """Rows of each partition for each shard: row sums are `counts`, column sums differ by one at most."""
    rng, total = np.random.default_rng(seed), int(sum(counts))
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        rest, n = sum(left), int(n)
        for s in range(shards):
            rest -= left[s]
            out[p, s] = hypergeometric(rng, left[s], rest, n)
            n -= int(out[p, s])
        left = [a - int(b) for a, b in zip(left, out[p])]
    return out


def shards_by_rows(docs: DataFrame, shards=8, seed=20, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): the shard of each row and its place there, 0, 1, ... without gaps."""
    rows = narrow(docs, id_col, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.xxhash64("id", F.coalesce("text", F.lit("")))
    rows = rows.select("id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), hashed.alias("h"))
    rows = written(rows, "rows")
    n = rows.count()
    parts = min(MOST_PARTITIONS, max(1, -(-n // PARTITION_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(parts)).cast("int"))
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    order = sorted(counts)
    cuts = np.cumsum(communication_matrix([counts[p] for p in order], shards, seed), axis=1)
    cuts = rows.sparkSession.createDataFrame([(p, c) for p, c in zip(order, cuts.tolist())], "part int, cuts array<long>")
    local = Window.partitionBy("part").orderBy(F.xxhash64("h", F.lit(seed + 1)), "h", "id", "text_crc32")
    dealt = rows.withColumn("pos", F.row_number().over(local) - 1).join(F.broadcast(cuts), "part")
    dealt = dealt.select("id", "size", "text_crc32", F.size(F.filter("cuts", lambda c: c <= F.col("pos"))).alias("shard"), F.xxhash64("h", F.lit(seed + 2)).alias("again"), "pos", "part")
    bits = max(3, min(20, (n // shards // PARTITION_ROWS).bit_length() + 3))
    return ranked(dealt, "shard", ["again", "part", "pos"], "slot", bits).select("id", "size", "text_crc32", "shard", "slot")
