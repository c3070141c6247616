"""Mixing sources to target weights by Pfair scheduling.

Weights are the exact ratios of the targets, rational numbers that are never rounded. The blocks of a source with weight w
have release times floor(i / w) and deadlines ceil((i + 1) / w); in every slot the released block with the earliest
deadline runs. As the weights sum to 1, each block meets its deadline, and at any slot a source is less than one block from
its target. Only blocks that exist are scheduled. Sources that run out leave their slots empty: the others go on at their
own ratios. Blocks of weight zero, or whose deadline is beyond LATEST, have no window (null) and stand behind the rest, by
descending weight. No row is dropped or repeated.

Earliest deadline first goes from slot to slot, so one task takes the blocks (not the rows), sorted by release; it holds
those that wait, one of each source at most.

Rows of a source are put in a hash order before they are cut into blocks, source by source without gathering one. A null
source is a source of its own; rows that repeat are placed one by one; null and empty texts are rows like any other; an
empty table gives no rows. The sources stay in Spark tables, whatever their number.
"""

import heapq
from decimal import Decimal
from fractions import Fraction
from numbers import Rational

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.llm.common import col, fresh, ranked, small_or_shuffled, written

#: Rows of a block, the last deadline, and the blocks of an Arrow batch.
BLOCK_ROWS, LATEST, BATCH = 64, 1 << 62, 8192

_PLAN = "p_source string, p_block long, p_weight double, p_release long, p_deadline long"
_ARROW = [("p_source", pa.string()), ("p_block", pa.int64()), ("p_weight", pa.float64()), ("p_release", pa.int64()), ("p_deadline", pa.int64())]


def exact(weight) -> Fraction:
    """A target weight as a rational number, without rounding."""
    found = Fraction(weight if isinstance(weight, (Rational, Decimal)) else float(weight))
    if found < 0:
        raise ValueError(f"negative weight {weight}")
    return found


def earliest_deadline(blocks):
    """(slot, block) of blocks (deadline, ..., release) that come by ascending release; those without one come last."""
    ready, slot = [], 0
    for block in blocks:
        release = block[-1]
        while ready and (release is None or slot < release):
            yield slot, heapq.heappop(ready)
            slot += 1
        if release is None:
            yield slot, block
            slot += 1
        else:
            slot = max(slot, release)
            heapq.heappush(ready, block)
    while ready:
        yield slot, heapq.heappop(ready)
        slot += 1


def window(share: Fraction, i: int) -> tuple:
    """Release and deadline of block i; none for a share of zero, or beyond LATEST."""
    deadline = -(-(i + 1) * share.denominator // share.numerator) if share else LATEST + 1
    return (i * share.denominator // share.numerator, deadline) if deadline <= LATEST else (None, None)


def tempered(counts: dict, power=0.5) -> dict:
    """Target weights in proportion to a power of the counts: below 1, small sources gain."""
    return {s: float(n) ** power for s, n in counts.items()}


def planned(counts: DataFrame, weights=None, block_rows=BLOCK_ROWS, power=0.5) -> DataFrame:
    """Rows (p_source, p_block, p_weight, p_release, p_deadline, p_slot) of every block of the sources (source, n)."""
    given = {s: exact(w) for s, w in (weights or {}).items()}

    def targets(batches):
        for batch in batches:
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield s, n, given[s] if s in given else exact(tempered({s: n}, power)[s])

    def summed(batches):
        part = sum((w for _, _, w in targets(batches)), Fraction(0))
        yield pa.RecordBatch.from_pydict({"top": [hex(part.numerator)], "bottom": [hex(part.denominator)]})

    parts = counts.mapInArrow(summed, "top string, bottom string").collect()  # one row per partition
    total = sum((Fraction(int(r["top"], 16), int(r["bottom"], 16)) for r in parts), Fraction(0))

    def batched(rows, schema):
        held = []
        for row in rows:
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), schema)], names=[n for n, _ in schema])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), schema)], names=[n for n, _ in schema])

    def cut(batches):
        shares = ((s, n, w / total if total else w) for s, n, w in targets(batches))
        return batched(((s, i, float(x), *window(x, i)) for s, n, x in shares for i in range(-(-n // block_rows))), _ARROW)

    def dealt(batches):
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        placed = earliest_deadline((d, s is not None, s or "", i, w, r) for s, i, w, r, d in rows)
        return batched(((s if known else None, i, w, r, d, slot) for slot, (d, known, s, i, w, r) in placed), [*_ARROW, ("p_slot", pa.int64())])

    order = [F.col("p_release").asc_nulls_last(), F.col("p_weight").desc(), "p_source", "p_block"]
    blocks = counts.mapInArrow(cut, _PLAN).repartition(1).sortWithinPartitions(*order)
    return written(blocks.mapInArrow(dealt, _PLAN + ", p_slot long"), "blocks")


def placed(docs: DataFrame, weights=None, source_col="source", id_col="doc_id", seed=7, block_rows=BLOCK_ROWS, power=0.5):
    """`docs` with its place: columns `row`, `block`, `weight`, `release`, `deadline`, `slot` (renamed where they clash),
    their names, and the table of all blocks. `weights` maps sources to target weights; sources that it lacks, or all
    without it, are tempered. The column `weight` is the float next to the exact weight.
    """
    names = {n: fresh(docs, n) for n in ("row", "block", "weight", "release", "deadline", "slot")}
    group, key, order = fresh(docs, "group"), fresh(docs, "key"), fresh(docs, "order")
    rows = docs.withColumn(group, col(source_col).cast("string"))
    counts = written(rows.groupBy(F.col(group).alias("source")).agg(F.count("*").alias("n")), "sources")
    plan = planned(counts, weights, block_rows, power)
    rows = rows.withColumn(key, F.xxhash64(F.lit(seed), col(id_col))).withColumn(order, col(id_col))
    rows = ranked(rows, group, [key, order], names["row"])
    rows = rows.withColumn(names["block"], F.floor(F.col(names["row"]) / block_rows))
    source, block = fresh(rows, "p_source"), fresh(rows, "p_block")
    given = ("weight", "release", "deadline", "slot")
    near = small_or_shuffled(plan).select(F.col("p_source").alias(source), F.col("p_block").alias(block), *[F.col(f"p_{n}").alias(names[n]) for n in given])
    rows = rows.join(near, F.col(group).eqNullSafe(F.col(source)) & (F.col(names["block"]) == F.col(block)))
    return rows.drop(group, key, order, source, block), names, plan


def mix(docs: DataFrame, partitions: int, with_place=False, **options) -> DataFrame:
    """`docs` in mixed order: partition after partition, and within each, rows stand in the order of their slots.

    A table that is written and read again has no order; `with_place` adds two last columns that give it, `slot` and `row`,
    whose names are lengthened where `docs` has them.
    """
    rows, names, _ = placed(docs, **options)
    by = [names["slot"], names["row"]]
    return rows.repartitionByRange(partitions, *by).sortWithinPartitions(*by).select(*[col(c) for c in docs.columns], *by * with_place)
