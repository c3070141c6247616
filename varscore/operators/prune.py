"""A filter of fixed size for wanted keys, applied before the other side of a join is shuffled."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One row of the filter holds 2^15 bits, so its rows number at most FILTER_BITS / 2^15 and its size 16 MiB.
_ROW_BITS = 1 << 15
FILTER_BITS = 1 << 27


def _slot(on, bits):
    """The bit of a key; columns go by their text, so the sides may differ in integer width."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in on]), F.lit(bits)) + 1


def key_filter(keys: DataFrame, on, bits: int = FILTER_BITS) -> DataFrame:
    """Bitmaps of the hashed keys, partially aggregated before the shuffle."""
    slots = keys.select(_slot(on, bits).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket_")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap_")
    )


def possible_matches(rows: DataFrame, keys: DataFrame, on, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key may be among `keys`: none that matches is lost, a few others pass and are left to the join.

    The filter is broadcast; its size depends on `bits` alone. Null keys match nothing and fall out like the others.
    """
    slot = _slot(on, bits)
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bitmap_", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(byte_, cast(place_ % 8 AS int)) & 1") == 1
    met = rows.withColumn("bucket_", F.bitmap_bucket_number(slot)).join(
        F.broadcast(key_filter(keys, on, bits)), "bucket_"
    )
    return met.withColumns({"byte_": byte, "place_": place}).where(bit).select(*rows.columns)
