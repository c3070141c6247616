"""Exact duplicates by progressive refinement, in DataFrame functions only.

Texts are equal when identical after deleting ASCII white space. Rows are grouped by the length of that form, the rows
whose length is shared by the hash of a prefix, and only the rows that still share both read their full text for a full
hash. Counts are pre-aggregated and joined back, so a group of copies that holds a third of all rows is never gathered.

Nulls count as empty; all texts of white space only are equal. Of equal texts the row with the most code points in the
original text stays, then the smallest id; null ids come last. Rows that repeat id and text count singly in group_size
and share one `kept`; `drop_duplicates` leaves one of them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscore.llm.common import col, fresh, narrow, small_or_shuffled, written

#: Characters of the normalised text that the second refinement hashes.
PREFIX = 64
#: Fixed value: the characters of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null gives the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def text_sha256(text: Column) -> Column:
    return F.sha2(squeezed(text).cast("binary"), 256)


def duplicate_classes(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id, keep_id, group_size, kept, full_hash), one per input row; full_hash is null where nothing is equal.

    Documents whose length or prefix nobody shares are decided without a full hash.
    """
    rows = narrow(docs, id_col, text_col)
    text = squeezed(F.col("text"))
    keys = rows.select("id", F.length(text).alias("len"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("prefix"))
    keys = written(keys, "lengths")
    shared = keys.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len")
    by_length = written(keys.join(written(shared, "shared_lengths"), "len"), "by_length")
    shared = by_length.groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("len", "prefix")
    by_prefix = by_length.join(written(shared, "shared_prefixes"), ["len", "prefix"])
    survivors = written(by_prefix.select("id").distinct(), "survivors")
    near = small_or_shuffled(survivors.select(F.col("id").alias("near_id")))
    full = rows.join(near, F.col("id").eqNullSafe(F.col("near_id")), "left_semi")
    full = written(full.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.sha2(text.cast("binary"), 256).alias("full_hash")), "full")
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("no_id"), "id")).alias("best")
    groups = full.groupBy("full_hash").agg(F.count("*").alias("group_size"), best).where("group_size > 1")
    groups = written(groups.select("full_hash", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.c")).alias("keep_chars")), "groups")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    copies = full.join(groups, "full_hash").select("id", "keep_id", "group_size", kept.alias("kept"), "full_hash")
    single = keys.select("id").join(survivors, keys["id"].eqNullSafe(survivors["id"]), "left_anti")
    single = single.unionByName(full.select("id", "full_hash").join(groups, "full_hash", "left_anti").select("id"))
    alone = single.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("full_hash"))
    return copies.unionByName(alone)


def drop_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """`docs` with one row of each group of equal texts; columns are unchanged.

    Rows that are dropped are matched by id and full hash, so another text under the same id is not affected. Of rows
    that repeat the id and text that stay, one is left.
    """
    found = duplicate_classes(docs, id_col, text_col).where("full_hash is not null")
    found = written(found.groupBy("id", "full_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "decisions")
    sha, key, d_id, d_hash = (fresh(docs, name) for name in ("sha", "key", "d_id", "d_hash"))
    marked = docs.withColumn(sha, text_sha256(col(text_col).cast("string"))).withColumn(key, col(id_col))
    match = F.col(key).eqNullSafe(F.col(d_id)) & (F.col(sha) == F.col(d_hash))
    dropped = found.where("not kept").select(F.col("id").alias(d_id), F.col("full_hash").alias(d_hash))
    left = marked.join(small_or_shuffled(dropped), match, "left_anti")
    repeated = written(found.where("kept and n > 1").select(F.col("id").alias(d_id), F.col("full_hash").alias(d_hash)), "repeated")
    repeated = small_or_shuffled(repeated)
    once = left.join(repeated, match, "left_semi").dropDuplicates([key, sha])
    return left.join(repeated, match, "left_anti").unionByName(once).select(*[col(c) for c in docs.columns])
