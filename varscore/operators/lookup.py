"""Score lookup, attachment and annotation by variant key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.constants import KEY_COLUMNS, SCORE_INFO_ID
from varscore.functions.info import score_info, strip_chr
from varscore.operators.joins import key_counts, join_unique
from varscore.operators.prune import possible_matches
from varscore.runtime import BROADCAST_BYTES, measured_bytes, stored

KEY = list(KEY_COLUMNS)


def query_variant(scores: DataFrame, chrom: str, pos: int, ref: str, alt: str) -> DataFrame:
    """Exact point lookup; all four comparisons reach the Parquet reader."""
    match = (F.col("CHROM") == chrom) & (F.col("POS") == pos) & (F.col("REF") == ref) & (F.col("ALT") == alt)
    return scores.where(match)


def last_score(order_col=None):
    """The score that wins among rows of one key: the last by `order_col`, or the largest without one."""
    if order_col is None:
        return F.max("score").alias("score")
    return F.max_by("score", F.struct(F.col(order_col), F.col("score"))).alias("score")


def dedupe_scores(scores: DataFrame, order_col=None) -> DataFrame:
    """One score per variant key, partially aggregated before the shuffle."""
    return scores.groupBy(*KEY).agg(last_score(order_col))


def distinct_keys(variants: DataFrame) -> DataFrame:
    return variants.select(*KEY).distinct()


_OWN_CHROM = "__own_chrom"


def _keyed(df: DataFrame, normalize_chrom: bool) -> DataFrame:
    """The rows with CHROM as it is matched, and the caller's own name beside it."""
    return _normalised(df.withColumn(_OWN_CHROM, F.col("CHROM")), normalize_chrom)


def _restored(df: DataFrame, columns) -> DataFrame:
    """The caller's own CHROM again, in the given order of columns."""
    return df.withColumn("CHROM", F.col(_OWN_CHROM)).select(*columns)


def _normalised(df: DataFrame, normalize_chrom: bool) -> DataFrame:
    return df.withColumn("CHROM", strip_chr(F.col("CHROM"))) if normalize_chrom else df


def _candidates(scores, keys, order_col, small):
    """The score rows to match against keys, and the column that still orders rows of one key.

    Small key tables filter the score rows as they are. Otherwise both sides are shuffled by key: a filter of the
    keys, of fixed size, takes out most score rows that no key wants, and reducing the rest in the same shuffle costs
    nothing and collapses copies of a key before it.
    """
    table = scores.select(*KEY, "score", *([order_col] if order_col else []))
    if not small:
        return dedupe_scores(possible_matches(table, keys, KEY), order_col), None
    return table, order_col


def _matched(scores, keys, order_col, small):
    """Scores of the wanted keys, one row per key. Beyond the broadcast limit the few that no key wants stay: the join with
    the rows drops them, and a join with the keys before it would shuffle and sort the keys for nothing."""
    table, order_col = _candidates(scores, keys, order_col, small)
    if not small:
        return table
    return table.join(F.broadcast(keys.select(*KEY)), KEY, "inner").groupBy(*KEY).agg(last_score(order_col))


def lookup_scores(
    scores: DataFrame,
    variants: DataFrame,
    normalize_chrom: bool = True,
    order_col=None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Scores of the given variants: `(CHROM, POS, REF, ALT, score)`, each key once, under the caller's CHROM."""
    own = stored(_keyed(variants.select(*KEY), normalize_chrom).distinct(), "keys")
    small = measured_bytes(own) <= broadcast_bytes
    table, order_col = _candidates(_normalised(scores, normalize_chrom), own, order_col, small)
    hits = table.join(F.broadcast(own) if small else own, KEY)
    if small:  # otherwise the scores have been reduced, and a key has one row for each name of its CHROM
        hits = hits.groupBy(*KEY, _OWN_CHROM).agg(last_score(order_col))
    return _restored(hits, [*KEY, "score"])


def score_variants(
    variants: DataFrame,
    scores: DataFrame,
    how: str = "inner",
    normalize_chrom: bool = True,
    order_col=None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Attach scores to every variant row; duplicate rows on the left are all kept."""
    rows = _keyed(variants, normalize_chrom)
    keys = stored(key_counts(rows.select(*KEY), KEY), "keys")
    small = measured_bytes(keys) <= broadcast_bytes
    matched = _matched(_normalised(scores, normalize_chrom), keys, order_col, small)
    # At most one matched row per key, so a key table that was small enough stays small enough.
    return _restored(join_unique(rows, matched, KEY, keys, how, small), [*variants.columns, "score"])


def split_alts(variants: DataFrame) -> DataFrame:
    """One row per alternative allele, with its place in ALT."""
    columns = [c for c in variants.columns if c != "ALT"]
    return variants.select(*columns, F.posexplode(F.split("ALT", ",")).alias("alt_idx", "ALT"))


def annotate(
    variants: DataFrame,
    scores: DataFrame,
    normalize_chrom: bool = False,
    order_col=None,
    broadcast_bytes: int = BROADCAST_BYTES,
    place_col=None,
) -> DataFrame:
    """Left-join scores onto variant rows. The last alternative allele that has a score decides.

    With `place_col`, a column of places in the input's order, the result has that order at any size: a broadcast join
    keeps it, and after a shuffled one rows are dealt by ranges of places and sorted within them.

    The score depends on the key text alone, so distinct keys are resolved first and then joined back to all
    rows: no row numbers are needed, and copies of a row never meet in one group.
    """
    rows = _keyed(variants, normalize_chrom)
    keys = stored(key_counts(rows.select(*KEY), KEY), "keys")
    small = measured_bytes(keys) <= broadcast_bytes
    alleles = keys.select(
        "CHROM", "POS", "REF", F.col("ALT").alias("alts"), F.posexplode(F.split("ALT", ",")).alias("i", "ALT")
    )
    table, order_col = _candidates(_normalised(scores, normalize_chrom), alleles, order_col, small)
    hits = table.join(F.broadcast(alleles) if small else alleles, KEY, "inner")
    rank = F.struct("i", *([order_col] if order_col else []), "score")
    best = (
        hits.groupBy("CHROM", "POS", "REF", "alts")
        .agg(F.max_by("score", rank).alias("score"))
        .withColumnRenamed("alts", "ALT")
    )
    found = _restored(join_unique(rows, best, KEY, keys, "left", small), [*variants.columns, "score"])
    if place_col is None or small:
        return found
    # The range exchange samples its input, so the joined rows are kept.
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(found, "annotated").repartitionByRange(partitions, place_col).sortWithinPartitions(place_col)


def annotated_info(info_id: str = SCORE_INFO_ID):
    """INFO with the score appended; rows without a score keep their INFO."""
    item = score_info(F.col("score"), info_id)
    bare = F.col("INFO").isNull() | F.col("INFO").isin(".", "")
    appended = F.when(bare, item).otherwise(F.concat("INFO", F.lit(";"), item))
    return F.when(F.col("score").isNull(), F.col("INFO")).otherwise(appended)


def filter_by_score(df: DataFrame, min_score=None, max_score=None) -> DataFrame:
    """Inclusive range filter; both ends optional. An empty input keeps its typed schema."""
    if min_score is not None:
        df = df.where(F.col("score") >= min_score)
    if max_score is not None:
        df = df.where(F.col("score") <= max_score)
    return df
