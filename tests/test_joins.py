import pytest
from conftest import rows
from pyspark.sql import functions as F

from varscore import schemas
from varscore.operators import joins, lookup, mutations


def hot_variants(spark):
    """A third of the rows share one key; some keys have no score."""
    return spark.range(900).selectExpr(
        "'1' AS CHROM",
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS POS",
        "'A' AS REF",
        "'C' AS ALT",
        "id % 5 AS extra",
    )


def scores(spark):
    return spark.range(0, 900, 2).selectExpr("'chr1' AS CHROM", "id AS POS", "'A' AS REF", "'C' AS ALT", "-id / 4 AS score")


@pytest.mark.parametrize("hot_share", [0.1, 0.9])
def test_hot_keys_take_the_same_result(spark, monkeypatch, hot_share):
    monkeypatch.setattr(joins, "HOT_SHARE", hot_share)
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    variants, table = hot_variants(spark), scores(spark)
    plain = variants.join(table.withColumn("CHROM", F.lit("1")), lookup.KEY, "inner")
    left = variants.join(table.withColumn("CHROM", F.lit("1")), lookup.KEY, "left")
    columns = plain.columns
    for limit in (0, 10**8):
        got = lookup.score_variants(variants, table, broadcast_bytes=limit)
        assert rows(got.select(columns)) == rows(plain)
        got = lookup.annotate(variants, table, normalize_chrom=True, broadcast_bytes=limit)
        assert rows(got.select(columns)) == rows(left)


def test_lookup_is_distinct_and_last_wins(spark):
    table = spark.createDataFrame(
        [("chr1", 2, "A", "C", -1.0, 1), ("1", 2, "A", "C", -3.0, 2), ("1", 4, "A", "C", -9.0, 1)],
        "CHROM string, POS long, REF string, ALT string, score double, ord int",
    )
    wanted = spark.createDataFrame(
        [("chr1", 2, "A", "C"), ("1", 2, "A", "C"), ("1", 3, "A", "C")], "CHROM string, POS long, REF string, ALT string"
    )
    for limit in (0, 10**8):
        by_order = lookup.lookup_scores(table, wanted, order_col="ord", broadcast_bytes=limit)
        # each of the caller's own names gets a row
        assert rows(by_order) == [("1", 2, "A", "C", -3.0), ("chr1", 2, "A", "C", -3.0)]
        largest = lookup.lookup_scores(table, wanted, broadcast_bytes=limit)
        assert rows(largest) == [("1", 2, "A", "C", -1.0), ("chr1", 2, "A", "C", -1.0)]
        both = lookup.score_variants(wanted, table, order_col="ord", broadcast_bytes=limit)
        assert sorted((r.CHROM, r.score) for r in both.collect()) == [("1", -3.0), ("chr1", -3.0)]
    raw = lookup.lookup_scores(table, wanted, normalize_chrom=False)
    assert rows(raw) == [("1", 2, "A", "C", -3.0), ("chr1", 2, "A", "C", -1.0)]


def test_multiallelic_rows_are_not_matched_whole(spark):
    wanted = spark.createDataFrame([("1", 2, "A", "C,G")], "CHROM string, POS long, REF string, ALT string")
    assert rows(lookup.score_variants(wanted, scores(spark))) == []
    assert [(r.alt_idx, r.ALT) for r in lookup.split_alts(wanted).collect()] == [(0, "C"), (1, "G")]


def test_mutation_index(spark):
    data = [("T", "P1", 3, "A", "L", -1.0, 1), ("T", "P1", 3, "A", "L", -2.0, 2), ("T", "P1", 4, "A", "L", -5.0, 1)]
    kind = "transcript_id string, protein_id string, protein_pos int, ref_aa string, alt_aa string, score double, ord int"
    base = spark.createDataFrame(data, kind)
    assert [r.score for r in mutations.query_mutation(base, "P1", 3, "L", "ord").collect()] == [-2.0]
    assert mutations.query_mutation(base, "P9", 3, "L", "ord").count() == 0
    new = spark.createDataFrame([("T", "P1", 3, "A", "L", -7.0, 0)], kind)
    assert rows(mutations.upsert_mutations(base, new, "ord")) == [("P1", 3, "L", -7.0), ("P1", 4, "L", -5.0)]
    assert mutations.mutation_table(base).columns == schemas.MUTATIONS.fieldNames()
