"""Steps that decide how the queries grow: what is computed once, and what has no per-row detour."""

import math
import random

import duckdb
import pandas as pd
import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from varscore.constants import codon_table, codon_text
from varscore.functions.info import parse_info
from varscore.functions.llr import residue_matches
from varscore.functions.numbers import rounded
from varscore.functions.sequence import codon_aa
from varscore.operators import clinvar, evaluate, genome, lookup, matrix, model
from varscore.sources import gff
from verification.fixtures import Fixtures
from verification.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rounded_is_the_rounding_of_the_sql(spark):
    draw = random.Random(3)
    values = [0.0, 1e-9, -1e-9, 0.5e-6, -0.5e-6, 2.5e-6, 0.49999999999999994e-6, 1e300, math.inf, -math.inf, None, 9e9]
    values += [draw.uniform(-20, 20) for _ in range(5_000)] + [draw.randint(-(10**8), 10**8) / 2e7 for _ in range(5_000)]
    frame = pd.DataFrame({"i": range(len(values)), "v": values})
    ours = spark.createDataFrame(list(enumerate(values)), "i long, v double").select("i", rounded(F.col("v"), 6).alias("r"))
    theirs = dict(duckdb.sql("SELECT i, round(v, 6) FROM frame").fetchall())
    for i, r in ours.collect():
        assert (r is None and values[i] is None) or r == theirs[i]


def test_amino_acids_are_found_by_one_search(spark):
    text, letters = codon_text()
    assert len(text) == 66 and {text[i : i + 3]: letters[i] for i in range(64)} == codon_table()
    odd = ["", "A", "AC", "NNN", "ACGT", "A G", None]
    given = spark.createDataFrame([(c,) for c in [*codon_table(), "atg", *odd]], "codon string")
    found = dict(given.select("codon", codon_aa(F.col("codon"))).collect())
    assert found == {**codon_table(), "atg": "M", **dict.fromkeys(odd)}


def test_texts_are_translated_once_for_regions_and_chunks(spark):
    fixtures = Fixtures(spark, SF)
    for df in (fixtures.regions(), fixtures.chunks(), fixtures.contig()):
        assert "lower(" not in plan(df)


def test_left_over_bases_are_not_sorted(spark):
    pieces = spark.createDataFrame(
        [("t", "c", "+", 1, 4, 0, 1, 4, "ATGG"), ("t", "c", "+", 7, 8, 4, 7, 8, "CC")],
        "transcript_id string, chrom string, strand string, start_pos long, end_pos long, cds_start long, piece_start long, piece_end long, seq string",
    )
    codons = genome.placed_codons(pieces)
    assert rows(codons.select("codon_idx", "codon", "p0", "p1", "p2")) == [(0, "ATG", 1, 2, 3), (1, "GCC", 4, 7, 8)]
    assert "SortAggregate" not in codons._jdf.queryExecution().executedPlan().toString()


def test_conservation_of_rows_with_and_without_numbers(spark):
    row = [0.0, -1.0, None, 3.0] + [None] * 16
    given = spark.createDataFrame([(1, row), (2, None), (3, [0.0] + [None] * 19)], "k int, llr array<double>")
    found = matrix.conservation(given, ["k"])
    assert rows(found) == [(1, 2.0), (2, None), (3, None)]
    assert "lambda" not in plan(found)


def test_scored_columns(spark):
    columns = model._columns(["p", "q", "r"], ["AC", "", "Dé"], [[[1.0] * 20, [2.0] * 20], [[]][:0] or pd.DataFrame(index=[], columns=range(20)).to_numpy(), [[3.0] * 20] * 2])
    assert pa.table(columns[:3], names=["a", "b", "c"]).to_pylist() == [
        {"a": "p", "b": 0, "c": "A"}, {"a": "p", "b": 1, "c": "C"}, {"a": "r", "b": 0, "c": "D"}, {"a": "r", "b": 1, "c": "é"},
    ]
    assert [x[0] for x in columns[3].to_pylist()] == [1.0, 2.0, 3.0, 3.0]


def test_sequences_are_scored_without_frames(spark):
    def scorer():
        return lambda sequences: [[[float(i)] * 20 for i in range(len(s))] for s in sequences]

    proteins = spark.createDataFrame([(f"p{n}", "ACDEFW"[: n % 7]) for n in range(20)], "protein_id string, sequence string")
    scored = model.score_sequences(proteins, scorer)
    assert "MapInPandas" not in plan(scored)
    wanted = sorted((f"p{n}", i, aa, float(i)) for n in range(20) for i, aa in enumerate("ACDEFW"[: n % 7]))
    assert rows(scored.select("protein_id", "pos", "ref_aa", F.get("logits", F.lit(19)))) == wanted


def test_scores_of_the_tolerant_scorer_are_kept_as_columns(spark):
    def scorer():
        return lambda sequences: [[[0.0] * 20] * len(s) for s in sequences]

    proteins = spark.createDataFrame([("p", "AC")], "protein_id string, sequence string")
    scores, rejects = model.score_tolerant(proteins, scorer)
    assert "parquet" in plan(scores) and scores.count() == 2 and rejects.count() == 0


def test_info_is_split_once(spark):
    given = spark.createDataFrame([("A=1;B=2;A=3;FLAG;C=x=y;B=",), ("",), (None,)], "INFO string")
    parsed = given.select(parse_info(F.col("INFO")).alias("m"))
    assert [r["m"] for r in parsed.collect()] == [{"A": "3", "C": "x=y", "B": ""}, {}, None]
    assert plan(parsed).count("split(") == 1
    assert plan(QUERIES["parse_info"](spark, SF)).count("split(") == 1


def test_features_are_read_once_for_hierarchies(spark):
    lines = [("c\ts\tgene\t1\t9\t.\t+\t.\tID=g",), ("c\ts\tmRNA\t1\t9\t.\t+\t.\tID=t;Parent=g",), ("c\ts\tCDS\t1\t9\t.\t+\t0\tID=x;Parent=t",)]
    cds = gff.descendant_cds(gff.gff_features(spark.createDataFrame(lines, "value string")), "gene")
    assert rows(cds.select("transcript_id", "start_pos", "end_pos")) == [("g", 1, 9)]
    assert "split(value" not in plan(cds)


def test_residues_are_compared_before_logits_are_met(spark):
    given = spark.createDataFrame([("ACD", 1, "C"), ("ACD", 1, "A"), ("ACD", 3, "A"), ("ACD", -1, "A")], "s string, p int, r string")
    found = given.select(residue_matches(F.col("s"), F.col("p"), F.col("r")).alias("m"))
    assert [r["m"] for r in found.collect()] == [True, False, False, False]


def test_evaluations_go_through_the_rows_once(spark):
    rows_seen = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows_seen.add(batch.num_rows)
            yield batch

    given = [(-12.0, 1), (-12.0, 0), (-9.0, 0), (-3.0, 0), (None, 1), (-13.0, 1), (-12.0, 1), (-1.0, None)]
    df = spark.createDataFrame(given, "score double, y int").mapInArrow(seen, "score double, y int")
    found = evaluate.evaluate_binary(df, -10.0).first()
    assert (found["tp"], found["tn"], found["fp"], found["fn"]) == (3, 2, 1, 0) and abs(found["auc"] - 8 / 9) < 1e-12
    assert rows_seen.value == len(given)
    found = evaluate.evaluate_three_class(df, -11.6, -8.5).first()
    assert (found["predicted_P"], found["predicted_B"], found["VUS"], found["total_P"], found["total_B"]) == (4, 2, 2, 4, 3)
    assert rows_seen.value == 2 * len(given)
    empty = evaluate.evaluate_binary(df.where("y = 7"), -10.0).first()
    assert (empty["tp"], empty["tn"], empty["fp"], empty["fn"], empty["auc"]) == (0, 0, 0, 0, None)


def test_shuffled_lookups_join_the_scores_once(spark):
    scores = spark.createDataFrame([("chr1", 1, "A", "C", -1.0), ("chr1", 1, "A", "C", -0.5), ("chr2", 5, "G", "T", -2.0)], "CHROM string, POS long, REF string, ALT string, score double")
    variants = spark.createDataFrame([("1", 1, "A", "C"), ("1", 1, "A", "C"), ("3", 1, "A", "C")], "CHROM string, POS long, REF string, ALT string")
    found = lookup.score_variants(variants, scores, broadcast_bytes=0)
    assert rows(found) == [("1", 1, "A", "C", -0.5)] * 2
    joins = [line for line in plan(found).splitlines() if "Join Inner" in line and "bucket_" not in line]
    assert len(joins) == 1


def test_variant_text_is_derived_once(spark):
    lines = Fixtures(spark, SF).vcf_lines()
    assert "Join" not in plan(lines) and lines.where("value LIKE '#%'").count() == 2


def test_significance_alone(spark):
    body = spark.createDataFrame([("CLNSIG=Benign;X=1",), ("X=1",), (None,)], "INFO string")
    assert [r["CLNSIG"] for r in clinvar.with_significance(body).collect()] == ["Benign", "", ""]
