import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as contract
from varscore.operators import genome, matrix
from varscore.plans import scoring
from verification.fixtures import Fixtures

SF = "/root/testdata/sf0.001"
CODONS = [("a", 0, "ATG"), ("a", 1, "TAA"), ("b", 0, "ATG"), ("b", 1, "AAA"), ("c", 0, "GCC")]
LLR = [-float(i) for i in range(19)] + [float("nan")]


def from_letter(codons):
    """Ratios that follow from the codon itself; those of `c` and of `b`'s first codon are missing."""
    known = (F.col("transcript_id") == "a") | (F.col("codon") == "AAA")
    return codons.withColumn("llr", F.when(known, F.array(*[F.lit(v) for v in LLR])))


def test_a_function_gives_the_same_as_matrix_rows(spark):
    codons = spark.createDataFrame(CODONS, "transcript_id string, codon_idx int, codon string")
    held = [("a", 0, LLR), ("a", 1, LLR), ("b", 1, LLR)]
    matrix_rows = spark.createDataFrame(held, "transcript_id string, codon_idx int, llr array<double>")
    ours, theirs = (scoring.with_matrix(codons, m).select("transcript_id", "codon_idx", "llr") for m in (from_letter, matrix_rows))
    assert repr(rows(ours)) == repr(rows(theirs))  # NaN among them
    expected = [("b", "partial_matrix"), ("c", "no_matrix")]
    assert rows(scoring.matrix_rejects(codons, from_letter)) == rows(scoring.matrix_rejects(codons, matrix_rows)) == expected
    # One join per codon gives what one join per change gives.
    long = matrix.matrix_long(matrix_rows)
    snvs = matrix.attach_llr(genome.missense_snvs(codons), long)
    placed = matrix.picked_llr(genome.missense_snvs(scoring.with_matrix(codons, from_letter).where("llr IS NOT NULL")))
    columns = ["transcript_id", "codon_idx", "cds_pos", "ref", "alt", "llr"]
    assert rows(placed.select(columns)) == rows(snvs.select(columns)) != []


@pytest.mark.parametrize("name", ["generate_scores", "resume_scores", "vcf_full_info", "records_round_trip", "missense_scores"])
def test_ratios_are_not_shuffled_to_the_codons(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if " Join " in line or line.startswith("Join ")]
    assert joins and not [line for line in joins if re.search(r"\(codon_idx#\d+L? = codon_idx#", line)]


def test_known_codons_are_those_with_ratios(spark):
    fixtures = Fixtures(spark, SF)
    size = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    given = [(f"tx{i % 7}", i, codon) for i, codon in enumerate(["ATG", "TAA", "NNN", "GCC", "TTW", "acg"] * 5)]
    codons = spark.createDataFrame(given, "transcript_id string, codon_idx int, codon string")
    held = fixtures.logits().withColumn("logits", F.expr("IF(vec_id % 3 = 0, transform(logits, (v, i) -> IF(i % 2 = 0, v, null)), logits)"))
    fixtures.logits = lambda: held.where("vec_id % 5 <> 0")  # some vectors are missing, some have holes
    columns = ["transcript_id", "codon_idx", "codon"]
    known = rows(fixtures.with_known(codons).select(*columns, "known"))
    assert known == rows(fixtures.with_llr(codons).select(*columns, F.when(F.col("llr").isNotNull(), 1).alias("known")))
    assert size > 30 and {k for *_, k in known} == {1, None}
    assert rows(scoring.matrix_rejects(codons, fixtures.with_llr, fixtures.with_known)) == rows(scoring.matrix_rejects(codons, fixtures.with_llr)) != []


def test_rejects_do_not_work_out_ratios(spark):
    rejects = contract.queries()["score_rejects"](spark, SF)
    codons = spark.createDataFrame(CODONS, "transcript_id string, codon_idx int, codon string")
    worked_out = scoring.matrix_rejects(codons, Fixtures(spark, SF).with_llr)
    found = [df._jdf.queryExecution().optimizedPlan().toString().count("transform(logits#") for df in (worked_out, rejects)]
    assert found[0] > 0 and found[1] == 0


def test_left_over_letters_are_turned_alone(spark):
    pieces = spark.createDataFrame(
        [("t", "c", "-", 5, 9, 0, 5, 9, "acGTN"), ("t", "c", "-", 1, 4, 5, 1, 4, "TTga"), ("u", "c", "-", 1, 2, 0, 1, 2, "aG"), ("u", "c", "-", 8, 8, 2, 8, 8, "c")],
        "transcript_id string, chrom string, strand string, start_pos long, end_pos long, cds_start long, piece_start long, piece_end long, seq string",
    )
    found = genome.placed_codons(pieces)
    assert rows(found.select("transcript_id", "codon_idx", "codon", "p0", "p1", "p2")) == [
        ("t", 0, "NAC", 9, 8, 7), ("t", 1, "GTT", 6, 5, 4), ("t", 2, "CAA", 3, 2, 1), ("u", 0, "CTG", 2, 1, 8),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1
