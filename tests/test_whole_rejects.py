import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_genome import BINS, REGIONS, chunked, random_genes

import __spark_entry__ as contract
from varscore.functions.sequence import codon_aa
from varscore.operators import genome, proteins
from varscore.plans import scoring
from verification import fixtures
from verification.fixtures import Fixtures

SF = "/root/testdata/sf0.001"
# Transcripts on two contigs and on both strands, overlapping exons, letters that are no bases, and no whole codon.
ODD = [
    ("two", "c0", 1, 10, "+", "0"), ("two", "c1", 3, 13, "+", "0"), ("two", "n", 2, 21, "+", "0"),
    ("turn", "c0", 2, 12, "+", "0"), ("turn", "c0", 20, 33, "-", "0"), ("turn", "c2", 41, 44, "-", "0"),
    ("lap", "c3", 1, 15, "-", "0"), ("lap", "c3", 5, 26, "-", "0"), ("lap", "c3", 7, 8, "-", "0"),
    ("odd", "n", 1, 24, "-", "0"), ("tiny", "c1", 5, 6, "+", "0"),
    ("gone", "nowhere", 1, 9, "+", "0"), ("cut", "c0", 1, 9_999, "+", "0"),
]


def genes(spark, seed):
    contigs, regions = random_genes(seed)
    contigs["n"] = "ACGTNNacgtRACGTACGTACGTAA"
    regions += ODD
    names = [(n,) for n in sorted({r[0] for r in regions} - {"t0+"}) + ["empty"]]
    return spark.createDataFrame(names, "transcript_id string"), spark.createDataFrame(regions, REGIONS), chunked(spark, contigs)


@pytest.mark.parametrize("seed", [6, 7])
def test_whole_sequences_have_the_letters_of_placed_codons(spark, seed):
    transcripts, regions, chunks = genes(spark, seed)
    whole = regions.where("transcript_id NOT IN ('gone', 'cut')")
    placed = genome.placed_codons(genome.fetch_regions(genome.exon_offsets(whole), chunks, BINS))
    wanted = placed.select("transcript_id", F.col("codon_idx").cast("long"), codon_aa(F.col("codon")).alias("aa")).where("aa <> '*'")
    read = proteins.coding_residues(genome.fetch_regions(regions, chunks, BINS))
    found = proteins.residues(read.where("transcript_id NOT IN ('gone', 'cut')"))
    assert rows(found) == rows(wanted) != []
    counted = {r.transcript_id: (r.found, r.coding) for r in read.collect()}
    assert counted["tiny"] == (2, 0) and counted["lap"][0] == 39 and counted["cut"][0] < 9_999 and "gone" not in counted


@pytest.mark.parametrize("seed", [6, 7])
def test_rejects_alone_are_those_of_the_scores(spark, seed):
    transcripts, regions, chunks = genes(spark, seed)
    rejected = (F.col("transcript_id") == "lap") | (F.col("transcript_id").isin("two", "turn", "odd", "t1+") & (F.col("codon_idx") % 3 == 1))
    llr = F.when(~rejected, F.array(*[F.lit(-float(i)) for i in range(20)]))
    wanted = scoring.generate_scores(transcripts, regions, chunks, lambda codons: codons.withColumn("llr", llr), bases=BINS)[1]
    found = scoring.generate_rejects(transcripts, regions, chunks, lambda residues: residues.where(rejected), bases=BINS)
    assert rows(found) == rows(wanted)
    assert {r.reason for r in found.collect()} == {"no_cds", "missing_sequence", "no_matrix", "partial_matrix"}


def test_gaps_are_codons_without_ratios(spark):
    held = Fixtures(spark, SF)
    full = held.logits().withColumn("logits", F.expr("IF(vec_id % 3 = 0, transform(logits, (v, i) -> IF(i % 2 = 0, v, null)), logits)"))
    held.logits = lambda: full.where("vec_id % 5 <> 0")
    given = [(f"tx{i % 7}", i, codon) for i, codon in enumerate(["ATG", "GCC", "TGG", "acg"] * 9)]
    codons = spark.createDataFrame(given, "transcript_id string, codon_idx long, codon string")
    gaps = held.gaps(codons.select("transcript_id", "codon_idx", codon_aa(F.col("codon")).alias("ref_aa")))
    wanted = held.with_known(codons).where("known IS NULL").select("transcript_id", "codon_idx")
    assert rows(gaps.select("transcript_id", "codon_idx")) == rows(wanted) != []


def test_rejects_cut_no_codons(spark):
    plan = contract.queries()["score_rejects"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "Window" not in plan and "codon#" not in plan


def test_bases_byte_by_byte_are_those_of_the_expression(spark):
    signs = "".join(map(chr, [*range(1, 0x2200), 0x2126, 0x1E9E, 0xFB01, 0x1F600]))
    texts = [None, "", signs, "İıKÅſß", "The quick Brown fox; 0-9 jumps_over\r\n\tLAZY (dogs)!", "é", *np.array(list(signs[:600]))]
    frame = spark.createDataFrame([(i, None if t is None else str(t)) for i, t in enumerate(texts)], "i long, text string")
    signs = r"abcdefghijklmnopqrstuvwxyz 0123456789.,;:!?()-_/\n\r\t"
    wanted = frame.selectExpr("i", f"regexp_replace(translate(lower(text), '{signs}', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]+', '') AS seq")
    assert rows(wanted) == sorted(((i, fixtures.bases(None if t is None else str(t))) for i, t in enumerate(texts)), key=repr)
