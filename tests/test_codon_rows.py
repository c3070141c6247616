"""What is worked out for each codon or for the table of changes is not worked out again for every change."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from varscore.functions.once import computed_once
from varscore.operators import genome, matrix
from varscore.plans.scoring import generate_scores

SF = "/root/testdata/sf0.001"
PLACED = "transcript_id string, chrom string, strand string, codon_idx long, codon string, p0 long, p1 long, p2 long"
REGIONS = "transcript_id string, chrom string, start_pos long, end_pos long, strand string, phase string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bases_of_changes_are_not_turned_one_by_one(spark):
    given = [("a", "c", "-", 0, "ATG", 9, 8, 7), ("b", "c", "+", 0, "ATG", 1, 2, 3), ("n", "c", None, 0, "ATG", 1, 2, 3)]
    snvs = genome.missense_snvs(spark.createDataFrame(given, PLACED))
    assert "translate(" not in plan(snvs) and "LogicalRDD" in plan(snvs)
    found = {(r.transcript_id, r.POS, r.REF, r.ALT, r.alt_aa) for r in snvs.collect()}
    for name, turn, places in (("a", str.maketrans("ACGT", "TGCA"), (9, 8, 7)), ("b", {}, (1, 2, 3)), ("n", {}, (1, 2, 3))):
        own = {x[1:] for x in found if x[0] == name}
        assert own == {
            (places[r.place], r.ref.translate(turn), r.alt.translate(turn), r.alt_aa)
            for r in genome.codon_snvs(spark).where(genome.is_missense() & (F.col("codon") == "ATG")).collect()
        }


def test_scores_of_changes_by_hand(spark):
    """A transcript of two codons on either strand; the second codon has no ratios, one ratio of the first is no number."""
    llr = [-float(i) for i in range(20)]
    llr[18] = float("nan")

    def ratios(codons):
        return codons.withColumn("llr", F.when(F.col("codon_idx") == 0, F.array(*[F.lit(v) for v in llr])))

    chunks = spark.createDataFrame([("c", 0, "ATGAAACCCTTTCAT")], "contig string, bin long, chunk string")
    regions = spark.createDataFrame([("p", "c", 1, 6, "+", "0"), ("m", "c", 10, 15, "-", "0")], REGIONS)
    transcripts = spark.createDataFrame([("p",), ("m",)], "transcript_id string")
    scores, rejects = generate_scores(transcripts, regions, chunks, ratios, bases=100)
    assert sorted(map(tuple, rejects.collect())) == [("m", "partial_matrix"), ("p", "partial_matrix")]
    # ATG: L, V (GTG), T, K, R, I three times; those letters have the places 9, 17, 16, 8, 14 and 7.
    want = [(1, "A", "C", "L"), (1, "A", "G", "V"), (1, "A", "T", "L"), (2, "T", "A", "K"), (2, "T", "C", "T"), (2, "T", "G", "R"), (3, "G", "A", "I"), (3, "G", "C", "I"), (3, "G", "T", "I")]
    turn = dict(zip("ACGT", "TGCA"))
    rows = [("c", pos, ref, alt, llr["ACDEFGHIKLMNPQRSTVWY".index(aa)], "p", "p", "1", "M", aa) for pos, ref, alt, aa in want]
    rows += [("c", 16 - pos, turn[ref], turn[alt], llr["ACDEFGHIKLMNPQRSTVWY".index(aa)], "m", "m", "1", "M", aa) for pos, ref, alt, aa in want]
    assert sorted(map(tuple, scores.collect())) == sorted(rows)


def test_ratios_and_places_are_worked_out_once(spark):
    text = plan(contract.queries()["generate_scores"](spark, SF))
    assert text.count("transform(logits#") == 1
    assert "instr(ACDEFGHIKLMNPQRSTVWY, alt_aa#" not in text
    assert "instr(ACDEFGHIKLMNPQRSTVWY, alt_aa#" not in plan(contract.queries()["missense_scores"](spark, SF))


def test_null_and_missing_ratios_are_left_out(spark):
    llr = [None if i % 2 else float(i) for i in range(20)]
    codons = spark.createDataFrame([("t", 0, "ATG", llr), ("t", 1, "ATG", None)], "transcript_id string, codon_idx int, codon string, llr array<double>")
    picked = matrix.picked_llr(genome.missense_snvs(codons))
    assert picked.columns[-1] == "llr" and "aa_idx" not in picked.columns
    assert sorted((r.codon_idx, r.alt_aa, r.llr) for r in picked.collect()) == [(0, "K", 8.0), (0, "R", 14.0), (0, "T", 16.0)]


def test_a_column_computed_once_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b")], "n int, t string")
    found = computed_once(rows, "n", F.col("n") + 1)
    assert found.columns == ["t", "n"] and sorted(map(tuple, found.collect()), key=repr) == [("a", 2), ("b", None), ("b", None)]
