import random

from conftest import rows
from pyspark.sql import functions as F

from varscore.functions.info import gene_symbol, info_text, info_value, parse_info, review_stars, score_text, strip_chr
from varscore.functions.llr import log_softmax, variant_llr
from varscore.functions.sequence import aa_at, aa_index, codon_aa, reverse_complement, translate_cds


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build(F.col("v")).alias("r")).first()["r"]


def test_star_rules(spark):
    cases = {
        "practice_guideline": 4,
        "criteria_provided,_multiple_submitters,_no_conflicts": 4,
        "Reviewed_by_expert_panel": 3,
        "criteria_provided,_conflicting_interpretations": 2,
        "criteria_provided,_conflicting_classifications": 0,
        "criteria_provided,_single_submitter": 2,
        "no_criteria": 1,
        "single_submitter": 1,
        "no_assertion_criteria_provided": 0,
        "": 0,
        None: 0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["s"] for r in df.select("v", review_stars(F.col("v")).alias("s")).collect()}
    assert got == cases


def test_parse_info(spark):
    text = "ID=1;FLAG;CLNSIG=Benign;CLNSIG=Likely_benign;X=a=b;E="
    assert one(spark, text, parse_info) == {"ID": "1", "CLNSIG": "Likely_benign", "X": "a=b", "E": ""}
    assert one(spark, text, lambda c: info_text(parse_info(c))) == "ID=1;CLNSIG=Likely_benign;X=a=b;E="
    assert one(spark, text, lambda c: info_value(c, "CLNSIG")) == "Likely_benign"
    assert one(spark, text, lambda c: info_value(c, "SIG")) is None
    assert one(spark, "FLAG", parse_info) == {}


def test_gene_and_chrom(spark):
    assert one(spark, "BRCA1:672|NBR2:10230", gene_symbol) == "BRCA1"
    assert one(spark, None, gene_symbol) is None
    assert [one(spark, c, strip_chr) for c in ("chr1", "1", "chrchr2", "chX")] == ["1", "1", "chr2", "chX"]


def test_score_text_prints_like_python(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 0.00015, -0.08915, 0.03125, 0.09375, -1e-9, 12.34995, 1e12, -11.6, 1000000000.03125, 1073741824.03125, -8589934592.99998, 2.0**53 + 2, 2.0**60, 0.00005, 99999.99995]
    values += [round(rng.uniform(-20, 20), 5) for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", score_text(F.col("v")).alias("t")).collect():
        assert r["t"] == f"{r['v']:.4f}"


def test_sequences(spark):
    assert one(spark, "AAAGGGa", reverse_complement) == "TCCCTTT"
    assert one(spark, "ATGTGGNNNTAAgctC", translate_cds) == "MWX*A"
    assert one(spark, "AT", translate_cds) == ""
    assert [one(spark, c, codon_aa) for c in ("atg", "TAA", "NNN", "AT")] == ["M", "*", None, None]
    assert [one(spark, c, aa_index) for c in ("A", "Y", "X", "*", "AC", "")] == [0, 19, None, None, None, None]
    assert [one(spark, i, aa_at, "int") for i in (0, 19, 20, -1)] == ["A", "Y", None, None]


def test_ratios(spark):
    import numpy as np

    logits = [float(i % 7) for i in range(20)]
    df = spark.createDataFrame([("ACD", logits)], "seq string, lg array<double>")
    got = df.select(log_softmax(F.col("lg")).alias("r")).first()["r"]
    assert np.allclose(got, np.array(logits) - np.log(np.exp(logits).sum()))

    def ratio(pos, ref, alt):
        c = variant_llr(F.col("seq"), F.lit(pos), F.lit(ref), F.lit(alt), F.col("lg"))
        return df.select(c.alias("r")).first()["r"]

    assert ratio(1, "C", "D") == 1.0
    assert ratio(1, "A", "D") is None and ratio(3, "A", "D") is None and ratio(-1, "A", "D") is None
    assert ratio(1, "C", "B") is None


def test_rows_helper(spark):
    assert rows(spark.range(2)) == [(0,), (1,)]
