import json

from conftest import rows
from pyspark.sql import functions as F

from varscore.operators import clinvar, lookup
from varscore.operators.prune import key_filter, possible_matches
from varscore.plans import export, reports
from varscore.sinks.tables import report_json, write_report
from varscore.sources.vcf import vcf_body, vcf_header
from verification.fixtures import Fixtures

SF = "/root/testdata/sf0.001"
ON = ["CHROM", "POS"]


def table(spark, n):
    return spark.range(n).select((F.col("id") % 7).cast("string").alias("CHROM"), F.col("id").alias("POS"), F.rand(1).alias("score"))


def test_filter_loses_no_match_and_few_others_pass(spark):
    scores = table(spark, 20_000)
    keys = scores.where("POS % 40 = 3").select("CHROM", F.col("POS").cast("int").alias("POS"))
    for bits in (1 << 15, 1 << 17, 1 << 27):
        met = possible_matches(scores, keys, ON, bits)
        assert met.columns == scores.columns
        assert met.join(keys, ON, "left_semi").count() == 500
        others = met.count() - 500
        assert others <= 19_500 * (1 - (1 - 1 / bits) ** 500) * 1.5 + 10
        assert key_filter(keys, ON, bits).count() <= bits >> 15


def test_filter_of_no_keys_and_null_keys(spark):
    scores = table(spark, 10).unionAll(spark.createDataFrame([(None, None, 1.0)], "CHROM string, POS long, score double"))
    assert possible_matches(scores, scores.limit(0), ON).count() == 0
    assert possible_matches(scores, scores, ON).where("POS IS NOT NULL").count() == 10


def test_lookup_is_the_same_beyond_the_broadcast_limit(spark):
    schema = "CHROM string, POS long, REF string, ALT string"
    wanted = spark.createDataFrame([("chr1", 5, "A", "T"), ("1", 5, "A", "T"), ("2", 6, "A", "T"), ("2", 6, "A", "T"), (None, 7, "A", "T")], schema)
    scores = spark.createDataFrame(
        [("1", 5, "A", "T", -1.0, 1), ("chr1", 5, "A", "T", -2.0, 2), ("2", 6, "A", "C", 0.0, 3), ("2", 6, "A", "T", -4.0, 4)],
        schema + ", score double, ord long",
    )
    expected = [("1", 5, "A", "T", -2.0), ("2", 6, "A", "T", -4.0), ("chr1", 5, "A", "T", -2.0)]
    for limit in (0, 1 << 26):
        assert rows(lookup.lookup_scores(scores, wanted, order_col="ord", broadcast_bytes=limit)) == expected
        plain = lookup.lookup_scores(scores, wanted, normalize_chrom=False, order_col="ord", broadcast_bytes=limit)
        assert rows(plain) == [("1", 5, "A", "T", -1.0), ("2", 6, "A", "T", -4.0), ("chr1", 5, "A", "T", -2.0)]


def test_reports_as_files(spark, tmp_path):
    data = [(x / 10, int(x > 20 or x % 7 == 0), -x / 10) for x in range(40)]
    df = spark.createDataFrame(data, "x double, y int, score double")

    def text(report, **options):
        return json.loads(report_json(report, **options).first()[0])

    found = text(reports.specificity_report(df, 0.65))
    assert found["threshold"] == -found["threshold_negated"] and found["specificity"] == 0.65
    assert set(found["metrics"]) == {"target_specificity", "actual_specificity", "sensitivity_at_threshold"}
    found = text(reports.precision_report(df, 0.8, 0.85), decimals=6)
    assert (found["ppv_target"], found["npv_target"], found["metrics"]["method"]) == (0.8, 0.85, "precision_sliding")
    found = text(reports.three_class_report(df), decimals=6)
    assert {"p_threshold", "b_threshold", "specificity", "specificity_b", "metrics"} == set(found)
    found = text(reports.binary_evaluation_report(df, -2.0))
    assert found["threshold"] == -2.0 and sum(found["metrics"][c] for c in ("tp", "tn", "fp", "fn")) == 40
    write_report(reports.three_class_evaluation_report(df, -3.0, -1.0), str(tmp_path / "r"))
    found = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert list(found)[:2] == ["p_threshold", "b_threshold"] and len(found) == 7 and found["predictions"]["predicted_P"] == 9


def test_fixed_decimals_of_special_values(spark):
    report = spark.createDataFrame([(float("inf"), 0.0, None, 1)], "a double, b double, c double, n long")
    assert report_json(report, decimals=6).first()[0] == '{"a":null,"b":0.000000,"c":null,"n":1}'
    assert json.loads(report_json(report).first()[0])["a"] == "Infinity"


def test_filter_file_reports_its_counts(spark, tmp_path):
    fx = Fixtures(spark, SF)
    lines = fx.vcf_lines()
    counts = export.filter_file(vcf_header(lines), vcf_body(lines), str(tmp_path / "f"))
    summary = clinvar.filter_summary(fx.clinvar()).first()
    labels = {r.CLNSIG: r.n for r in clinvar.count_clinsig(clinvar.with_annotations(fx.clinvar())).collect()}
    assert counts == {"total": summary.total, **labels, "kept": summary.kept}
    assert spark.read.text(str(tmp_path / "f")).where("value NOT LIKE '#%'").count() == counts["kept"]


def test_every_base_lies_in_one_exon(spark):
    fx = Fixtures(spark, SF)
    bases = fx.contig().agg(F.sum(F.length("seq"))).first()[0]
    spans = fx.regions().select("chrom", "start_pos", F.explode(F.sequence("start_pos", "end_pos")).alias("pos"))
    counted = spans.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chrom", "pos").alias("d")).first()
    assert counted.n == counted.d == bases
