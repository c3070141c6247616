import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varscore import schemas
from varscore.operators import clinvar, lookup
from varscore.plans import export
from varscore.sinks import tables, vcf as out
from varscore.sources import scores as src, vcf as vcf_in
from varscore.streaming.export import export_new_scores

HEADER = ["##fileformat=VCFv4.2", "##source=x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
BODY = [
    "1\t100\t.\tA\tT\t.\t.\tALLELEID=1;DBFLAG;CLNREVSTAT=reviewed_by_expert_panel;CLNSIG=Pathogenic;CLNVC=single_nucleotide_variant;GENEINFO=BRCA1:672|NBR2:10230",
    "1\t100\t.\tA\tG\t.\t.\tCLNREVSTAT=criteria_provided,_single_submitter;CLNSIG=Benign;CLNVC=single_nucleotide_variant",
    "X\t7\t.\tC\tT,G\t.\t.\tCLNREVSTAT=no_assertion_criteria_provided;CLNSIG=Pathogenic/Likely_pathogenic;CLNVC=Deletion",
    "2\t5\t.\tG\tA\t.\t.\tCLNSIG=Benign;CLNSIG=Likely_benign;X=a=b",
    "3\t9\trs1\tG\t.\t.\tPASS\t.\tGT\t0/1",
]
SCORES = [("chr1", 100, "A", "T", -12.5), ("chr1", 100, "A", "G", -3.25), ("chrX", 7, "C", "T", -9.0)]
from varscore.sources import scores as scores_in


@pytest.fixture
def vcf_path(tmp_path):
    path = tmp_path / "in.vcf.gz"
    # Two gzip members, as block compression writes them.
    path.write_bytes(
        gzip.compress(("\n".join(HEADER) + "\n").encode()) + gzip.compress(("\n".join(BODY) + "\n").encode())
    )
    return str(path)


def scores_df(spark):
    return spark.createDataFrame(SCORES, schemas.SCORES)


def test_read_and_filter(spark, vcf_path):
    header, body = vcf_in.read_vcf(spark, vcf_path)
    assert sorted(r.value for r in header.collect()) == sorted(HEADER)
    assert body.count() == 5
    records = {(r.CHROM, r.ALT): r for r in clinvar.clinvar_records(body).collect()}
    assert records[("1", "T")].stars == 3 and records[("1", "T")].GENE == "BRCA1"
    assert records[("1", "G")].GENE is None and records[("2", "A")].CLNSIG == "Likely_benign"
    kept = clinvar.filter_clinvar(body)
    assert sorted(r.value for r in kept.select("value").collect()) == sorted(BODY[:2])
    assert tuple(clinvar.filter_summary(body).first()) == (5, 2)
    assert dict(rows(clinvar.count_clinsig(kept))) == {
        "Pathogenic": 1,
        "Likely_pathogenic": 0,
        "Benign": 1,
        "Likely_benign": 0,
    }
    loose = clinvar.filter_clinvar(body, min_stars=0, exclude=("Benign",), snv_only=False)
    assert sorted(r.CLNSIG for r in loose.collect()) == ["Likely_benign", "Pathogenic"]


def test_default_exclude(spark, vcf_path):
    body = vcf_in.read_vcf(spark, vcf_path)[1]
    wanted = {"include": ("Uncertain_significance", "Benign"), "min_stars": None, "snv_only": False}
    assert {r.CLNSIG for r in clinvar.filter_clinvar(body, **wanted).collect()} <= {"Benign"}


def test_tsv_with_missing_values(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("CHROM\tPOS\tREF\tALT\tscore\n1\t5\tA\tC\tNA\n1\t6\tA\tC\t-1.5\n")
    found = scores_in.read_scores(spark, str(tmp_path / "s.tsv"))
    assert sorted((r.POS, r.score) for r in found.collect()) == [(5, None), (6, -1.5)]


def test_labels(spark, vcf_path):
    body = clinvar.with_annotations(vcf_in.read_vcf(spark, vcf_path)[1])
    assert sorted((r.CLNSIG, r.y) for r in clinvar.with_label(body).collect()) == [
        ("Benign", 0),
        ("Likely_benign", 0),
        ("Pathogenic", 1),
    ]
    assert clinvar.with_label(body, strict=False).agg(F.sum("y")).first()[0] == 1


def test_annotate_lines(spark, vcf_path):
    header, body = vcf_in.read_vcf(spark, vcf_path)
    lines = [r.value for r in export.annotated_lines(body, scores_df(spark), normalize_chrom=True).collect()]
    assert BODY[3] in lines and BODY[4] in lines
    assert sum(line.endswith(";SCORE=-12.5000") for line in lines) == 1
    assert sum(line.startswith("X\t7") and line.endswith("CLNVC=Deletion;SCORE=-9.0000") for line in lines) == 1
    plain = [r.value for r in export.annotated_lines(body, scores_df(spark).where("CHROM = 'chrX'")).collect()]
    assert sorted(plain) == sorted(BODY)
    new_header = [r.value for r in export.annotated_header(header.coalesce(1), "S", "d").collect()]
    assert new_header == HEADER[:2] + [out.info_header("S", "d"), HEADER[2]]


def test_last_alt_with_a_score_wins(spark):
    body = spark.createDataFrame([("1", 5, "A", "C,G,T")], "CHROM string, POS long, REF string, ALT string")
    scores = spark.createDataFrame([("1", 5, "A", "C", -1.0), ("1", 5, "A", "G", -2.0)], schemas.SCORES)
    for limit in (0, 10**6):
        assert lookup.annotate(body, scores, broadcast_bytes=limit).first()["score"] == -2.0


def test_write_vcf_header_first_and_batches(spark, tmp_path):
    path = str(tmp_path / "out")
    many = spark.range(50).selectExpr("'1' AS CHROM", "id AS POS", "'A' AS REF", "'C' AS ALT", "id / 8 AS score")
    out.write_vcf(many.repartition(3), path)
    out.write_vcf(scores_df(spark), path, batch=1)
    parts = sorted(p for p in (tmp_path / "out").rglob("part-*.gz"))
    text = "".join(gzip.decompress(p.read_bytes()).decode() for p in parts).splitlines()
    assert text[0] == "##fileformat=VCFv4.2" and text[2].startswith("#CHROM\tPOS")
    assert sum(line.startswith("#") for line in text) == 3 and len(text) == 56
    assert "chrX\t7\t.\tC\tT\t.\t.\tSCORE=-9.0000" in text


def test_line_order_is_kept(spark, tmp_path):
    columns = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    body = [f"1\t{i}\t.\tA\tC\t.\t.\tK={i}" for i in range(40)]
    for name, part in (("a", body[:25]), ("b", body[25:])):
        text = "\n".join(["##fileformat=VCFv4.2", f"##from={name}", columns, *part]) + "\n"
        (tmp_path / f"{name}.vcf.gz").write_bytes(gzip.compress(text.encode()))
    header, lines = vcf_in.read_vcf(spark, str(tmp_path / "a.vcf.gz"))
    out.write_vcf_lines(header, lines.where("POS % 3 <> 0"), str(tmp_path / "one"))
    text = [s for p in sorted((tmp_path / "one").glob("part-*")) for s in gzip.decompress(p.read_bytes()).decode().splitlines()]
    assert text == ["##fileformat=VCFv4.2", "##from=a", columns, *[s for i, s in enumerate(body[:25]) if i % 3]]
    out.write_vcf_lines(*vcf_in.read_vcf(spark, str(tmp_path / "*.vcf.gz")), str(tmp_path / "all"))
    text = [s for p in sorted((tmp_path / "all").glob("part-*")) for s in gzip.decompress(p.read_bytes()).decode().splitlines()]
    assert text[3] == columns and sorted(text[1:3]) == ["##from=a", "##from=b"] and sorted(text[4:]) == sorted(body)


def test_score_sources(spark, tmp_path):
    tsv = tmp_path / "s.tsv"
    tsv.write_text("CHROM\tPOS\tREF\tALT\tscore\n" + "".join("\t".join(map(str, r)) + "\n" for r in SCORES))
    assert rows(src.read_scores(spark, str(tsv))) == sorted(SCORES, key=repr)
    gz = tmp_path / "s.tsv.gz"
    gz.write_bytes(gzip.compress(tsv.read_bytes()))
    assert rows(src.read_scores(spark, str(gz))) == sorted(SCORES, key=repr)
    parquet = str(tmp_path / "s.parquet.gzip")
    scores_df(spark).withColumn("VESM", F.col("score") - 1).withColumn("VESM (3B)", F.lit(1.5)).write.option(
        "compression", "gzip"
    ).parquet(parquet)
    frame = src.read_scores(spark, parquet)
    assert frame.columns == ["CHROM", "POS", "REF", "ALT", "score"] and {r.score for r in frame.collect()} == {1.5}
    with pytest.raises(ValueError, match="no score column"):
        src.resolve_score(scores_df(spark).drop("score"))
    with pytest.raises(ValueError, match="missing required"):
        src.require_columns(scores_df(spark).drop("REF"), ["REF"])
    with pytest.raises(ValueError, match="missing required"):
        scores_df(spark).drop("ALT").write.parquet(str(tmp_path / "bad.parquet"))
        src.read_scores(spark, str(tmp_path / "bad.parquet"))


def test_custom_alias(spark):
    named = scores_df(spark).withColumnRenamed("score", "mine")
    assert src.resolve_score(named, ("mine", "score")).columns[-1] == "score"


def test_query_variant_is_pushed_down(spark, tmp_path, capsys):
    path = str(tmp_path / "s.parquet")
    scores_df(spark).write.parquet(path)
    found = lookup.query_variant(src.read_scores(spark, path), "chr1", 100, "A", "G")
    assert rows(found) == [("chr1", 100, "A", "G", -3.25)]
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(CHROM,chr1)" in plan and "EqualTo(POS,100)" in plan
    assert rows(lookup.query_variant(src.read_scores(spark, path), "1", 100, "A", "G")) == []


def test_report_and_split_files(spark, tmp_path):
    report = spark.sql("SELECT double('infinity') AS t, 3 AS n, struct(1.5D AS a) AS s")
    path = str(tmp_path / "report")
    tables.write_report(report, path)
    assert json.loads(spark.read.text(path).first()[0]) == {"t": "Infinity", "n": 3, "s": {"a": 1.5}}
    split = scores_df(spark).select("CHROM", "POS", "REF", "ALT", F.lit("Benign").alias("CLNSIG"), "score")
    tables.write_split(split.withColumn("split", F.lit("test")), str(tmp_path / "split"))
    assert rows(src.read_split(spark, str(tmp_path / "split/split=test"))) == rows(split)


def test_filter_by_score_keeps_types_on_empty_input(spark):
    empty = spark.createDataFrame([], schemas.MUTATIONS)
    assert lookup.filter_by_score(empty, -1, 1).schema == schemas.MUTATIONS
    kept = lookup.filter_by_score(scores_df(spark), max_score=-9.0)
    assert {r.score for r in kept.collect()} == {-12.5, -9.0}


def test_streamed_export_resumes(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("src", "dst", "chk"))
    scores_df(spark).limit(2).coalesce(1).write.parquet(source)
    export_new_scores(spark, source, target, check).awaitTermination()
    scores_df(spark).where("CHROM = 'chrX'").coalesce(1).write.mode("append").parquet(source)
    export_new_scores(spark, source, target, check, files_per_batch=1).awaitTermination()
    assert rows(spark.read.text(target)) == rows(out.to_vcf_lines(scores_df(spark)))
