"""The clustered score store against plain filters, and the single block-compressed file against its lines."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from varscore.operators import lookup
from varscore.sinks import clustered, member_file
from varscore.sources import members

SCHEMA = "CHROM string, POS long, REF string, ALT string, score double, _copy string"


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(4)
    made = [(f"chr{rnd.randrange(1, 4)}", rnd.randrange(1, 400_000), rnd.choice("AC"), rnd.choice("GT"), float(i), "c") for i in range(3000)]
    made += [("chr2", 777, "A", "G", float(i % 3), "c") for i in range(1500)]  # a third of all rows at one position
    made += [(None, 5, "A", "G", 0.5, None), ("chr1", None, "A", "G", 0.5, None), made[0]]
    return spark.createDataFrame(made, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def store(spark, scores, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "scores")
    clustered.write_clustered(scores, path, 64)
    return path


def test_store_keeps_every_row_in_order(spark, scores, store):
    assert rows(clustered.read_clustered(spark, store)) == rows(scores)
    files = clustered.file_table(spark, store)
    assert files.agg(F.sum("n_rows")).first()[0] == scores.count()
    assert files.select("file").distinct().count() > 50
    most = files.groupBy("file").agg(F.sum("n_rows").alias("n")).agg(F.max("n")).first()[0]
    assert most < 300  # the hot position is spread over files
    for part in clustered.read_clustered(spark, store).inputFiles():
        keys = [(r.CHROM or "", r.POS or 0) for r in spark.read.parquet(part).coalesce(1).collect()]
        assert keys == sorted(keys)


def test_a_position_opens_one_file(spark, scores, store):
    some = scores.where("CHROM = 'chr1' AND POS > 1000").orderBy("POS").first()
    found = clustered.query_variant(spark, store, "chr1", some.POS, some.REF, some.ALT)
    assert len(found.inputFiles()) == 1
    assert rows(found) == rows(lookup.query_variant(scores, "chr1", some.POS, some.REF, some.ALT))
    hot = clustered.in_interval(spark, store, "chr2", 777, 777)
    assert 1 < len(hot.inputFiles()) < 64 and hot.count() == scores.where("CHROM = 'chr2' AND POS = 777").count()


@pytest.mark.parametrize("span", [("chr3", 1, 50_000), ("chr2", 700, 900), ("chr1", 399_000, 10**9), ("chr9", 1, 10), ("chr1", 9, 3)])
def test_intervals(spark, scores, store, span):
    chrom, start, end = span
    expected = scores.where((F.col("CHROM") == chrom) & F.col("POS").between(start, end))
    assert rows(clustered.in_interval(spark, store, *span)) == rows(expected)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_key_sets(spark, scores, store, limit):
    wanted = scores.where("POS % 50 = 3 OR POS IS NULL OR CHROM IS NULL").select(F.regexp_replace("CHROM", "chr", "").alias("CHROM"), "POS", "REF", "ALT")
    wanted = wanted.unionByName(wanted.limit(3)).unionByName(wanted.limit(1).withColumn("POS", F.lit(10**12)))
    got = clustered.lookup_scores(spark, store, wanted, broadcast_bytes=limit)
    assert rows(got) == rows(lookup.lookup_scores(scores, wanted)) and got.count() > 20
    one = spark.createDataFrame([("3", scores.where("CHROM = 'chr3'").agg(F.max("POS")).first()[0])], "CHROM string, POS long")
    assert clustered.files_with(clustered.file_table(spark, store), one).count() == 1
    assert clustered.lookup_scores(spark, store, wanted.limit(0)).count() == 0
    assert clustered.lookup_scores(spark, store, wanted, normalize_chrom=False).count() == 0


def test_empty_store(spark, scores, tmp_path):
    path = str(tmp_path / "none")
    clustered.write_clustered(scores.limit(0), path, 4)
    assert clustered.read_clustered(spark, path).columns == scores.columns
    assert clustered.in_interval(spark, path, "chr1", 1, 10**6).count() == 0
    assert clustered.lookup_scores(spark, path, scores).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        clustered.write_clustered(scores, path)


def test_single_file_is_its_lines(spark, tmp_path):
    made = [f"line {i} é " + "x" * (i * 37 % 900) for i in range(5000)] + [""]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "i long, value string").repartitionByRange(7, "i").sortWithinPartitions("i").cache()  # the same partitions in both runs
    text = "".join(f"{x}\n" for x in made).encode()
    written = []
    for name, at_offsets in (("a.gz", None), ("b.gz", False)):
        path = tmp_path / "out" / name
        size = member_file.write_member_file(lines, str(path), at_offsets=at_offsets)
        written.append(path.read_bytes())
        assert len(written[-1]) == size and gzip.decompress(written[-1]) == text
        assert [r.value for r in members.read_members(spark, str(path), 20_000).collect()] == made
    assert written[0] == written[1] and written[0].endswith(members.END_MEMBER) and written[0].count(members.END_MEMBER) == 1
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.gz", "b.gz"]
    with pytest.raises(FileExistsError):
        member_file.write_member_file(lines, str(tmp_path / "out" / "a.gz"))
    assert member_file.write_member_file(lines.limit(0), str(tmp_path / "out" / "a.gz"), mode="overwrite") == len(members.END_MEMBER)
    assert gzip.decompress((tmp_path / "out" / "a.gz").read_bytes()) == b""


def test_header_comes_first(spark, tmp_path):
    header = spark.createDataFrame([("##a",), ("#CHROM\tPOS",), ("##b",), ("##a",)], "value string")
    body = spark.range(0, 1000, 1, 6).select(F.concat(F.lit("1\t"), F.col("id")).alias("value"))
    member_file.write_vcf_file(header, body, str(tmp_path / "c.vcf.gz"))
    found = gzip.decompress((tmp_path / "c.vcf.gz").read_bytes()).decode().split("\n")
    assert found == ["##a", "##b", "#CHROM\tPOS", *[f"1\t{i}" for i in range(1000)], ""]
