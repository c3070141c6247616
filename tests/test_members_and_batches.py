"""Block-compressed scans, exactly-once batches, feature hierarchies, tolerant scoring and the order of annotated lines."""

import gzip
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varscore import schemas
from varscore.operators import model
from varscore.plans import export, scoring
from varscore.sinks import batches
from varscore.sources import fasta, gff, members, vcf
from conftest import rows

LINES = [f"line {i} " + "x" * (i * 37 % 900) for i in range(3000)] + ["", "é", "last"]


def blocks(text: bytes, size=4000) -> bytes:
    return b"".join(members.member(text[i : i + size]) for i in range(0, len(text), size)) + members.END_MEMBER


@pytest.mark.parametrize("end", ["\n", ""])
@pytest.mark.parametrize("split_bytes", [1, 700, 5000, 1 << 20])
def test_every_line_once_in_order(tmp_path, end, split_bytes):
    """Ranges of any size, also those without a member start or within one long line, give each line to one range."""
    text = ("\n".join([*LINES[:700], "y" * 20_000, *LINES[700:900]]) + end).encode()
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(blocks(text))
    assert gzip.decompress(path.read_bytes()) == text
    reader = members.MembersReader({"path": str(path), "splitbytes": str(split_bytes if split_bytes > 1 else 97)})
    found = [line for part in reader.partitions() for batch in reader.read(part) for line in batch.column("value").to_pylist()]
    assert found == text.decode().removesuffix("\n").split("\n")


def test_members_are_read_by_many_tasks(spark, tmp_path):
    text = "\n".join(LINES).encode()
    (tmp_path / "b.gz").write_bytes(blocks(text))
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"one\r\ntwo\n") + gzip.compress(b"three"))
    (tmp_path / "notes.txt").write_text("not read")
    found = members.read_members(spark, str(tmp_path), 3000)
    assert found.rdd.getNumPartitions() > 5
    got = found.collect()
    assert [r.value for r in got] == ["one", "two", "three", *LINES]
    ours = [(r.split, r.line) for r in got if r.file.endswith("b.gz")]
    assert ours == sorted(ours)
    assert members.read_members(spark, str(tmp_path)).where("value = 'three'").count() == 1


def test_plain_gzip_comes_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(members, "BLOCK_LINES", 7)
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress("\n".join([">a x", *["ACGT" * 15] * 40, ">b", "TT"]).encode()))
    reader = members.MembersReader({"path": str(tmp_path / "c.fa.gz")})
    (part,) = reader.partitions()
    (batch,) = reader.read(part)
    assert batch.column("split").to_pylist() == [i // 7 for i in range(43)]
    got = {(r.contig, r.bin): r.chunk for r in fasta.read_fasta(spark, str(tmp_path / "c.fa.gz"), 1000).collect()}
    text = "ACGT" * 600
    assert got == {("a", 0): text[:1000], ("a", 1): text[1000:2000], ("a", 2): text[2000:], ("b", 0): "TT"}


def test_written_members_are_valid_gzip(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1)
    parts = members.write_members(df, str(tmp_path / "out")).collect()
    assert [(p.part, p.lines) for p in parts] == [("part-00000.gz", len(LINES))]
    data = (tmp_path / "out" / "part-00000.gz").read_bytes()
    assert gzip.decompress(data).decode() == "".join(f"{x}\n" for x in LINES) and len(data) == parts[0].bytes
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["part-00000.gz"]


def test_bad_numbers_are_rejects(spark):
    lines = spark.createDataFrame([("##h",), ("1\tx\t.\tA\tT\t.\t.\tI",), ("1\t5\t.\tA\tT\t.\t.\tI",), ("1\t5",)], "value string")
    assert [r.POS for r in vcf.vcf_body(lines).collect()] == [None, 5, 5]
    assert [r.value[:3] for r in vcf.vcf_rejects(lines).collect()] == ["1\tx", "1\t5"]
    lines = spark.createDataFrame([("c\ts\tCDS\tone\t9\t.\t+\t0\tParent=t",), ("c\ts\tCDS\t1\t9\t.\t+\t0\tParent=t",)], "value string")
    assert [r.start_pos for r in gff.cds_regions(gff.gff_features(lines)).collect()] == [None, 1]
    assert gff.gff_rejects(lines).count() == 1


def feature(kind, name, parent, start=1):
    attributes = ";".join(x for x in (name and f"ID={name}", parent and f"Parent={parent}") if x)
    return (f"c\ts\t{kind}\t{start}\t9\t.\t+\t0\t{attributes}",)


def test_hierarchies_of_any_depth(spark):
    lines = [feature("gene", "g", None), feature("mRNA", "t1", "g"), feature("mRNA", "t2", "g"), feature("exon", "e", "t1,t2"), feature("polypeptide", "p", "t2"),
             feature("CDS", None, "e", 1), feature("CDS", "k", "p", 2), feature("CDS", None, "t1", 3), feature("CDS", None, "e,t1", 4), feature("CDS", None, "nowhere", 5)]
    features = gff.gff_features(spark.createDataFrame(lines, "value string"))
    cds = {(r.transcript_id, r.start_pos) for r in gff.descendant_cds(features).collect()}
    assert cds == {("t1", 1), ("t2", 1), ("t2", 2), ("t1", 3), ("t1", 4), ("t2", 4)}
    assert gff.descendant_cds(features).count() == 6
    assert {r.start_pos for r in gff.descendant_cds(features, "gene").collect()} == {1, 2, 3, 4}
    chain = [feature("x", f"n{i}", f"n{i + 1}") for i in range(20)]
    paths = gff.ancestors(gff.gff_features(spark.createDataFrame(chain, "value string")))
    assert rows(paths.where("id = 'n0'").select("hops")) == [(i + 1,) for i in range(20)] or paths.where("id = 'n0'").count() == 20
    assert all(int(r.ancestor[1:]) - int(r.id[1:]) == r.hops for r in paths.collect())
    with pytest.raises(ValueError, match="own ancestor"):
        gff.ancestors(gff.gff_features(spark.createDataFrame([*chain, feature("x", "n20", "n3")], "value string")))
    assert gff.descendant_cds(features.limit(0)).count() == 0


def test_a_run_that_dies_neither_loses_nor_repeats(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "batches")
    df = spark.createDataFrame([("1", i, "A", "T", float(i)) for i in range(10)], schemas.SCORES)
    keys = df.select(F.col("POS").cast("string").alias("transcript_id"))
    assert batches.read_rows(spark, root, schemas.SCORES).count() == 0 == batches.manifest(spark, root).count()
    with monkeypatch.context() as broken:
        def dies(*_):
            raise RuntimeError("killed")

        broken.setattr(batches, "publish", dies)
        with pytest.raises(RuntimeError):
            batches.append_batch(df.where("POS < 5"), keys.limit(5), root, "b1")
    assert batches.read_rows(spark, root, schemas.SCORES).count() == 0
    assert batches.append_batch(df.where("POS < 5"), keys.where("transcript_id < 5"), root, "b1")
    assert not batches.append_batch(df.where("POS < 5"), keys, root, "b1")
    assert batches.append_batch(df.where("POS >= 5"), keys.where("transcript_id >= 5"), root, "b2")
    batches.publish(spark, root, "b2", batches.write_batch(df.where("POS >= 5"), keys, root, "b2"))  # a race of two runs
    assert rows(batches.read_rows(spark, root, schemas.SCORES)) == rows(df)
    assert rows(batches.manifest(spark, root).select("batch", "n_rows")) == [("b1", 5), ("b2", 5)]
    assert batches.read_keys(spark, root, scoring.DONE).distinct().count() == 10


def test_scored_batches_resume(spark, tmp_path):
    root = str(tmp_path / "scores")
    transcripts = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "transcript_id string")
    regions = spark.createDataFrame([("t1", "c", 1, 6, "+", "0"), ("t2", "c", 1, 3, "+", "0")], "transcript_id string, chrom string, start_pos long, end_pos long, strand string, phase string")
    chunks = spark.createDataFrame([("c", 0, "ATGTGG")], "contig string, bin long, chunk string")
    matrix = spark.createDataFrame([(t, i, [0.5] * 20) for t in ("t1", "t2") for i in (0, 1)], "transcript_id string, codon_idx long, llr array<double>")
    first = transcripts.where("transcript_id = 't1'")
    added, rejects = scoring.score_batch(first, regions, chunks, matrix, root, "one")
    assert added and rejects.count() == 0
    added, rejects = scoring.score_batch(transcripts, regions, chunks, matrix, root, "two")
    assert added and rows(rejects) == [("t3", "no_cds")]
    found = batches.read_rows(spark, root, schemas.GENERATED_SCORES)
    assert rows(found.groupBy("TranscriptID").count()) == [("t1", 16), ("t2", 9)]
    assert rows(batches.read_keys(spark, root, scoring.DONE)) == [("t1",), ("t2",)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300), st.integers(2, 50), st.data())
def test_windows_take_every_position_once(length, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    found = model.windows(length, limit, overlap)
    assert [p for *_, a, b in found for p in range(a, b)] == list(range(length))
    assert all(s <= a <= b <= e <= length and e - s <= max(limit, 0) for s, e, a, b in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40), st.integers(1, 200))
def test_no_batch_above_the_budget(lengths, budget):
    found = list(model.budgeted(lengths, budget))
    assert sorted(i for b in found for i in b) == list(range(len(lengths)))
    assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) <= budget for b in found)


def test_tolerant_scoring(spark):
    def per_residue():
        def score(sequences):
            if any("W" in s for s in sequences):
                raise RuntimeError("no W, please")
            if len(sequences) * max(map(len, sequences)) > 40 and len(sequences) > 1:
                raise MemoryError("above the budget")
            if any(s.startswith("P") for s in sequences):
                return [np.zeros((1, 20))] * len(sequences)
            return [np.array([[ord(c) + j / 32 for j in range(20)] for c in s]) for s in sequences]

        return score

    rnd = random.Random(1)
    proteins = [(f"p{i}", "".join(rnd.choice("ACDEFG") for _ in range(rnd.randrange(1, 60)))) for i in range(50)]
    proteins += [("bad1", "AAWA"), ("long_bad", "A" * 50 + "W" + "A" * 50), ("shape", "PAAA"), ("none", None), ("empty", ""), (None, "AC")]
    df = spark.createDataFrame(proteins, "protein_id string, sequence string")
    scores, rejects = model.score_tolerant(df, per_residue, batch_residues=40, max_length=20, overlap=6)
    got = {}
    for r in scores.collect():
        assert r.logits == [ord(r.ref_aa) + j / 32 for j in range(20)]
        got.setdefault(r.protein_id, {})[r.pos] = r.ref_aa
    good = {p: s for p, s in proteins if s and p not in ("bad1", "long_bad", "shape")}
    assert {p: "".join(x for _, x in sorted(v.items())) for p, v in got.items()} == good
    reasons = {r.protein_id: r.reason for r in rejects.collect()}
    assert reasons == {"bad1": "RuntimeError: no W, please", "long_bad": "RuntimeError: no W, please", "shape": "ValueError: scores of shape (1, 20) for 4 residues"}
    assert scores.dtypes == [("protein_id", "string"), ("pos", "int"), ("ref_aa", "string"), ("logits", "array<double>")]


def test_annotated_lines_keep_their_order_at_any_size(spark):
    rnd = random.Random(2)
    lines = [(f"{rnd.randrange(1, 5)}\t{rnd.randrange(1, 200)}\tid{i}\tA\t{rnd.choice(['T', 'T,G', '.'])}\t.\t.\tX={i}",) for i in range(2000)]
    body = vcf.vcf_body(spark.createDataFrame(lines, "value string").repartition(5))
    scores = spark.createDataFrame([(str(c), p, "A", "T", -float(p)) for c in range(1, 5) for p in range(1, 150)], schemas.SCORES)
    order = [r.ID for r in body.collect()]
    small = [r.value for r in export.annotated_lines(body, scores).collect()]
    shuffled = [r.value for r in export.annotated_lines(body, scores, broadcast_bytes=0).collect()]
    assert small == shuffled and [x.split("\t")[2] for x in small] == order
    assert sum("SCORE=" in x for x in small) > 500
