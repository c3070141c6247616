import numpy as np
from conftest import rows
from pyspark.sql import functions as F
from test_genome import BINS, chunked, pieces

from varscore.operators import genome, model, proteins
from verification.queries import QUERIES
from verification.toy_scorer import faulty_scorer

SF = "/root/testdata/sf0.001"


def test_summaries_are_those_of_the_rows(spark):
    def total(scores):
        return int(np.round(scores * 1000).sum())

    given = [(f"p{i}", "ACDWFG"[: i % 7] * (i % 9)) for i in range(60)] + [("bad", "AWWA"), ("late", "A" * 30 + "WW"), ("none", None), (None, "AC")]
    sequences = spark.createDataFrame(given, "protein_id string, sequence string")
    for limits in ({}, {"batch_residues": 30, "max_length": 8, "overlap": 4}):
        found = model.tolerant_rows(sequences, faulty_scorer, **limits)
        units = F.aggregate("logits", F.lit(0).cast("long"), lambda a, v: a + F.rint(v * 1000).cast("long"))
        counted = found.groupBy("protein_id", "error").agg(F.nullif(F.count("pos"), F.lit(0)).alias("n"), F.sum(F.when(F.col("pos").isNotNull(), units)).alias("s"))
        summed = model.tolerant_summaries(sequences, faulty_scorer, total, **limits)
        assert rows(summed) == rows(counted.select("protein_id", "n", "s", "error")) != []
        assert {r.protein_id for r in summed.where("error IS NOT NULL").collect()} == {"bad", "late"}


def test_positions_stay_in_the_task(spark):
    query = QUERIES["score_tolerant"](spark, SF)
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert "logits" not in plan and "collect_list" not in plan and "Aggregate" not in plan


def test_texts_are_cut_by_characters(spark):
    """Chunks whose letters are more than one byte, beside plain ones, and pieces of one transcript over several batches."""
    contigs = {"c": "ACGéTACGTßACGTACGÅTA", "d": "acgtnACGTTGCAAACGT"}
    regions = [("t", "c", 2, 9, "+", "0"), ("t", "c", 11, 19, "+", "0"), ("u", "d", 3, 18, "-", "0"), ("v", "d", 1, 4, "+", "0")]
    found = pieces(spark, regions, contigs)
    for r in found.collect():
        assert r.seq == contigs[r.chrom][r.piece_start - 1 : r.piece_end]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        wanted = genome.extract_cds(found).collect()
        assert rows(proteins.translated(found)) == sorted((r.transcript_id, proteins.translate(r.cds)) for r in wanted)
        read = {r.transcript_id: (r.found, r.coding, r.sequence) for r in proteins.coding_residues(found).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert read["t"] == (17, 4, "XYVRT") and read["v"] == (4, 1, "T") and read["u"][:2] == (16, 4)
    assert chunked(spark, contigs).where(F.octet_length("chunk") > F.length("chunk")).count() == 3 and BINS == 5
