"""Whole-text translation, and the scoring that reads it."""

import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from varscore.functions.numbers import rounded, rounded_array
from varscore.functions.sequence import translate_cds
from varscore.operators import genome, model, proteins
from verification.queries import QUERIES
from verification.toy_scorer import faulty_scorer, toy_scorer

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_texts_are_translated_as_codons_are(spark):
    draw = random.Random(5)
    texts = [None, "", "A", "AT", "ATG", "atgTAAgg", "NNNATG", "AT\nGATG", "A\r\nTGC", "ßATGC", "ATGéTAATAA", "AT\u2028GTAG", "AT\u0085GTAG", "😀ATGTAA", "A\tG T-"]
    texts += ["".join(draw.choice("ACGTacgtN") for _ in range(draw.randrange(200))) for _ in range(300)]
    given = [(f"{strand}{i}", strand, 1, text) for i, text in enumerate(texts) for strand in "+-"]
    given += [("-two", "-", 4, "cat"), ("-two", "-", 1, "TTA"), ("+two", "+", 4, "GG"), ("+two", "+", 1, "atgT")]
    pieces = spark.createDataFrame(given, "transcript_id string, strand string, piece_start long, seq string")
    wanted = genome.extract_cds(pieces).select("transcript_id", translate_cds(F.col("cds")))
    assert rows(proteins.translated(pieces)) == rows(wanted)


def test_scored_proteins_are_not_translated_codon_by_codon(spark):
    assert "instr(" not in plan(QUERIES["score_sequences"](spark, SF))


def test_toy_scores_repeat_after_thirteen_places():
    place = np.arange(1, 41)[:, None]
    logits = (place * np.arange(1, 21)[None, :]) % 13 / 4.0
    wanted = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert [x.tolist() for x in toy_scorer()(["A" * 40, "", "WW"])] == [wanted.tolist(), [], wanted[:2].tolist()]


def test_arrays_are_rounded_as_columns_are(spark):
    draw = random.Random(3)
    values = [0.0, -0.0, 1e-9, -1e-9, 0.5e-6, -0.5e-6, 2.5e-6, 0.49999999999999994e-6, 1e300, np.inf, -np.inf, 9e9, -9.1e9]
    values += [draw.uniform(-20, 20) for _ in range(3_000)] + [draw.randint(-(10**8), 10**8) / 2e7 for _ in range(3_000)]
    given = spark.createDataFrame(list(enumerate(values)), "i long, v double").select("i", rounded(F.col("v"), 6).alias("r"))
    found = rounded_array(np.array(values), 6)
    assert [repr(r) for _, r in sorted(given.collect())] == [repr(float(r)) for r in found]
    assert np.isnan(rounded_array(np.array([np.nan]), 6)[0])


def test_scores_are_rounded_in_the_scorer(spark):
    def scorer():
        return lambda sequences: [[[-1.23456789] * 20] * len(s) for s in sequences]

    given = spark.createDataFrame([("p", "AC")], "protein_id string, sequence string")
    assert [r.logits for r in model.score_sequences(given, scorer, digits=3).collect()] == [[-1.235] * 20] * 2
    named = model.score_sequences(given, scorer, digits=3, columns=[f"c {i}" for i in range(20)])
    assert rows(named) == [("p", 0, "A", *[-1.235] * 20), ("p", 1, "C", *[-1.235] * 20)]
    assert "FLOOR" not in plan(QUERIES["score_sequences"](spark, SF)).split("MapInArrow")[0]


def test_scores_and_rejects_of_one_pass_that_is_not_kept(spark):
    given = [(f"p{i}", "ACDWFG"[: i % 7] * (i % 4)) for i in range(40)] + [("bad", "AWWA"), ("none", None)]
    sequences = spark.createDataFrame(given, "protein_id string, sequence string")
    scores, rejects = model.score_tolerant(sequences, faulty_scorer, batch_residues=30, max_length=8, overlap=4)
    found = model.tolerant_rows(sequences, faulty_scorer, batch_residues=30, max_length=8, overlap=4)
    assert rows(found.where("error IS NULL").drop("error")) == rows(scores) != []
    assert rows(found.where("error IS NOT NULL")) == [("bad", None, None, [], "ValueError: doubled tryptophan")]
    assert rows(rejects) == [("bad", "ValueError: doubled tryptophan")]
    tolerant = QUERIES["score_tolerant"](spark, SF)
    assert plan(tolerant).count("MapInArrow") == 2 and "instr(" not in plan(tolerant)
    assert "SortAggregate" not in tolerant._jdf.queryExecution().executedPlan().toString()
