import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varscore import schemas
from varscore.constants import AMINO_ACIDS, codon_table
from varscore.operators import genome, joins, matrix, model
from varscore.plans import scoring
from varscore.sinks import tables, vcf as out
from varscore.sources import fasta, gff
from verification.toy_scorer import toy_scorer

REGIONS = "transcript_id string, chrom string, start_pos long, end_pos long, strand string, phase string"
BINS = 5


def chunked(spark, contigs, bases=BINS):
    data = [(name, i // bases, seq[i : i + bases]) for name, seq in contigs.items() for i in range(0, len(seq), bases)]
    return spark.createDataFrame(data, "contig string, bin long, chunk string")


def pieces(spark, regions, contigs):
    frame = spark.createDataFrame(regions, REGIONS)
    return genome.fetch_regions(genome.exon_offsets(frame), chunked(spark, contigs), BINS)


def test_code_and_snv_table(spark):
    table = codon_table()
    assert len(table) == 64 and table["ATG"] == "M" and table["TGG"] == "W" and [table[c] for c in ("TAA", "TAG", "TGA")] == ["*"] * 3
    snvs = genome.codon_snvs(spark)
    assert snvs.count() == 576 and snvs.where(genome.is_missense()).count() == 392
    changes = genome.codon_mutations(spark.createDataFrame([("ATG",), ("TGG",), ("NNN",)], "codon string"))
    assert {r.codon: r.n for r in changes.groupBy("codon").agg(F.count("*").alias("n")).collect()} == {"ATG": 9, "TGG": 9}
    missense = changes.where(genome.is_missense()).groupBy("codon").agg(F.count("*").alias("n"))
    assert {r.codon: r.n for r in missense.collect()} == {"ATG": 9, "TGG": 7}


def test_minus_strand_by_hand(spark):
    regions = [("t", "c", 1, 3, "-", "0"), ("t", "c", 7, 9, "-", "0")]
    found = pieces(spark, regions, {"c": "AAACCCGGG"})
    assert genome.extract_cds(found).first().cds == "CCCTTT"
    offsets = spark.createDataFrame([("t", i) for i in (0, 2, 3, 5, 6)], "transcript_id string, cds_offset long")
    exons = genome.exon_offsets(spark.createDataFrame(regions, REGIONS))
    assert [(r.cds_offset, r.pos) for r in genome.cds_to_genome(offsets, exons).orderBy("cds_offset").collect()] == [
        (0, 9),
        (2, 7),
        (3, 3),
        (5, 1),
    ]
    first = genome.missense_snvs(genome.placed_codons(found)).where("POS = 9").first()
    assert first.REF == "G"


def test_codon_across_exons(spark):
    regions = [("t", "c", 1, 4, "-", "0"), ("t", "c", 7, 11, "-", "0")]
    found = pieces(spark, regions, {"c": "AAACCCGGGTTT"})
    assert genome.extract_cds(found).first().cds == "AACCCGTTT"
    second = genome.placed_codons(found).where("codon_idx = 1").first()
    assert (second.codon, second.p0, second.p1, second.p2) == ("CCG", 8, 7, 4)


def random_genes(seed):
    """Contigs with soft-masked bases and transcripts of many short exons on both strands."""
    rng = random.Random(seed)
    contigs = {f"c{i}": "".join(rng.choice("ACGTacgt") for _ in range(rng.randint(60, 200))) for i in range(4)}
    regions = []
    for i, (name, seq) in enumerate(contigs.items()):
        for strand in "+-":
            at = rng.randint(1, 5)
            while at < len(seq) - 12:
                end = at + rng.randint(0, 11)
                regions.append((f"t{i}{strand}", name, at, end, strand, "0"))
                at = end + rng.randint(2, 9)
    rng.shuffle(regions)
    return contigs, regions


@pytest.mark.parametrize("seed", [1, 2])
def test_placed_codons_against_brute_force(spark, seed):
    contigs, regions = random_genes(seed)
    flip = str.maketrans("ACGT", "TGCA")
    expected = []
    for name in sorted({r[0] for r in regions}):
        exons = sorted(r for r in regions if r[0] == name)
        minus = exons[0][4] == "-"
        places = [(r[1], p) for r in sorted(exons, key=lambda r: r[2]) for p in range(r[2], r[3] + 1)]
        places = places[::-1] if minus else places
        bases = [contigs[c][p - 1].upper() for c, p in places]
        bases = [b.translate(flip) for b in bases] if minus else bases
        for k in range(len(bases) // 3):
            spots = [p for _, p in places[3 * k : 3 * k + 3]]
            expected.append((name, k, "".join(bases[3 * k : 3 * k + 3]), *spots))
    found = pieces(spark, regions, contigs)
    placed = genome.placed_codons(found)
    assert rows(placed.select("transcript_id", "codon_idx", "codon", "p0", "p1", "p2")) == sorted(expected, key=repr)
    whole = genome.codons(genome.extract_cds(found))
    assert rows(whole.selectExpr("transcript_id", "cast(codon_idx AS long)", "codon")) == sorted(
        (e[:3] for e in expected), key=repr
    )
    # REF always equals the contig base at POS.
    for r in genome.missense_snvs(placed).select("CHROM", "POS", "REF", "ALT").distinct().collect():
        assert contigs[r.CHROM][r.POS - 1].upper() == r.REF != r.ALT


def test_generate_scores_rejects_and_resume(spark, tmp_path):
    contigs, regions = random_genes(3)
    regions += [("gone", "nowhere", 1, 9, "+", "0"), ("cut", "c0", 1, 9_999, "+", "0")]
    lines = [f"{r[1]}\tx\tCDS\t{r[2]}\t{r[3]}\t.\t{r[4]}\t0\tID=cds;Parent={r[0]}" for r in regions]
    names = sorted({r[0] for r in regions}) + ["empty"]
    lines += ["##gff-version 3"] + [f"c0\tx\tmRNA\t1\t9\t.\t+\t.\tID={n};Name=z" for n in names]
    path = tmp_path / "genes.gff3"
    path.write_text("\n".join(lines) + "\n")
    features = gff.read_gff(spark, str(path))
    transcripts = gff.all_transcripts(features)
    assert [r[0] for r in transcripts.collect()] == sorted(names)
    cds = gff.transcript_cds(features)
    assert rows(cds) == sorted(regions, key=repr)
    chunks = chunked(spark, contigs)
    placed = genome.placed_codons(pieces(spark, regions[:-2], contigs))
    ratios = F.array(*[F.lit(-float(i)) for i in range(19)], F.lit(float("nan")))
    llr = placed.select("transcript_id", "codon_idx", ratios.alias("llr"))
    scores, rejects = scoring.generate_scores(transcripts, cds, chunks, llr, bases=BINS)
    assert rows(rejects) == [("cut", "missing_sequence"), ("empty", "no_cds"), ("gone", "missing_sequence")]
    wanted = genome.missense_snvs(placed).where("alt_aa <> 'Y'")
    assert scores.count() == wanted.count() > 0
    for r in scores.select("score", "AltAA").distinct().collect():
        assert r.score == -AMINO_ACIDS.index(r.AltAA)
    target = str(tmp_path / "scores.parquet")
    tables.append_scores(scores.where("TranscriptID LIKE '%+'"), target)
    rest, _ = scoring.resume_scores(transcripts, cds, chunks, llr, spark.read.parquet(target), bases=BINS)
    tables.append_scores(rest, target)
    stored = spark.read.parquet(target)
    assert rows(stored) == rows(scores) and stored.schema.fieldNames() == schemas.GENERATED_SCORES.fieldNames()
    assert rows(out.from_records(out.to_records(scores))) == rows(scores.select(schemas.GENERATED_SCORES.fieldNames()))


def test_chunk_under_many_regions(spark, monkeypatch):
    regions = [(f"t{i}", "c", 2, 4, "+", "0") for i in range(30)] + [("u", "c", 6, 9, "+", "0")]
    plain = rows(pieces(spark, regions, {"c": "AAACCCGGGT"}))
    monkeypatch.setattr(joins, "HOT_SHARE", 0.1)
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    hot = pieces(spark, regions, {"c": "AAACCCGGGT"})
    assert rows(hot) == plain and len(plain) == 31


def test_offsets_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(genome, "_BLOCK_BASES", 10)
    contigs, regions = random_genes(4)
    got = {(r.transcript_id, r.start_pos): r.cds_start for r in genome.exon_offsets(spark.createDataFrame(regions, REGIONS)).collect()}
    for name in {r[0] for r in regions}:
        exons = sorted((r for r in regions if r[0] == name), key=lambda r: r[2], reverse=name.endswith("-"))
        total = 0
        for r in exons:
            assert got[(name, r[2])] == total
            total += r[3] - r[2] + 1


def test_fasta_over_many_splits(spark, tmp_path):
    contigs, _ = random_genes(5)
    contigs["tiny"] = "A"
    folder = tmp_path / "fa"
    folder.mkdir()
    text = "".join(
        f">{n} some text\n" + "".join(s[i : i + 7] + "\n" for i in range(0, len(s), 7)) for n, s in contigs.items()
    )
    (folder / "a.fa").write_text(text + ">none\n")
    (folder / "b.fa").write_text(">other\r\nACGT\r\nAC\r\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = rows(fasta.read_fasta(spark, str(folder), BINS))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    contigs["other"] = "ACGTAC"
    assert got == rows(chunked(spark, contigs))


def test_matrices(spark):
    logits = [float((i * 7) % 11) for i in range(20)]
    positions = spark.createDataFrame(
        [("p", 0, "C", logits), ("p", 1, "X", logits), ("p", 2, "*", logits)],
        "protein_id string, pos int, ref_aa string, logits array<double>",
    )
    llr = matrix.llr_matrix(positions)
    assert llr.count() == 1
    ratios = [v - logits[1] for v in logits]
    assert list(matrix.matrix_wide(llr).first())[3:] == ratios
    long = matrix.matrix_long(llr)
    assert {r.alt_aa: r.llr for r in long.collect()} == dict(zip(AMINO_ACIDS, ratios))
    assert list(matrix.pivot_long(long, ["protein_id", "pos"]).first())[2:] == ratios
    mean = sum(abs(v) for v in ratios) / 19
    assert matrix.conservation(llr, ["protein_id", "pos"]).first().conservation == pytest.approx(mean)
    snvs = spark.createDataFrame([("p", 0, "D"), ("p", 5, "D")], "transcript_id string, codon_idx int, alt_aa string")
    named = long.withColumnsRenamed({"protein_id": "transcript_id", "pos": "codon_idx"})
    assert [r.llr for r in matrix.attach_llr(snvs, named).collect()] == [ratios[2]]


def test_codons_without_a_matrix_row_are_rejects(spark):
    codons = spark.createDataFrame(
        [("a", 0, "ATG"), ("a", 1, "TAA"), ("b", 0, "ATG"), ("b", 1, "AAA"), ("c", 0, "ATG")],
        "transcript_id string, codon_idx int, codon string",
    )
    matrix_rows = spark.createDataFrame([("a", 0), ("b", 1)], "transcript_id string, codon_idx int")
    assert rows(scoring.matrix_rejects(codons, matrix_rows)) == [("b", "partial_matrix"), ("c", "no_matrix")]


def test_scorer_runs_in_tasks(spark):
    proteins = spark.createDataFrame([("a", "MKV"), ("b", ""), ("c", "W")], "protein_id string, sequence string")
    scored = model.score_sequences(proteins, toy_scorer, batch_size=2)
    assert [(r.protein_id, r.pos, r.ref_aa) for r in scored.orderBy("protein_id", "pos").collect()] == [
        ("a", 0, "M"),
        ("a", 1, "K"),
        ("a", 2, "V"),
        ("c", 0, "W"),
    ]
    total = scored.select(F.aggregate("logits", F.lit(0.0), lambda a, v: a + F.exp(v)).alias("t"))
    assert all(abs(r.t - 1) < 1e-9 for r in total.collect())


def test_ranges_of_offsets_give_what_single_offsets_give(spark, monkeypatch):
    """Exons shorter and longer than a bucket, ranges beyond the coding sequence and empty ones."""
    regions = [("t", "c", a, b, "-", "0") for a, b in ((1, 3), (5, 5), (9, 40))] + [("u", "c", 2, 2, "+", "0"), ("u", "c", 7, 30, "+", "0")]
    exons = genome.exon_offsets(spark.createDataFrame(regions, REGIONS))
    ranges = [("t", 0, 35), ("t", 3, 4), ("u", 1, 99), ("u", 5, 4), ("gone", 0, 9)]
    single = spark.createDataFrame([(t, i) for t, a, b in ranges for i in range(a, b + 1)], "transcript_id string, cds_offset long")
    spans = spark.createDataFrame(ranges, "transcript_id string, first_offset long, last_offset long")
    monkeypatch.setattr(genome, "_OFFSET_BUCKET", 4)
    expected = rows(genome.cds_to_genome(single, exons))
    monkeypatch.setattr(genome, "_RANGE_BUCKET", 7)
    assert len(expected) == 36 + 2 + 24 and rows(genome.ranges_to_genome(spans, exons)) == expected
