"""From coding regions and reference chunks to missense single-nucleotide changes in genome coordinates.

Regions: `(transcript_id, chrom, start_pos, end_pos, strand, phase)`, 1-based inclusive.
Reference: `(contig, bin, chunk)` as made by `sources.fasta`.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varscore.constants import AMINO_ACIDS, CODON_BASES, codon_table
from varscore.functions.sequence import aa_index, codon_array, complement, reverse_complement
from varscore.operators.joins import join_unique, key_counts
from varscore.runtime import checkpointed, even_partitions
from varscore.sources.fasta import CHUNK_BASES

# Exons of one transcript do not overlap, so a block of this many bases bounds the exons summed in one task.
_BLOCK_BASES = 1_000_000
# About an exon: an offset meets the one or two exons of its bucket, not all within a thousand bases.
_OFFSET_BUCKET = 64
_RANGE_BUCKET = 1_000


def codon_snvs(spark: SparkSession) -> DataFrame:
    """The 576 single-nucleotide changes of the 64 codons: `(codon, place, ref, alt, ref_aa, alt_aa)`."""
    table = codon_table()
    rows = [
        (codon, place, codon[place], base, aa, table[codon[:place] + base + codon[place + 1 :]])
        for codon, aa in table.items()
        for place in range(3)
        for base in CODON_BASES
        if base != codon[place]
    ]
    # As values of the plan: rows handed over from Python would start workers for them.
    return spark.sql(f"VALUES {', '.join(map(str, rows))} AS changes (codon, place, ref, alt, ref_aa, alt_aa)")


def is_missense():
    """Another amino acid, neither side a stop."""
    twenty = list(AMINO_ACIDS)
    return F.col("ref_aa").isin(twenty) & F.col("alt_aa").isin(twenty) & (F.col("ref_aa") != F.col("alt_aa"))


def aa_to_codons(codons: DataFrame) -> DataFrame:
    """Codons in use by amino acid, sorted (at most six per letter)."""
    return codons.groupBy("aa").agg(F.array_join(F.array_sort(F.collect_set("codon")), ",").alias("codons"))


def exon_offsets(regions: DataFrame) -> DataFrame:
    """Add `cds_start`, the number of coding bases before each exon in reading direction.

    Reading direction is ascending on `+` and descending on `-`. The running sum has two levels, inside blocks
    of the contig and over the blocks of a transcript, so even a transcript with very many exons is spread.
    """
    along = F.when(F.col("strand") == "-", -F.col("end_pos")).otherwise(F.col("start_pos"))
    sized = regions.withColumns(
        {
            "_along": along,
            "_block": F.floor(along / _BLOCK_BASES),
            "_size": F.col("end_pos") - F.col("start_pos") + 1,
        }
    )
    over_blocks = (
        Window.partitionBy("transcript_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = (
        sized.groupBy("transcript_id", "_block")
        .agg(F.sum("_size").alias("_sum"))
        .select("transcript_id", "_block", F.coalesce(F.sum("_sum").over(over_blocks), F.lit(0)).alias("_base"))
    )
    in_block = (
        Window.partitionBy("transcript_id", "_block").orderBy("_along").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sized.withColumn("_inner", F.coalesce(F.sum("_size").over(in_block), F.lit(0)))
        .join(blocks, ["transcript_id", "_block"])
        .withColumn("cds_start", F.col("_base") + F.col("_inner"))
        .drop("_along", "_block", "_size", "_inner", "_base")
    )


def fetch_regions(regions: DataFrame, chunks: DataFrame, bases: int = CHUNK_BASES) -> DataFrame:
    """Reference text of every region, in pieces cut at chunk borders.

    Each region names the chunks it touches, which turns the interval lookup into an equi-join on
    (contig, bin). A chunk under very many regions is treated as a hot key. Adds `piece_start`, `piece_end` (1-based inclusive) and `seq` (reference strand).
    """
    touched = regions.withColumn(
        "bin",
        F.explode(F.sequence(F.floor((F.col("start_pos") - 1) / bases), F.floor((F.col("end_pos") - 1) / bases))),
    )
    on = ["chrom", "bin"]
    counts = checkpointed(key_counts(touched, on))
    # Characters are counted once per chunk, not once per region. Where each is a byte, texts are cut as bytes, without a search.
    sized = chunks.withColumnRenamed("contig", "chrom").select(
        "chrom",
        "bin",
        "chunk",
        F.length("chunk").cast("long").alias("_size"),
        (F.octet_length("chunk") == F.length("chunk")).alias("_plain"),
    )
    # Dealt by number, so that the pieces, which become many rows each, are not gathered in a few partitions for their size.
    parts = even_partitions(chunks)
    pieces = join_unique(touched.repartition(parts, *on), sized.repartition(parts, *on), on, counts)
    bin_start = F.col("bin") * bases + 1
    at = (F.col("piece_start") - bin_start + 1).cast("int")
    size = (F.col("piece_end") - F.col("piece_start") + 1).cast("int")
    plain = F.substr(F.col("chunk").cast("binary"), at, size).cast("string")
    return (
        pieces.withColumn("piece_start", F.greatest(F.col("start_pos"), bin_start))
        .withColumn("piece_end", F.least(F.col("end_pos"), bin_start + F.col("_size") - 1))
        .where(F.col("piece_start") <= F.col("piece_end"))
        .withColumn("seq", F.when(F.col("_plain"), plain).otherwise(F.substr("chunk", at, size)))
        .drop("chunk", "bin", "_size", "_plain")
    )


def forward_cds(pieces: DataFrame) -> DataFrame:
    """`(transcript_id, strand, forward)`: the text of all pieces of a transcript as it stands on the reference strand."""
    part = F.struct(F.col("piece_start").alias("at"), F.col("seq").alias("text"))
    forward = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "")
    return pieces.groupBy("transcript_id").agg(F.first("strand").alias("strand"), forward.alias("forward"))


def extract_cds(pieces: DataFrame) -> DataFrame:
    """Coding sequence per transcript in reading direction, upper case. The text is the result row itself."""
    cds = F.when(F.col("strand") == "-", reverse_complement(F.col("forward"))).otherwise(F.upper("forward"))
    return forward_cds(pieces).select("transcript_id", "strand", cds.alias("cds"))


def codons(cds: DataFrame) -> DataFrame:
    """`(transcript_id, codon_idx, codon)` of whole coding sequences."""
    return cds.select("transcript_id", F.posexplode(codon_array(F.col("cds"))).alias("codon_idx", "codon"))


def placed_codons(pieces: DataFrame) -> DataFrame:
    """Codons with the genome position of each base, straight from exon pieces.

    Needs `cds_start` from `exon_offsets`. Codons inside one piece are cut out where the piece is; only the one
    or two bases left over at piece borders are regrouped by codon. No transcript is assembled, and positions
    are arithmetic, not a join.
    """
    minus = F.col("strand") == "-"
    at = F.when(minus, F.col("end_pos") - F.col("piece_end")).otherwise(F.col("piece_start") - F.col("start_pos"))
    read = pieces.select(
        "transcript_id",
        "chrom",
        "strand",
        (F.col("cds_start") + at).alias("off"),
        F.length("seq").alias("size"),
        "seq",
        F.when(minus, F.col("piece_end")).otherwise(F.col("piece_start")).alias("origin"),
        F.when(minus, -1).otherwise(1).alias("step"),
    ).withColumns(
        {
            "first": F.ceil(F.col("off") / 3),
            "last": F.floor((F.col("off") + F.col("size")) / 3) - 1,
        }
    )
    skip = F.col("first") * 3 - F.col("off")
    turned = F.when(minus, reverse_complement(F.col("seq"))).otherwise(F.upper("seq"))
    inner = (
        read.where(F.col("last") >= F.col("first"))
        .select(
            "*",
            F.posexplode(codon_array(F.substr(turned, (skip + 1).cast("int")))).alias("i", "codon"),
        )
        .select(
            "transcript_id",
            "chrom",
            "strand",
            (F.col("first") + F.col("i")).alias("codon_idx"),
            "codon",
            *[(F.col("origin") + F.col("step") * (skip + F.col("i") * 3 + j)).alias(f"p{j}") for j in range(3)],
        )
    )
    # Left-over bases: up to two before the first and two after the last whole codon (four when there is none).
    near = F.array(*[F.lit(k) for k in range(4)], *[F.col("size") - k for k in range(4, 0, -1)])

    def left_over(k):
        codon = F.floor((F.col("off") + k) / 3)
        return (k >= 0) & (k < F.col("size")) & ((codon < F.col("first")) | (codon > F.col("last")))

    # Only the letters that are left over are turned, not the text of the piece for their sake.
    letter = F.substr("seq", F.when(minus, F.col("size") - F.col("k")).otherwise(F.col("k") + 1), F.lit(1))
    base = read.select("*", F.explode(F.array_distinct(F.filter(near, left_over))).alias("k")).select(
        "transcript_id",
        "chrom",
        "strand",
        F.floor((F.col("off") + F.col("k")) / 3).alias("codon_idx"),
        ((F.col("off") + F.col("k")) % 3).alias("j"),
        F.ascii(F.when(minus, complement(letter)).otherwise(F.upper(letter))).alias("base"),
        (F.col("origin") + F.col("step") * F.col("k")).alias("pos"),
    )

    def of(j, name):
        return F.max(F.when(F.col("j") == j, F.col(name)))

    # A group holds the three bases of one codon, as numbers: text would be aggregated by sorting.
    joined = base.groupBy("transcript_id", "chrom", "strand", "codon_idx").agg(
        F.concat(*[F.char(of(j, "base")) for j in range(3)]).alias("codon"), *[of(j, "pos").alias(f"p{j}") for j in range(3)]
    )
    return inner.unionByName(joined.where(F.col("codon").isNotNull()))


def codon_mutations(codon_rows: DataFrame) -> DataFrame:
    """Each codon with the single-nucleotide changes that alter its amino acid (stops included)."""
    changes = codon_snvs(codon_rows.sparkSession).where(F.col("ref_aa") != F.col("alt_aa"))
    return codon_rows.join(F.broadcast(changes), "codon")


def missense_snvs(codon_rows: DataFrame, kept=()) -> DataFrame:
    """All missense changes in protein and CDS coordinates; genome columns are added when positions are given.

    Codons with ratios pass them on as `llr`, with the place of the new amino acid in them as `aa_idx`. `kept` names more
    columns of the codons to pass on.
    """
    # Bases of the other strand and places are worked out for the few changes of the code, not for each one found.
    turned = {f"{c}_turned": complement(F.col(c)) for c in ("ref", "alt")}
    changes = codon_snvs(codon_rows.sparkSession).where(is_missense()).withColumns({**turned, "aa_idx": aa_index(F.col("alt_aa"))})
    found = codon_rows.join(F.broadcast(changes), "codon")
    columns = [
        "transcript_id",
        F.col("codon_idx").cast("long").alias("codon_idx"),
        (F.col("codon_idx") * 3 + F.col("place")).cast("long").alias("cds_pos"),
        "codon",
        "ref_aa",
        "alt_aa",
    ]
    extra = [*(["llr", "aa_idx"] if "llr" in codon_rows.columns else []), *kept]
    if "p0" not in codon_rows.columns:
        return found.select(*columns, "ref", "alt", *extra)
    minus = F.col("strand") == "-"
    position = F.when(F.col("place") == 0, F.col("p0")).when(F.col("place") == 1, F.col("p1")).otherwise(F.col("p2"))
    return found.select(
        *columns,
        F.col("chrom").alias("CHROM"),
        position.alias("POS"),
        F.when(minus, F.col("ref_turned")).otherwise(F.col("ref")).alias("REF"),
        F.when(minus, F.col("alt_turned")).otherwise(F.col("alt")).alias("ALT"),
        *extra,
    )


def _stretches(exons: DataFrame, bases: int):
    """Size of an exon, and the exons once for each bucket of `bases` offsets that they reach into."""
    size = F.col("end_pos") - F.col("start_pos") + 1
    reached = F.sequence(F.floor(F.col("cds_start") / bases), F.floor((F.col("cds_start") + size - 1) / bases))
    columns = ["transcript_id", "chrom", "start_pos", "end_pos", "strand", "cds_start"]
    return size, exons.select(*columns, F.explode(reached).alias("bucket"))


def ranges_to_genome(ranges: DataFrame, exons: DataFrame) -> DataFrame:
    """Genome position of every offset of `(transcript_id, first_offset, last_offset)`, both inclusive.

    As `cds_to_genome`, but ranges and exons meet in buckets and are cut to each other; single offsets only come into being
    after the join, so they are neither shuffled nor tried against exons that do not hold them.
    """
    size, stretches = _stretches(exons, _RANGE_BUCKET)
    low, high = (F.floor(F.col(c) / _RANGE_BUCKET) for c in ("first_offset", "last_offset"))
    wanted = ranges.where("first_offset <= last_offset").withColumn("bucket", F.explode(F.sequence(low, high)))
    edge = F.col("bucket") * _RANGE_BUCKET
    first = F.greatest("first_offset", "cds_start", edge)
    last = F.least("last_offset", F.col("cds_start") + size - 1, edge + _RANGE_BUCKET - 1)
    cut = wanted.join(stretches, ["transcript_id", "bucket"]).withColumns({"_first": first, "_last": last})
    kept = [c for c in ranges.columns if c not in ("first_offset", "last_offset")]
    hits = cut.where("_first <= _last").select("*", F.explode(F.sequence("_first", "_last")).alias("cds_offset"))
    return hits.select(*kept, "cds_offset", "chrom", _position().alias("pos"))


def _position():
    inside = F.col("cds_offset") - F.col("cds_start")
    return F.when(F.col("strand") == "-", F.col("end_pos") - inside).otherwise(F.col("start_pos") + inside)


def cds_to_genome(offsets: DataFrame, exons: DataFrame) -> DataFrame:
    """Genome position of each 0-based CDS offset. `exons` carries `cds_start`.

    Offsets and exons meet on (transcript, offset bucket), so a pair is only tried when they are close; offsets
    outside the coding sequence give no row.
    """
    size, stretches = _stretches(exons, _OFFSET_BUCKET)
    wanted = offsets.withColumn("bucket", F.floor(F.col("cds_offset") / _OFFSET_BUCKET))
    inside = F.col("cds_offset") - F.col("cds_start")
    # Exons are the few rows: hashed, so that the many offsets are not sorted.
    hits = wanted.join(stretches.hint("shuffle_hash"), ["transcript_id", "bucket"]).where((inside >= 0) & (inside < size))
    return hits.select(*offsets.columns, "chrom", _position().alias("pos"))
