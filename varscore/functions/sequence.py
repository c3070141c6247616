"""Column expressions on nucleotide and amino-acid text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from varscore.constants import AMINO_ACIDS, codon_text


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def complement(seq: Column) -> Column:
    return F.translate(F.upper(seq), "ACGT", "TGCA")


def codon_aa(codon: Column) -> Column:
    """Amino acid of one codon, null when the codon holds anything but ACGT. One search in a short text finds its place; a
    map would be gone through key by key."""
    text, letters = codon_text()
    place = F.when(F.length(codon) == 3, F.instr(F.lit(text), F.upper(codon)) - 1)
    return F.get(F.array(*[F.lit(aa) for aa in letters]), place)


def codon_array(cds: Column) -> Column:
    """Whole codons in order, found in one pass over the text; a trailing partial codon is left out."""
    return F.regexp_extract_all(F.upper(cds), F.lit("..."), F.lit(0))


def translate_cds(cds: Column) -> Column:
    """Protein text of a coding sequence; unknown codons become X."""
    return F.array_join(F.transform(codon_array(cds), lambda c: F.coalesce(codon_aa(c), F.lit("X"))), "")


def aa_index(aa: Column) -> Column:
    """0-based place in the fixed amino-acid order, null for any other letter."""
    place = F.instr(F.lit(AMINO_ACIDS), aa)
    return F.when((F.length(aa) == 1) & (place > 0), place - 1)


def aa_at(index: Column) -> Column:
    return F.when(
        index.between(0, len(AMINO_ACIDS) - 1), F.substr(F.lit(AMINO_ACIDS), index.cast("int") + 1, F.lit(1))
    )


def region_length(start: Column, end: Column) -> Column:
    """Length of a 1-based inclusive region."""
    return end - start + 1
