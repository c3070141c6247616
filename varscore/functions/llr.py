"""Column expressions on per-position amino-acid logits (arrays in the fixed amino-acid order)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from varscore.functions.once import let
from varscore.functions.sequence import aa_index


def log_softmax(logits: Column) -> Column:
    """Numerically stable log-softmax of an array of doubles."""

    def shifted(top):
        total = F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return let(F.ln(total), lambda norm: F.transform(logits, lambda v: v - top - norm))

    return let(F.array_max(logits), shifted)


def pick(values: Column, aa: Column) -> Column:
    """Array element of one amino acid; null when the letter is not one of the twenty."""
    return F.get(values, aa_index(aa))


def log_likelihood_ratio(logits: Column, ref_aa: Column, alt_aa: Column) -> Column:
    """log p(alt) - log p(ref); the normaliser cancels, so logits do as well as log-probabilities."""
    return pick(logits, alt_aa) - pick(logits, ref_aa)


def residue_matches(sequence: Column, position: Column, ref_aa: Column) -> Column:
    """Whether the sequence has `ref_aa` at a position inside it."""
    inside = (position >= 0) & (position < F.length(sequence))
    return inside & (F.substr(sequence, (position + 1).cast("int"), F.lit(1)) == ref_aa)


def variant_llr(sequence: Column, position: Column, ref_aa: Column, alt_aa: Column, logits: Column) -> Column:
    """Guarded ratio: null for a position outside the sequence or a reference that does not match it."""
    return F.when(residue_matches(sequence, position, ref_aa), log_likelihood_ratio(logits, ref_aa, alt_aa))


def llr_row(logits: Column, ref_aa: Column) -> Column:
    """All twenty ratios of one position; the reference residue gets exactly 0."""
    return let(pick(logits, ref_aa), lambda reference: F.transform(logits, lambda v: v - reference))
