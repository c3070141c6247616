"""Fixed values that decide results: label sets, rule texts, alphabets, formats."""

# --- fixed values -----------------------------------------------------------
PATHOGENIC_LABELS = ("Pathogenic", "Likely_pathogenic")
BENIGN_LABELS = ("Benign", "Likely_benign")
IGNORED_LABELS = (
    "Conflicting_interpretations_of_pathogenicity",
    "Uncertain_significance",
    "Drug_response",
    "Other",
    "Association",
    "Risk_factor",
    "Protective",
    "Affects",
    "Not_provided",
)
SNV_CLASS = "single_nucleotide_variant"

# Review-status texts with their star count, tested in this order.
STAR_RULES = (
    ("guideline", 4),
    ("criteria_provided,_multiple_submitters", 4),
    ("reviewed_by_expert_panel", 3),
    ("criteria_provided,_conflicting_interpretations", 2),
    ("criteria_provided,_single_submitter", 2),
    ("no_criteria", 1),
    ("single_submitter", 1),
)

# Column names under which score tables carry their score, in order of priority.
SCORE_ALIASES = ("VESM (3B)", "VESM(3B)", "VESM_3B", "VESM", "score")
KEY_COLUMNS = ("CHROM", "POS", "REF", "ALT")

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Standard genetic code (NCBI translation table 1), codons in TCAG order.
CODON_BASES = "TCAG"
CODON_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

VCF_COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")
VCF_FILE_FORMAT = "##fileformat=VCFv4.2"
SCORE_DESCRIPTION = (
    "ESM-2 based pathogenicity score. Log-Likelihood Ratio. Negative values indicate pathogenicity."
)
SCORE_FORMAT = "%.4f"
# --- end of fixed values ----------------------------------------------------

# Default name of the INFO field that carries the score; pass `info_id` to use another one.
SCORE_INFO_ID = "SCORE"


def codon_table():
    """codon -> amino acid (`*` = stop) for all 64 codons."""
    codons = (a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES)
    return dict(zip(codons, CODON_AMINO_ACIDS))


def codon_text():
    """`(text, amino acids)`: each codon stands once in the text of 66 letters, at the place of its amino acid."""
    text, seen = "AA", set()
    while len(seen) < 64:  # always the last base in order that gives a new codon
        base = next(b for b in "TGCA" if text[-2:] + b not in seen)
        seen.add(text[-2:] + base)
        text += base
    table = codon_table()
    return text, [table[text[i : i + 3]] for i in range(64)]
