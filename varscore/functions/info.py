"""Column expressions on VCF INFO text and clinical annotations."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from varscore.constants import SCORE_FORMAT, SCORE_INFO_ID, STAR_RULES
from varscore.functions.once import let

#: A fraction's first part has so many steps: 26 bits.
_SPLIT = 2.0**26


def parse_info(info: Column) -> Column:
    """INFO text -> map. Items without `=` are dropped, the first `=` splits, the last duplicate wins."""
    items = F.filter(F.split(info, ";"), lambda item: F.instr(item, "=") > 0)
    entries = F.transform(
        items,
        lambda item: F.struct(
            F.substring_index(item, "=", 1).alias("key"),
            F.substr(item, F.instr(item, "=") + 1).alias("value"),
        ),
    )

    def last(found):
        """The entries whose key no later entry has, so the map never sees a duplicate."""
        return let(F.reverse(found["key"]), lambda keys: F.filter(
            found, lambda entry, i: F.array_position(keys, entry["key"]) == F.size(found) - i
        ))

    # Computed once: named in the filter, the entries would be split and cut out again for each of them.
    return F.map_from_entries(let(entries, last))


def info_value(info: Column, key: str) -> Column:
    """Value of one INFO key (last occurrence), null when absent. Plain string search, no map is built."""
    padded = F.concat(F.lit(";"), info)
    marker = f";{key}="
    value = F.substring_index(F.substring_index(padded, marker, -1), ";", 1)
    return F.when(F.instr(padded, marker) > 0, value)


def info_text(info_map: Column) -> Column:
    """Map -> `k=v;k=v` in map order."""
    pairs = F.transform(F.map_entries(info_map), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, ";")


def review_stars(status: Column) -> Column:
    """Star count of a review status: the first rule whose text occurs decides, otherwise 0."""
    text = F.lower(F.coalesce(status, F.lit("")))
    stars = F.lit(0)
    for needle, count in reversed(STAR_RULES):
        stars = F.when(F.contains(text, F.lit(needle)), F.lit(count)).otherwise(stars)
    return stars


def gene_symbol(geneinfo: Column) -> Column:
    """First symbol of `A:1|B:2`; null stays null."""
    return F.substring_index(geneinfo, ":", 1)


def strip_chr(chrom: Column) -> Column:
    """Chromosome name without one leading `chr`."""
    return F.when(F.startswith(chrom, F.lit("chr")), F.substr(chrom, F.lit(4))).otherwise(chrom)


def score_text(score: Column) -> Column:
    """Score with four decimals, rounded from its exact binary value with ties to even, as C and Python print it.

    The built-in formatter rounds the shortest decimal form half up, which differs for values such as 0.00015.
    Here the sign of the exact distance from the midpoint between two results decides, found by splitting the double into two
    short parts whose products have no rounding error wherever they come near a midpoint. The whole number is taken off
    first, which is exact, so the rule is the same for every size that a long holds. All of it is plain arithmetic: a lambda
    would keep the step out of the generated code.
    """
    size = F.abs(score)
    whole = F.floor(size)
    # Beyond a long (and for NaN) there are no decimals to round: null, and so is the text of its parts. These stand in no
    # branch, so that what they share is worked out once.
    rest = F.when(size < 9.2e18, size - whole.cast("double"))
    below = F.floor(rest * 10000)
    high = F.floor(rest * _SPLIT).cast("double") / _SPLIT
    excess = (high * 20000 - (below * 2 + 1).cast("double")) + (rest - high) * 20000
    units = below + ((excess > 0) | ((excess == 0) & (below % 2 == 1))).cast("long")
    fraction = F.lpad((units % 10000).cast("string"), 4, "0")
    text = (whole + (units >= 10000).cast("long")).cast("string"), F.lit("."), fraction
    negative = F.when(score == 0, F.startswith(score.cast("string"), F.lit("-"))).otherwise(score < 0)
    sign = F.when(negative, "-").otherwise("")
    return F.coalesce(F.concat(sign, *text), F.format_string(SCORE_FORMAT, score))


def score_info(score: Column, info_id: str = SCORE_INFO_ID) -> Column:
    return F.concat(F.lit(f"{info_id}="), score_text(score))


def vcf_line(chrom: Column, pos: Column, ref: Column, alt: Column, info: Column) -> Column:
    dot = F.lit(".")
    return F.concat_ws("\t", chrom, pos.cast("string"), dot, ref, alt, dot, dot, info)
