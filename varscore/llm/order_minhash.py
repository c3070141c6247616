"""Order MinHash fingerprints in DataFrame functions only.

A text is a sequence of words; k-mers of words are numbered by occurrence, so repeats count. Each sketch has a random order
of its own over all numbered k-mers and takes the two smallest of the whole text, in text order; the ordered pair is
hashed, so both which k-mers a text has and their order decide: the share of equal sketches falls with the edit distance.

A sketch's order puts the k-mers whose hash falls into its bin (one of SKETCHES) first, by that hash, and all the others
behind, by a hash with the number of the sketch. Each k-mer is equally likely at each place, as with one hash function
for each sketch, but only sketches with less than two k-mers in their bin (few in texts of more than 400 words) go
through the whole text.

Nulls and texts without words have the empty fingerprint; two of them have likeness 1. A text of one numbered k-mer has
no pair; its sketches hash the k-mer alone. A text of fewer than k words is one k-mer. Equal texts have equal fingerprints. Positions take 28 bits, more than a string column can hold words.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varscore.functions.once import evaluate_once, let
from varscore.llm.common import narrow, shuffle_partitions, written

SKETCHES, POSITION_BITS = 64, 28
_MASK, _BIN_SHIFT = (1 << POSITION_BITS) - 1, 58
_LOW, _SIGN = (1 << _BIN_SHIFT) - 1, -(1 << 63)


def _packed(h: Column, position: Column) -> Column:
    return h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(position.cast("long"))


def _changes(ordered: Column, shift: int, i: Column) -> Column:
    """Whether element i starts a new run of equal high bits."""
    return (i == 0) | (F.shiftright(F.get(ordered, i), shift) != F.shiftright(F.get(ordered, i - 1), shift))


def kmer_hashes(words: Column, k: int) -> Column:
    """Hashes of the k-mers of an array of words in text order."""

    def chained(hashes):
        n = F.size(hashes) - (k - 1)
        out = F.slice(hashes, 1, n)
        for shift in range(1, k):
            out = F.zip_with(out, F.slice(hashes, shift + 1, n), lambda a, b: F.xxhash64(a, b))
        short = F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(hashes)))
        return F.when(n < 1, short).otherwise(out)

    return let(F.transform(words, lambda w: F.xxhash64(w)), chained)


def occurrences(ordered: Column) -> Column:
    """For sorted values, the occurrence number 0, 1, ... within each run of equal hashes."""
    indices = F.when(F.size(ordered) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(ordered) - 1))
    starts = F.filter(indices, lambda i: _changes(ordered, POSITION_BITS, i))

    def numbered(s):
        ends = F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(ordered)))
        return F.flatten(F.zip_with(s, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))

    return F.when(F.size(ordered) == 0, F.array().cast("array<int>")).otherwise(let(starts, numbered))


def _bin(x: Column) -> Column:
    return F.shiftright(x, _BIN_SHIFT)


def _placed(x: Column, sketch: Column) -> Column:
    """A numbered k-mer's place in the order of a sketch, above its position: negative within the bin of the sketch."""
    inside = x.bitwiseAND(F.lit(_LOW)).bitwiseOR(F.lit(_SIGN))
    outside = _packed(F.xxhash64(F.shiftright(x, POSITION_BITS), sketch).bitwiseAND(F.lit(~_SIGN)), x.bitwiseAND(F.lit(_MASK)))
    return F.when(_bin(x) == sketch, inside).otherwise(outside)


def _code(sketch: Column, a: Column, b: Column) -> Column:
    """Sketch number and 16 bits of the hash of two places in text order; `b` is null where the text has one k-mer."""
    hash_of, position = (lambda x: F.shiftright(x, POSITION_BITS)), (lambda x: x.bitwiseAND(F.lit(_MASK)))
    pair = F.when(position(a) < position(b), F.xxhash64(hash_of(a), hash_of(b))).otherwise(F.xxhash64(hash_of(b), hash_of(a)))
    value = F.when(b.isNull(), F.xxhash64(hash_of(a))).otherwise(pair)
    return F.shiftleft(sketch + SKETCHES // 2, 16).bitwiseOR(value.bitwiseAND(F.lit(0xFFFF))).cast("int")


def sketches(numbered: Column) -> Column:
    """The sorted codes of all sketches, from the sorted numbered k-mers of a text."""
    every = F.array(*[F.lit(b).cast("long") for b in range(-SKETCHES // 2, SKETCHES // 2)])

    def from_bin(two):  # the two smallest of each bin: a sketch with both is done
        def code(x, i):
            after = F.get(two, i + 1)
            return F.when(_bin(after) == _bin(x), _code(_bin(x), _placed(x, _bin(x)), _placed(after, _bin(x))))

        return F.array_compact(F.transform(two, code))

    def from_text(sketch):
        def smallest(places):
            return let(F.array_min(places), lambda a: _code(sketch, a, F.array_min(F.filter(places, lambda p: p != a))))

        return let(F.transform(numbered, lambda x: _placed(x, sketch)), smallest)

    def complete(codes):
        done = F.transform(codes, lambda c: (F.shiftright(c, 16) - SKETCHES // 2).cast("long"))
        return F.sort_array(F.concat(codes, F.transform(F.array_except(every, done), from_text)))

    two = F.filter(numbered, lambda x, i: (i < 2) | (_bin(F.get(numbered, i - 2)) != _bin(x)))
    found = let(let(two, from_bin), complete)
    return F.when(F.size(numbered) == 0, F.array().cast("array<int>")).otherwise(found)


def signature(text: Column, k=2) -> Column:
    """The codes of a text's sketches, array<int>."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    ordered = let(kmer_hashes(words, k), lambda h: F.sort_array(F.transform(h, _packed)))

    def numbered(s):
        rehash = lambda v, o: _packed(F.xxhash64(F.shiftright(v, POSITION_BITS), o), v.bitwiseAND(F.lit(_MASK)))
        return F.sort_array(F.zip_with(s, occurrences(s), rehash))

    return let(let(ordered, numbered), sketches)


def fingerprint(codes: Column) -> Column:
    return F.array_join(codes.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among those that either text has; 1 for two empty fingerprints."""
    number = lambda codes: F.transform(codes, lambda c: F.shiftright(c, 16))
    either = F.size(F.array_union(number(a), number(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", k=2) -> DataFrame:
    """Rows (id, codes, fingerprint) of each document."""
    codes = evaluate_once(narrow(docs, id_col, text_col), codes=signature(F.col("text"), k))
    return codes.select("id", "codes", fingerprint(F.col("codes")).alias("fingerprint"))


def id_ranges(rows: DataFrame, parts: int) -> Column:
    """The number of the id range of `id`: binary search over quantiles of the ids; null ids lie in the last range."""
    bits = max(1, (parts - 1).bit_length())
    probabilities = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    bounds = rows.select(F.col("id").cast("double").alias("id")).approxQuantile("id", probabilities, 0.2 / (1 << bits)) or [0.0] * len(probabilities)
    table = F.array(*[F.lit(float(b)) for b in sorted(bounds)])
    step = lambda lo, s: F.when(F.get(table, lo + s - 1) <= F.col("id"), lo + s).otherwise(lo)
    found = F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), step)
    return F.when(F.col("id").isNull(), F.lit((1 << bits) - 1)).otherwise(found)


def with_next(docs: DataFrame, id_col="doc_id", text_col="text", parts=None) -> DataFrame:
    """Rows (range, id, text, next_text): the text of the next document by ascending (numeric) id; after the last comes
    the first. Equal ids are ordered by text, null ids come last.

    Rows are dealt to id ranges once; only the first document of each range, found by its id, goes to the range before.
    """
    rows = narrow(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", id_ranges(rows, parts or shuffle_partitions(docs)))
    first = rows.groupBy("range").agg(F.min("id").alias("first_id"))
    known = written(rows.join(F.broadcast(first), "range").where("id <=> first_id").groupBy("range").agg(F.min("text").alias("first_text")), "firsts")
    order = Window.orderBy("range")  # one row per range
    overall = F.first("first_text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = known.select("range", F.coalesce(F.lead("first_text").over(order), overall).alias("after_text"))
    within = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_last(), "text")
    led = rows.withColumn("lead_text", F.lead("text").over(within))
    joined = led.join(after, "range")
    return joined.select("range", "id", "text", F.coalesce("lead_text", "after_text").alias("next_text"), F.col("lead_text").isNull().alias("is_last"))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many of the next text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(next_text, F.lit(1), quarter))


def edit_report(docs: DataFrame, id_col="doc_id", text_col="text", k=2) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document."""
    rows = with_next(docs, id_col, text_col)
    rows = evaluate_once(rows, edited_text=edited(F.col("text"), F.col("next_text")))
    last_codes = F.when(F.col("is_last"), signature(F.col("next_text"), k))
    rows = evaluate_once(
        rows.select("range", "id", "text", "edited_text", F.when(F.col("is_last"), F.col("next_text")).alias("next_text"), "is_last"),
        n_chars=F.length("text").cast("long"), edited_sha256=F.sha2(F.col("edited_text").cast("binary"), 256),
        codes=signature(F.col("text"), k), edited_codes=signature(F.col("edited_text"), k), last_codes=last_codes,
        tie=F.xxhash64("text"),
    ).drop("edited_text", "next_text")
    within = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_last(), "text")
    rows = rows.withColumn("next_codes", F.coalesce(F.lead("codes").over(within), F.col("last_codes")))
    return rows.select(
        "id", "n_chars", "edited_sha256", fingerprint(F.col("codes")).alias("fingerprint"), fingerprint(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )
