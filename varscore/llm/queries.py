"""The registered queries of this subpackage: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from varscore.llm import (
    collocations, divergence, exact_dedup, mixing, order_minhash, quality, sentencepieces, sharding, simhash, substring_dedup, suffix_dedup, token_counts, token_files,
)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    found = simhash.classes(_table(spark, sf_dir, "documents"), words=3, bits=64, radius=3)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def held_out(id_col="doc_id"):
    """Rows whose labels are never learnt from; a null id has no remainder, and no label can be joined to it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_quality(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_token_counts(spark, sf_dir):
    tokens = token_counts.token_count(F.col("text"), public_tokenizers.path("word_bpe_49k.json"))
    docs = _table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), tokens.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_exact_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    copies = exact_dedup.duplicate_classes(docs).where("full_hash is not null")
    copies = copies.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))
    known = copies.select(F.col("doc_id").alias("known_id"), F.col("text_sha256").alias("known_hash"))
    every = docs.select("doc_id", exact_dedup.text_sha256(F.col("text")).alias("text_sha256"))
    match = F.col("doc_id").eqNullSafe(F.col("known_id")) & (F.col("text_sha256") == F.col("known_hash"))
    alone = every.join(known, match, "left_anti")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return copies.unionByName(alone)


def op5_sharding(spark, sf_dir):
    found = sharding.shards_by_rows(_table(spark, sf_dir, "documents"), shards=8)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark, sf_dir):
    """The place of every document in the mix of its source with the others, at tempered weights."""
    rows, names, _ = mixing.placed(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "source", F.col(names["weight"]).alias("weight"),
        *[F.col(names[n]).cast("long").alias(n) for n in ("row", "block", "release", "deadline", "slot")],
    )


def op8_sentencepiece(spark, sf_dir):
    found = sentencepieces.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op9_token_files(spark, sf_dir):
    found = token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_order_minhash(spark, sf_dir):
    return order_minhash.edit_report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_substring_dedup(spark, sf_dir):
    found = substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sharding": op5_sharding,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_files": op9_token_files,
    "op10_order_minhash": op10_order_minhash,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_collocations": op12_collocations,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op4_exact_dedup": r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM n
""",
    "op11_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM s),
g AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM k WHERE nth > 1),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0),
r AS (
    SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) FILTER (WHERE g.p IS NULL) AS kept, count(g.p) AS n_removed
    FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
""",
    "op12_collocations": r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
o AS (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k)
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
x AS (
    SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS score
    FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:c.k], ' ')
),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM x),
i AS (
    SELECT lang, array_to_string(string_split(phrase, ' ')[s:s + 1], ' ') AS inner_phrase, max(f) AS longer
    FROM f, (VALUES (1), (2)) v(s) WHERE k = 3 GROUP BY lang, inner_phrase
),
q AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM b LEFT JOIN i ON i.lang = b.lang AND i.inner_phrase = b.phrase
    WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * a)
)
SELECT q.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000
""",
    "op13_divergence": r"""
WITH d AS (
    SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents
),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
n AS (SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN kept ON kept.lang = o.lang AND kept.term = o.term GROUP BY o.lang, source, o.term),
s AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source),
p AS (
    SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n,
           1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p,
           1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 5)) // (lang_total + 5 * v) AS q
    FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang
    LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
),
rows AS (
    SELECT * FROM pairs
    UNION ALL
    SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
""",
}
