"""Substring dedup, collocations and the divergence audit against plain computations."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from varscore.llm import collocations, divergence, queries, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, at string, h string, term string, n string"


def made(spark, rows):
    """Documents (id, text, lang, source) with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "t", "n") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def documents():
    rnd = random.Random(11)
    words = ["alpha", "beta", "Gamma", "délta", "eps.", "zeta", "eta,", "θ", "it's", "e-mail", "x1"]
    passage = " ".join(f"shared{i}" for i in range(30))
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 90))) for _ in range(40)]
    texts += [texts[3], texts[3].replace(" ", "  "), "  " + texts[4] + "\n", passage, passage + " " + texts[5], texts[6] + " " + passage + " tail"]
    texts += [passage + " middle " + passage, "same " * 400, "same " * 50, None, "", " \t\x0b", "y" * 5000, texts[7] + "\x1c\x85 " + texts[8]]
    rows = [(i, t, rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "c", None])) for i, t in enumerate(texts)]
    return rows + [(None, texts[0] + " " + passage, "en", "a"), (3, texts[3], "en", "a"), (3, texts[9] + " " + passage, "de", "b")]


def without_repeats(rows, window=20):
    """One result per row; rows of one id are taken in the order of the operator's hash of their text."""
    seen, out = set(), []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def listed(found):
    return sorted((tuple(r) for r in found.select("id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=repr)


@pytest.mark.parametrize("window, seed", [(20, 6), (8, 3), (5, 5)])
def test_substring_dedup(spark, documents, window, seed):
    docs = made(spark, documents)
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    order = docs.select("doc_id", "text").orderBy(F.col("doc_id").isNull(), "doc_id", tie).collect()
    got = listed(substring_dedup.without_repeats(docs, window=window, seed=seed))
    assert got == sorted(without_repeats([(r.doc_id, r.text) for r in order], window), key=repr)
    assert sum(r[2] for r in got) > 300


def test_substring_dedup_long_texts_and_pieces(spark):
    rnd = random.Random(3)
    own = [f"w{rnd.randrange(50)}" for _ in range(90_000)]  # several pieces
    text, part = " ".join(own), " ".join(own[40_000:41_000])
    rows = [(1, "intro " + part + " outro"), (2, text), (3, text), (4, "tail " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(substring_dedup.without_repeats(docs)) == sorted(without_repeats(rows), key=repr)


def test_substring_dedup_text_ids_and_empty_table(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([("b", passage), ("a", passage + " x")], "doc_id string, text string")
    assert {r.id: r.n_removed for r in substring_dedup.without_repeats(docs).collect()} == {"a": 0, "b": 25}
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


def phrases(rows, words, least, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang in f:
        found, longer, ranked = {p: a for p, a in f[lang].items() if a >= least and " " in p}, Counter(), []
        for p, a in found.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    inner = " ".join(w[i : i + size])
                    longer[inner] = max(longer[inner], a)
        for p, a in found.items():
            if p not in longer or 100 * longer[p] < 50 * a:
                w = p.split(" ")
                cuts = [(f[lang][" ".join(w[:k])], f[lang][" ".join(w[k:])], k) for k in range(1, len(w))]
                score, _, left, right = min((10**6 * a * a // (x * y), k, x, y) for x, y, k in cuts)
                ranked.append((-score, -a, p.encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("words, least, top, row_bytes", [(3, 10, 2000, 2 << 20), (4, 3, 50, 400)])
def test_collocations(spark, documents, words, least, top, row_bytes):
    rows = [*documents, (90, "a b. " * 3000 + "a b c " * 700, "en", "a"), (91, "q" * 2000 + " a b c", None, "a")]
    got = collocations.collocations(made(spark, rows), words=words, least=least, top=top, row_bytes=row_bytes)
    assert sorted(tuple(r) for r in got.collect()) == phrases([(r[2], r[1]) for r in rows], words, least, top)


def test_collocations_of_no_rows(spark):
    assert collocations.collocations(made(spark, []).limit(0)).count() == 0


def test_bitmap_has_no_false_negatives(spark):
    h = [random.Random(1).randrange(1 << 40) for _ in range(5000)]
    bitmap = collocations.bitmap_of(spark.createDataFrame([(x,) for x in [0, (1 << 40) - 1, *h]], "h long"))
    import numpy as np

    assert collocations.inside(np.array([0, (1 << 40) - 1, *h]), bitmap).all()
    assert collocations.inside(np.arange(7, 1 << 40, 1 << 26), bitmap).mean() < 0.1


def apart(rows, least, top):
    counts, docs, groups, out = defaultdict(Counter), defaultdict(Counter), set(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    for lang in {g[0] for g in groups}:
        kept, sources = [t for t, n in docs[lang].items() if n >= least], [s for x, s in groups if x == lang]
        size = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        of = lambda count, total: 1 + 10**9 * (count + 5) // (total + 5 * len(kept))
        p = {s: {t: of(counts[lang, s][t], size[s]) for t in kept} for s in sources}
        q = {t: of(sum(counts[lang, s][t] for s in sources), sum(size.values())) for t in kept}
        for s in sources:
            ranked = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(ranked)}
            ranked = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("least, top, run_terms", [(5, 50, 600_000), (2, 3, 20)])
def test_divergence(spark, documents, monkeypatch, least, top, run_terms):
    monkeypatch.setattr(divergence, "SHARD_BYTES", 2000)  # several shards and runs
    monkeypatch.setattr(divergence, "FREQUENCIES", 10)
    docs = made(spark, documents)
    got = divergence.audit(docs, min_docs=least, top=top, run_terms=run_terms).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == apart([(r[2], r[3], r[1]) for r in documents], least, top)


def test_divergence_without_terms_and_rows(spark):
    docs = spark.createDataFrame([("..", "en", "a"), ("x", "en", "b"), (None, None, None)], "text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(docs).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_many_sources_are_compared_in_blocks(spark):
    """More sources than a block of the correction tables has."""
    rnd = random.Random(2)
    rows = [("en", f"s{i}", " ".join(rnd.choice(["aa", "bb", "cc", "dd"]) for _ in range(5))) for i in range(700)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = {tuple(r) for r in divergence.audit(docs).where("source in ('s3', 's650')").collect()}
    assert got == {r for r in apart(rows, 30, 50) if r[1] in ("s3", "s650")}


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_collocations", "op13_divergence"])
def test_query_columns(spark, name):
    expected = {
        "op11_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
        "op13_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    }[name]
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == expected
