"""Each operator against a plain computation, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from varscore.llm import exact_dedup, mixing, order_minhash, quality, sentencepieces, sharding, simhash, suffix_dedup, token_counts, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, cell string, h string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "Eps", "zeta7", "eta,", "theta."]
    made = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120))) for _ in range(40)]
    line = "a passage that many of these documents share, long enough to be found by its hundred bytes of text, surely. "
    made += [made[0], made[1] + " \n", made[2] + " end", line + made[3], made[4] + line, line + line, None, "", " \t", "x" * 900, "word " * 3000]
    return made


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "a" if i % 3 else None, 1, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def linked(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, texts, empty):
    prints = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    expected = linked(list(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = {r.id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}
    assert simhash.classes(empty).count() == 0


def test_near_duplicates_keep_columns(docs, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    same = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    expected = {i for i, r in linked(list(sets), lambda i, j: same(sets[i], sets[j])).items() if i == r}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == expected


def test_near_duplicates_go_by_id_and_text(spark):
    """Null and repeated ids, and columns with the names that the operators use themselves."""
    line = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, line), (2, line + " end"), (2, other), (None, "start " + line), (None, other + " end"), (None, "alone here"), (None, None), (7, "")]
    names = "own string, d_id string, d_tie string, d_hash string, sha string, key string"
    docs = spark.createDataFrame([(*r, *"uvwxyz") for r in rows], f"doc_id long, text string, {names}")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, line), (2, other), (None, "alone here"), (7, "")], key=repr)
    found = {(r.id, r.component_id) for r in simhash.similar_classes(docs).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (2, 2), (None, 2), (None, None), (None, 7), (7, 7)}
    assert exact_dedup.drop_duplicates(docs.unionByName(docs)).count() == len(rows) - 1  # null and empty are equal
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_cells_meet_whatever_the_parts(parts):
    rnd = random.Random(parts)
    cell = lambda x: " ".join(map(str, [0, *((x >> (64 // parts) * (parts - 1 - k) & (1 << 64 // parts) - 1).bit_count() for k in range(parts))]))
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << rnd.randrange(64) for _ in range(3)) if rnd.random() < 0.5 else a ^ 1
        if (a ^ b).bit_count() <= 3:
            assert cell(b) in simhash.partners(cell(a), 3, False) or cell(a) in simhash.partners(cell(b), 3, False)


def test_exact_classes(spark, docs, texts, empty):
    norm = {i: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r") for i, t in enumerate(texts)}
    groups = {}
    for i in norm:
        groups.setdefault(norm[i], []).append(i)
    expected = {}
    for members in groups.values():
        keep = min(members, key=lambda i: (-len(texts[i] or ""), i))
        expected |= {i: (keep, len(members), i == keep) for i in members}
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_classes(docs).collect()}
    assert got == expected
    assert {r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()} == {i for i, e in expected.items() if e[2]}
    assert exact_dedup.duplicate_classes(empty).count() == 0
    twice = exact_dedup.drop_duplicates(docs.where("doc_id < 5").unionAll(docs.where("doc_id < 5")))
    assert sorted(r.doc_id for r in twice.collect()) == [0, 1, 2, 3, 4]


def test_shards(docs, empty):
    rows = sharding.shards_by_rows(docs, 8).collect()
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert len({r.id for r in rows}) == len(rows) == docs.count()
    assert sharding.shards_by_rows(empty, 8).count() == 0


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(drawn.mean() - 6) < 0.15 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


@pytest.mark.parametrize("shard_bytes", [1 << 20, 3000])
def test_repeated_bytes(docs, texts, empty, shard_bytes):
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(b[k : k + 100])
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        expected[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    got = suffix_dedup.without_repeats(docs, shard_bytes=shard_bytes).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == expected
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_suffix_array_and_prefixes():
    rnd = random.Random(2)
    for _ in range(30):
        t = np.frombuffer(bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(1, 200))), np.uint8)
        words, raw = suffix_dedup.packed_words(t), t.tobytes()
        sa = suffix_dedup.suffix_array(t, words)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        got = suffix_dedup.common_prefixes(t, words, sa).tolist()
        for a, b, n in zip(sa.tolist(), sa.tolist()[1:], got[1:]):
            x, y = raw[a:], raw[b:]
            assert n == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_mixing(docs, empty):
    rows, names, period = mixing.placed(docs, block_rows=2)
    placed = rows.collect()
    assert len(placed) == docs.count()
    assert all(r[names["release"]] <= r[names["slot"]] < r[names["deadline"]] for r in placed)
    assert len({(r["source"], r[names["block"]]) for r in placed}) == len({r[names["slot"]] for r in placed})
    mixed = mixing.mix(docs, 4)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()
    assert mixing.mix(empty, 4).count() == 0


def test_mixing_against_a_plain_schedule(spark):
    """Slot by slot, the released block with the earliest deadline runs, ties by source; no source is a block from its target."""
    from fractions import Fraction

    weights, count = {"a": Fraction(61, 100), "b": Fraction(3, 10), "c": Fraction(9, 100)}, {"a": 40, "b": 31, "c": 12}
    rows = [(i, s) for i, s in enumerate(s for s, n in count.items() for _ in range(n))]
    found, names, _ = mixing.placed(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block_rows=1)
    windows = [(s, i, i / w // 1, -(-(i + 1) / w // 1)) for s, w in weights.items() for i in range(count[s])]
    expected, slot = {}, 0
    while windows:
        ready = [(deadline, s, i, release) for s, i, release, deadline in windows if release <= slot]
        if ready:
            deadline, s, i, release = min(ready)
            expected[s, i] = slot
            windows.remove((s, i, release, deadline))
        slot += 1
    assert {(r.source, r[names["block"]]): r[names["slot"]] for r in found.collect()} == expected
    until = max(slot for (s, _), slot in expected.items() if s == "a")  # no source has run out before
    for at in range(until):
        done = {s: sum(1 for (t, _), k in expected.items() if t == s and k <= at) for s in weights}
        assert all(done[s] == count[s] or abs(done[s] - w * (at + 1)) < 1 for s, w in weights.items())


def test_mixing_exact_weights(spark):
    from fractions import Fraction

    n, weights = 300, {"big": 0.5, "none": 0} | {f"s{i}": 0.5 / 98 for i in range(98)}
    rows = [(i, "big") for i in range(n)] + [(n + i, s) for i, s in enumerate([*weights][1:] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    found, names, _ = mixing.placed(docs, weights=weights, block_rows=1)
    found = sorted(found.collect(), key=lambda r: r[names["slot"]])
    total = sum(Fraction(w) for w in weights.values())
    assert len({r[names["slot"]] for r in found}) == len(found) == len(rows)
    assert [r["source"] for r in found[-3:]] == ["none"] * 3 and found[-1][names["release"]] is None
    for r in found[:-3]:
        w, i = Fraction(weights[r["source"]]) / total, r[names["block"]]
        assert r[names["weight"]] == float(w)
        assert (r[names["release"]], r[names["deadline"]]) == (i / w // 1, -(-(i + 1) / w // 1))
        assert r[names["release"]] <= r[names["slot"]] < r[names["deadline"]]


def test_mixing_many_sources(spark):
    n = 100_001
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    placed, names, _ = mixing.placed(docs)
    slot = F.col(names["slot"])
    inside = (F.col(names["release"]) == 0) & (F.col(names["deadline"]) == n)
    got = placed.agg(F.count("*"), F.countDistinct(slot), F.min(slot), F.max(slot), F.bool_and(inside)).first()
    assert tuple(got) == (n, n, 0, n - 1, True)


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = {r.doc_id: r.n for r in docs.select("doc_id", token_counts.token_count(F.col("text"), path).alias("n")).collect()}
    assert got == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_files(docs, texts, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, at, expected = Tokenizer.from_file(path), 0, {}
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for kind in ("byte", "bit"):
        got = {r.id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.round_trip(docs, path, kind=kind).collect()}
        assert got == expected
    assert token_files.round_trip(empty, path).count() == 0


def test_sentencepiece(docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.id: (r.n_tokens, r.ids_crc32, r.round_trip) for r in sentencepieces.encoded(docs, path, giant=300, chunk=80).collect()}
    for i, t in enumerate(texts):
        ids = np.array(plain.encode(t or ""), "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_pipeline_keeps_the_mix(spark):
    """The output of the last stage follows the slots, also where giant documents take another way."""
    import corpus_pipeline
    from varscore.llm.common import written

    rows = [(i, "word " * (14_000 if i % 40 == 0 else 5), "en", "ab"[i % 3 == 0], 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    placed, names, _ = mixing.placed(docs)
    expected = [r.doc_id for r in sorted(placed.collect(), key=lambda r: (r[names["slot"]], r[names["row"]]))]
    mixed = written(corpus_pipeline.mix_sources(spark, docs, ""), "mixing")
    got = corpus_pipeline.tokenise(spark, mixed, "").collect()
    assert [r.doc_id for r in got] == expected
    assert all((a.slot, a.row) < (b.slot, b.row) for a, b in zip(got, got[1:]))


def test_pipeline_with_clashing_names(spark, tmp_path):
    """All five stages on rows with null and repeated ids and columns that the operators use themselves, and on no rows."""
    import corpus_pipeline
    from varscore.llm.common import written

    names = ["slot", "row", "block", "weight", "p_source", "p_block", "g", "c", "cell", "d_id", "d_hash", "sha", "key", "own", "group", "order"]
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["the", "quiet", "river", "runs", "slowly", "on", f"n{i}"]) for _ in range(60)), "en", "ab"[i % 3 == 0], 1) for i in range(150)]
    rows += [(None, rows[3][1], "en", "a", 1), (4, rows[5][1] + " end", "en", None, 1), (4, rows[4][1], "en", "b", 1), (None, "", None, None, None)]
    docs = spark.createDataFrame([(*r, *(str(900 - k) for _ in names)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    labels = [(i, int(i % 2 == 0), 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table, least in ((docs, 30), (docs.limit(0), 0)):
        step = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = written(stage(spark, step, str(tmp_path)), name)
            assert step.columns[: len(docs.columns)] == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path)).collect()
        assert len(out) == step.count() >= least
        assert [(r.slot, r.row) for r in out] == sorted((r.slot, r.row) for r in out)
        place = {tuple(r[-2:]): r.doc_id for r in step.collect()}
        assert all(place[r.slot, r.row] == r.doc_id for r in out)


def test_order_minhash(docs, texts, empty):
    got = {r.id: r for r in order_minhash.edit_report(docs).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[40].fingerprint
    assert order_minhash.edit_report(empty).count() == 0


def test_order_counts(spark):
    a, b = " ".join(map(str, range(200))), " ".join(map(str, [*range(100, 200), *range(100)]))
    df = spark.createDataFrame([(0, a), (1, b), (2, a + " 200")], "doc_id long, text string")
    codes = {r.id: r.codes for r in order_minhash.fingerprints(df).collect()}
    share = lambda x, y: len(set(x) & set(y)) / len(x)
    assert share(codes[0], codes[2]) > 0.9 and share(codes[0], codes[1]) < 0.75


@pytest.mark.parametrize("n", [20, 50, 100])
def test_order_counts_in_short_texts(spark, n):
    """Swapped halves share nearly all pairs of words, but only pairs within a half keep their order."""
    rows = []
    for t in range(40):
        words = [f"w{t}x{i}" for i in range(n)]
        rows += [(2 * t, " ".join(words)), (2 * t + 1, " ".join(words[n // 2 :] + words[: n // 2]))]
    df = spark.createDataFrame([*rows, (1000, "one two"), (1001, "one")], "doc_id long, text string")
    codes = {r.id: r.codes for r in order_minhash.fingerprints(df).collect()}
    assert all([c >> 16 for c in found] == list(range(order_minhash.SKETCHES)) for found in codes.values())
    share = sum(len({*codes[2 * t]} & {*codes[2 * t + 1]}) for t in range(40)) / 40 / order_minhash.SKETCHES
    half, kmers = n // 2 - 1, n - 1  # k-mers within a half; one more lies across, another one in the other text
    assert abs(share - half * (half - 1) / (kmers * (kmers - 1) / 2)) < 0.1


def test_quality(spark, empty):
    rnd = random.Random(3)
    good = [" ".join(rnd.choice(["the", "quiet", "river", "runs", "slowly"]) for _ in range(80)) for _ in range(120)]
    bad = [" ".join(rnd.choice(["BUY!!", "NOW!!", "$$$", "%%%", "CLICK!!"]) for _ in range(80)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate([*good, *bad, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 240, 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scores = [r.s for r in docs.select("doc_id", quality.score(model, F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert min(scores[:120]) > 0.7 > max(scores[120:240]) and scores[240] == scores[241]
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} >= set(range(120))
    assert quality.fit(docs, labels.where("false"))["prior"] == 0.5
