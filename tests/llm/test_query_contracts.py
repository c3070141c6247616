"""The registered queries on the given tables: their columns, and plain computations of what they report."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varscore.llm import queries, simhash

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # enough held-out labels and near copies for shares to mean something
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

COLUMNS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_order_minhash": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op11_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_one_row_per_document(spark, docs, name):
    found = queries.QUERIES[name](spark, SF)
    kinds = dict(found.dtypes)
    loose = lambda kind: re.sub("^(tiny|small|big)?int$", "int", kind)
    for column in COLUMNS[name].split(", "):
        column, kind = column.split(" ")
        assert loose(kinds[column]) == loose(kind), column
        assert kind not in ("bigint", "int") or kinds[column] == kind, column
    if "doc_id" in kinds:
        assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_shards_report_sizes_and_checksums(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = queries.op5_sharding(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_order_minhash_report(spark, docs):
    """Edited texts from the next document, and likeness as the share of equal sketches of two fingerprints."""
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    rows = sorted(queries.op10_order_minhash(spark, SF).collect(), key=lambda r: r.doc_id)

    def near(a, b):
        a, b = (set(map(int, x.split())) for x in (a, b))
        either = {c >> 16 for c in a} | {c >> 16 for c in b}
        return len(a & b) / len(either) if either else 1.0

    same = defaultdict(set)
    for i, r in enumerate(rows):
        after, quarter = (i + 1) % len(rows), len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - quarter] + texts[after][:quarter]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(near(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(near(r.fingerprint, rows[after].fingerprint))
        same[texts[i]].add(r.fingerprint)
    assert all(len(prints) == 1 for prints in same.values())


def test_quality_on_labels_that_were_held_out(spark):
    rows = queries.op2_quality(spark, LARGER).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    seen = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [np.array([s for s, y in seen if y == k]) for k in (1, 0)]
    auc = np.mean(good[:, None] > bad) + np.mean(good[:, None] == bad) / 2
    scores, truth = map(np.array, zip(*seen))
    worst = max(abs(scores[part].mean() - truth[part].mean()) for part in np.array_split(np.argsort(scores), 4))
    print(f"held out {len(seen)}, auc {auc:.3f}, worst quarter off by {worst:.3f}")
    assert auc > 0.8 and worst < 0.2


def test_recall_of_near_duplicates(spark):
    """All documents, and of each with enough words a copy with words replaced at random places, down to a similarity of about
    0.8. Pairs of different texts with a similarity of 0.8 or more come from an inverted index over all shingles."""
    rnd = random.Random(12)
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()]
    for i, text in texts[:]:
        words = text.split()
        for at in rnd.sample(range(len(words)), rnd.randint(0, int(0.0225 * len(words)))):
            words[at] = f"new{rnd.randrange(10**9)}"
        texts.append((i + 10**9, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    rows = [(i, t.encode().lower().split()) for i, t in texts]
    sets = {i: frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for i, w in rows}
    found = {r.id: r.component_id for r in simhash.similar_classes(docs).collect()}
    classes = defaultdict(list)
    for i, s in sets.items():
        classes[s].append(i)
    assert all(len({found[i] for i in same}) == 1 for same in classes.values())
    index, shared = defaultdict(list), defaultdict(int)
    for c, s in enumerate(classes):
        for x in s:
            for d in index[x]:
                shared[d, c] += 1
            index[x].append(c)
    distinct = list(classes)
    linked = {}
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(distinct[a]) + len(distinct[b]) - n):
            linked[a, b] = n / (len(distinct[a]) + len(distinct[b]) - n)
    met = {pair for pair in linked if found[classes[distinct[pair[0]]][0]] == found[classes[distinct[pair[1]]][0]]}
    hard = {pair for pair, likeness in linked.items() if likeness < 0.85}
    print(f"{len(met)} of {len(linked)} linked pairs, {len(met & hard)} of {len(hard)} below 0.85")
    assert len(linked) > 500 and len(hard) > 100  # the fixture is large enough
    assert len(met) >= 0.9 * len(linked) and len(met & hard) >= 0.9 * len(hard)
