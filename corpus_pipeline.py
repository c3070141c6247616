"""From raw documents to mixed, tokenised training data: five stages, each of them one operator."""

import public_tokenizers

from varscore.llm import exact_dedup, mixing, quality, sentencepieces, simhash
from varscore.llm.common import shuffle_partitions, written
from varscore.llm.queries import held_out


def keep_quality(spark, docs, sf_dir):
    """Drop the documents that the compression classifier takes for bad ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels.where(~held_out())), threshold=0.5)


def drop_exact(spark, docs, sf_dir):
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark, docs, sf_dir):
    """One document of each class linked by five-word shingles with a similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs, words=5, threshold=0.8)


def mix_sources(spark, docs, sf_dir):
    """All documents, interleaved by source at tempered weights; two more columns, the last, keep the order in the written
    table, whatever the names of the others."""
    return mixing.mix(docs, shuffle_partitions(docs), with_place=True)


def tokenise(spark, docs, sf_dir):
    """The ids of each document, checked by decoding, in the order of the mix (`slot`, `row`: its last two columns)."""
    place = docs.columns[-2:]
    found = sentencepieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True, keep=place)
    found = found.withColumnsRenamed({"id": "doc_id", place[0]: "slot", place[1]: "row"})
    found = written(found, "tokens")  # the range exchange reads its input twice
    return found.repartitionByRange(shuffle_partitions(docs), "slot", "row").sortWithinPartitions("slot", "row")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

#: No stage but the second can be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
