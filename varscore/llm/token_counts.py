"""Token counts: batch encoding inside Arrow functions that returns lengths only.

Texts are split at safe boundaries: ASCII white space, which the tokenizer drops before it looks at words, so the counts
of the parts add up to the count of the text. Long parts without white space are split between ASCII letters and digits,
where the tokenizer's pattern always splits. Parts seen before are counted from a bounded cache; new ones are encoded in
batches of about equal bytes. No text is truncated, however long. Null and empty texts have no tokens.
"""

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from varscore.llm.common import WordCache, pieces_by_bytes, values_of

#: Bytes of an encoded batch, and of the texts whose parts are looked up together; parts longer than LONG are split further
#: and not kept in the cache.
BATCH_BYTES, GROUP_BYTES, LONG = 65_536, 4 << 20, 256
_WITHIN = re.compile(rb"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")


class Counter:
    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.cache = WordCache(self.lengths)

    def lengths(self, parts: list) -> list:
        out = []
        for a, b in pieces_by_bytes([len(p) for p in parts], BATCH_BYTES):
            out += [len(e) for e in self.encode([p.decode() for p in parts[a:b]], add_special_tokens=False)]
        return out

    def counts(self, texts: list) -> list:
        """Tokens of each text. The parts of about GROUP_BYTES of texts are told apart by Arrow, and each different one that
        is not in the cache is encoded once, in batches of BATCH_BYTES over all of these texts."""
        out = []
        for a, b in pieces_by_bytes([len(t) for t in texts], GROUP_BYTES):
            parts = [t.split() for t in texts[a:b]]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            coded = pa.array([p for own in parts for p in own], pa.large_binary()).dictionary_encode()
            different = values_of(coded.dictionary)
            long = [i for i, p in enumerate(different) if len(p) > LONG]
            values = np.array(self.cache.values([p if len(p) <= LONG else b"" for p in different]), np.int64)
            cut = [_WITHIN.split(different[i]) for i in long]
            found = np.add.reduceat(self.lengths([q for c in cut for q in c]), np.cumsum([0, *map(len, cut[:-1])])) if long else []
            values[long] = found
            total = np.append(0, np.cumsum(values[coded.indices.to_numpy()]))
            ends = np.cumsum(sizes)
            out += (total[ends] - total[ends - sizes]).tolist()
        return out


_COUNTERS: dict = {}


def counter_of(path: str) -> Counter:
    """The counter of a tokenizer file, made once in a worker process; only the last path is kept."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text under the tokenizer file, which must drop white space before its words (word_bpe_49k.json
    does) and split letters from digits; no special tokens are added."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(counter_of(path).counts([t.encode() if t else b"" for t in texts]), dtype="int64")

    return counted(text.cast("string"))
