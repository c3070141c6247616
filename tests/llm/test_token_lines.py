"""Ids from words split at spaces and line ends are those of the library for the whole text."""

import random

import numpy as np
import public_tokenizers

from varscore.llm import token_counts, token_files


def test_words_at_line_ends():
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    parts = ["a", "B c", "\n", "\n", "x,\ny", " ", "\t", "é\n", "1\n2", "'s", "\n\n", "\x00", "\r\n", ".", "\x85", "ab cd\nef"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(3000)] + ["one\ntwo " * 400, "x" * 700 + "\ny"]
    library = Tokenizer.from_file(path)
    for _ in range(2):  # the second time from the cache
        got = token_files.encoder_of(path).encode_all([t.encode() for t in texts])
        for text, ids in zip(texts, got):
            assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_counts_over_a_batch_of_texts():
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    parts = ["a", "Word ", "wörd", " ", "\n", "12", "ab12cd", ",", "x" * 300, "<s>", "[UNK]", "　"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(500)] + [""]
    library = Tokenizer.from_file(path)
    got = token_counts.counter_of(path).counts([t.encode() for t in texts])
    assert got == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.counter_of(path).counts([]) == []
