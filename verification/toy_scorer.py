"""A deterministic stand-in for a protein model: logits depend on position and amino acid only."""


def toy_scorer():
    import numpy as np

    # Places thirteen apart have the same numbers.
    logits = (np.arange(1, 14)[:, None] * np.arange(1, 21)[None, :]) % 13 / 4.0
    rows = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    return lambda sequences: [rows[np.arange(len(sequence)) % 13] for sequence in sequences]


def faulty_scorer():
    """The same numbers, but it fails on sequences with a doubled tryptophan."""
    score = toy_scorer()

    def checked(sequences):
        if any("WW" in sequence for sequence in sequences):
            raise ValueError("doubled tryptophan")
        return score(sequences)

    return checked


def thousandths(scores):
    """The sum of a protein's first log-probabilities, each rounded to thousandths."""
    from varscore.functions.numbers import rounded_array

    return int(rounded_array(scores[:, 0] * 1000, 0).astype("int64").sum())
