"""Distributed scoring of protein sequences by a scorer the caller supplies.

A scorer takes a list of sequences and returns, for each, a float array of shape (length, 20): log-probabilities
in the fixed amino-acid order, with the position masked. One pass per position yields all twenty numbers.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.functions.numbers import rounded_array
from varscore.runtime import spread, stored

SCORED = "protein_id string, pos int, ref_aa string, logits array<double>"
_SCORED = pa.schema([("protein_id", pa.string()), ("pos", pa.int32()), ("ref_aa", pa.string()), ("logits", pa.list_(pa.float64()))])
#: Positions of an Arrow batch of scores, at the least, except for the last of a task or, in tolerant passes, of a gathering.
ROWS = 16_384


def _letters(sequences: list) -> pa.Array:
    """The characters of all sequences, in one pass over their bytes where each is one byte."""
    text = "".join(sequences)
    if not text.isascii():
        return pa.array(list(text), pa.string())
    places = np.arange(len(text) + 1, dtype="int32")
    return pa.StringArray.from_buffers(len(text), pa.py_buffer(places), pa.py_buffer(text.encode()))


def _columns(proteins: list, sequences: list, values: list, digits: int | None = None) -> list:
    """The columns of `SCORED` for proteins with their scores, without a Python object per position."""
    sizes = np.array([len(s) for s in sequences], dtype="int64")
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.concatenate(values).astype("float64", copy=False).ravel() if values else np.zeros(0)
    if len(flat) != total * 20:
        raise ValueError(f"{len(flat)} scores for {total} residues")
    flat = flat if digits is None else rounded_array(flat, digits)
    return [
        pa.array(proteins, pa.string()).take(pa.array(owner)),
        pa.array((np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype("int32")),
        _letters(sequences),
        pa.ListArray.from_arrays(pa.array(np.arange(0, total * 20 + 1, 20, dtype="int32")), pa.array(flat)),
    ]


def score_sequences(
    proteins: DataFrame,
    scorer_factory: Callable[[], Callable],
    batch_size: int = 4,
    digits: int | None = None,
    columns: list | None = None,
) -> DataFrame:
    """`(protein_id, sequence)` -> one row per position with its twenty log-probabilities.

    The factory runs once per task, so a model is loaded once and then used for all batches of the partition. With `digits`
    the numbers are rounded as `functions.numbers.rounded` does; with `columns` they come under these twenty names and not as
    `logits`. Both happen on arrays in the task, as expressions on twenty elements of a row take longer than the rest.
    """
    schema, ddl = _SCORED, SCORED
    if columns:
        schema = pa.schema([*list(_SCORED)[:3], *[(name, pa.float64()) for name in columns]])
        ddl = SCORED.rsplit(",", 1)[0] + "".join(f", `{name}` double" for name in columns)

    def batch_of(held) -> pa.RecordBatch:
        *places, numbers = _columns(*held, digits)
        if columns:
            values = [pa.array(column) for column in np.ascontiguousarray(numbers.values.to_numpy().reshape(-1, len(columns)).T)]
            return pa.RecordBatch.from_arrays([*places, *values], schema=schema)
        return pa.RecordBatch.from_arrays([*places, numbers], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_factory()
        held, size = ([], [], []), 0
        for rows in batches:
            names, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for start in range(0, len(texts), batch_size):
                batch = texts[start : start + batch_size]
                for name, text, scores in zip(names[start : start + batch_size], batch, scorer(list(batch))):
                    for column, value in zip(held, (name, text, np.asarray(scores, dtype="float64"))):
                        column.append(value)
                    size += len(text)
                if size >= ROWS:
                    yield batch_of(held)
                    held, size = ([], [], []), 0
        if size:
            yield batch_of(held)

    wanted = proteins.select(F.col("protein_id").cast("string").alias("protein_id"), "sequence")
    return wanted.where(F.length("sequence") > 0).mapInArrow(run, ddl)


#: Residues of a model batch (sequences times the longest of them), batches gathered before they are sorted by length, and
#: positions that neighbouring windows of a long sequence share.
BATCH_RESIDUES, GATHERED, OVERLAP = 4096, 32, 64
TOLERANT = SCORED + ", error string"
_TOLERANT = pa.schema(
    [("protein_id", pa.string()), ("pos", pa.int32()), ("ref_aa", pa.string()), ("logits", pa.list_(pa.float64())), ("error", pa.string())]
)
SUMMARIES = "protein_id string, n long, summary long, error string"
_SUMMARIES = pa.schema([("protein_id", pa.string()), ("n", pa.int64()), ("summary", pa.int64()), ("error", pa.string())])


def windows(length: int, limit: int | None, overlap: int) -> list:
    """Windows `(start, end, first, last)` of a sequence: the model sees [start, end), [first, last) is taken from it.

    Neighbours share `overlap` positions and meet in the middle of them, so every position is taken once, from the window
    in which it lies farther from a cut.
    """
    if limit is None or length <= limit:
        return [(0, length, 0, length)]
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} does not fit windows of {limit}")
    starts = [*range(0, length - limit, limit - overlap), length - limit]
    cuts = [0, *[(a + limit + b) // 2 for a, b in zip(starts, starts[1:])], length]
    return [(s, s + limit, a, b) for s, a, b in zip(starts, cuts, cuts[1:])]


def budgeted(lengths: list, budget: int):
    """Batches of indices by descending length: the number of sequences times the longest is `budget` at most (or one)."""
    batch, longest = [], 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if batch and (len(batch) + 1) * longest > budget:
            yield batch
            batch = []
        longest = longest if batch else lengths[i]
        batch.append(i)
    if batch:
        yield batch


def tried(scorer: Callable, sequences: list) -> list:
    """For each sequence its scores, or the text of the error that it raises on its own.

    A batch that fails is halved until the faulty sequence stands alone, so one of n costs about 2 log n more calls.
    """
    try:
        found = [np.asarray(x, dtype="float64") for x in scorer(list(sequences))]
        if len(found) != len(sequences):
            raise ValueError(f"{len(found)} results for {len(sequences)} sequences")
        if len(sequences) > 1 or found[0].shape == (len(sequences[0]), 20):
            return [x if x.shape == (len(s), 20) else tried(scorer, [s])[0] for s, x in zip(sequences, found)]
        raise ValueError(f"scores of shape {found[0].shape} for {len(sequences[0])} residues")
    except Exception as error:  # a scorer is the caller's code and may raise anything
        if len(sequences) == 1:
            return [f"{type(error).__name__}: {error}"]
        half = len(sequences) // 2
        return tried(scorer, sequences[:half]) + tried(scorer, sequences[half:])


def _tolerant(proteins: DataFrame, scorer_factory: Callable, batch_residues: int, max_length: int | None, overlap: int, emit: Callable, ddl: str):
    """What `emit` makes of scored and rejected proteins `(protein_id, sequence, parts, error)`, whose scores are the parts one
    after the other. See `tolerant_rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_factory()

        def flush(held):
            pieces = [(k, w) for k, (_, sequence) in enumerate(held) for w in windows(len(sequence), max_length, overlap)]
            missing, errors, parts = [0] * len(held), {}, {}
            for k, _ in pieces:
                missing[k] += 1
            done, size = [], 0
            for batch in budgeted([w[1] - w[0] for _, w in pieces], batch_residues):
                texts = [held[pieces[i][0]][1][pieces[i][1][0] : pieces[i][1][1]] for i in batch]
                for i, result in zip(batch, tried(scorer, texts)):
                    k, (start, _, first, last) = pieces[i]
                    missing[k] -= 1
                    if isinstance(result, str):
                        errors.setdefault(k, result)
                    else:
                        parts.setdefault(k, []).append((first, result[first - start : last - start]))
                for k in sorted({pieces[i][0] for i in batch if not missing[pieces[i][0]]}):
                    found = [p for _, p in sorted(parts.pop(k, []), key=lambda p: p[0])]
                    done.append((*held[k], found, errors.get(k)))
                    size += len(held[k][1])
                if size >= ROWS:
                    yield emit(done)
                    done, size = [], 0
            if done:
                yield emit(done)

        held, size = [], 0
        for batch in batches:
            for protein, sequence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((protein, sequence))
                size += len(sequence)
                if size >= GATHERED * batch_residues:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    wanted = proteins.select(F.col("protein_id").cast("string").alias("protein_id"), "sequence").where(F.length("sequence") > 0)
    return wanted.mapInArrow(run, ddl)


def tolerant_rows(
    proteins: DataFrame,
    scorer_factory: Callable[[], Callable],
    batch_residues: int = BATCH_RESIDUES,
    max_length: int | None = None,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Scores and rejects of one lazy pass: the rows of `score_sequences` with a null `error`, and a row without position,
    letter and numbers for each rejected protein. For uses that go through all rows once; nothing is kept.

    Sequences are batched by length under a budget of residues. Those above `max_length`, the model's limit, are scored
    in overlapping windows that are stitched in the middle of their overlaps. A protein with a window that fails is rejected
    as a whole, with the error as its reason. Proteins without residues have neither scores nor a reason.
    """

    def rows(done):
        good = [(protein, sequence, found) for protein, sequence, found, error in done if error is None]
        bad = [(protein, error) for protein, _, _, error in done if error is not None]
        columns = _columns([p for p, _, _ in good], [s for _, s, _ in good], [v for _, _, found in good for v in found])
        rejected = [pa.array([p for p, _ in bad], pa.string()), pa.nulls(len(bad), pa.int32()), pa.nulls(len(bad), pa.string())]
        rejected += [pa.array([[]] * len(bad), pa.list_(pa.float64()))]
        arrays = [pa.concat_arrays(pair) for pair in zip(columns, rejected)]
        errors = pa.concat_arrays([pa.nulls(len(columns[0]), pa.string()), pa.array([error for _, error in bad], pa.string())])
        return pa.RecordBatch.from_arrays([*arrays, errors], schema=_TOLERANT)

    return _tolerant(proteins, scorer_factory, batch_residues, max_length, overlap, rows, TOLERANT)


def tolerant_summaries(
    proteins: DataFrame,
    scorer_factory: Callable[[], Callable],
    summary: Callable[[np.ndarray], int],
    batch_residues: int = BATCH_RESIDUES,
    max_length: int | None = None,
    overlap: int = OVERLAP,
) -> DataFrame:
    """As `tolerant_rows`, with one row per protein: its positions scored and the number that `summary` makes of their scores,
    an array of shape (length, 20); or the error.

    For uses that reduce the scores of a protein: twenty numbers for every position need not leave the task for that.
    """

    def rows(done):
        good = [None if error is not None else found[0] if len(found) == 1 else np.concatenate(found) for _, _, found, error in done]
        names, reasons = ([row[i] for row in done] for i in (0, 3))
        found = [[None if scores is None else value(scores) for scores in good] for value in (len, summary)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip([names, *found, reasons], _SUMMARIES.types)], schema=_SUMMARIES)

    return _tolerant(proteins, scorer_factory, batch_residues, max_length, overlap, rows, SUMMARIES)


def score_tolerant(
    proteins: DataFrame,
    scorer_factory: Callable[[], Callable],
    batch_residues: int = BATCH_RESIDUES,
    max_length: int | None = None,
    overlap: int = OVERLAP,
):
    """`(scores, rejects)`: as `score_sequences`, but a sequence on which the scorer fails does not end the job.

    Rejects are (protein_id, reason). Both results come from one pass of `tolerant_rows`, which is kept in the checkpoint folder
    as columns.
    """
    # Proteins are kept before they are spread, as counting their tasks would run all that makes them.
    kept = spread(stored(proteins.select("protein_id", "sequence"), "proteins"))
    found = stored(tolerant_rows(kept, scorer_factory, batch_residues, max_length, overlap), "scored")
    rejects = found.where("error IS NOT NULL").select("protein_id", F.col("error").alias("reason"))
    return found.where("error IS NULL").drop("error"), rejects
