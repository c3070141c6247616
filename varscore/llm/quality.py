"""Quality scores by compression: texts are compressed with a dictionary built from good and one from bad labelled text.

The normalised difference of the two compressed sizes, taken over pieces of one KiB so that a long text does not become
its own dictionary, is turned into a probability by a logistic fit on labelled rows that built no dictionary.

The fit reads a bounded sample of labelled rows: `sample_docs` of each class with the smallest hash, and of each at
most `sample_bytes` from a place that the hash decides. Scores cover whole texts. Nulls and empty texts get the score
of a difference of zero. Labels that are null are left out; without rows of both classes every score is the share of
good ones (0.5 without any).
"""

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscore.llm.common import col, fresh

#: Bytes of a compressed piece, of a dictionary, and the zstandard level.
PIECE, DICTIONARY, LEVEL = 1024, 64 * 1024, 3
#: Bytes at which half the weight of the evidence counts: short texts say little.
SHORT = 128


def _sample(docs: DataFrame, known: DataFrame, n_docs: int, most: int) -> dict:
    """Up to `n_docs` texts (UTF-8) of each class in hash order, by class.

    The ids are chosen from the narrow label rows, thinned by their hash to about the number wanted, so the driver gets
    a bounded number of ids and texts, and only these few ids are broadcast to the documents.
    """
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for quality, n in counts.items():
        share = min(1.0, 1.5 * n_docs / n + 10 / n)
        hashed = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
        few = known.where((F.col("quality") == quality) & (hashed < int(share * (1 << 30))))
        chosen += [(r["id"], quality) for r in few.orderBy(hashed, "id").limit(n_docs).collect()]
    if not chosen:
        return {}
    kind = known.schema["id"].dataType.simpleString()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"id {kind}, quality int"))
    place = F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int")
    rows = docs.join(wanted, "id").select("id", "quality", F.substring(F.col("text"), place + 1, F.lit(most)).alias("text")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["text"])):
        out.setdefault(r["quality"], []).append(r["text"].encode())
    return out


def _dictionary(texts: list):
    """A trained dictionary; the texts themselves where they are too few to train one."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes(), False
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY:] or b" ", True


class Compressors:
    """Compressed sizes of a piece under the good and the bad dictionary."""

    def __init__(self, dictionaries):
        kinds = (zstandard.DICT_TYPE_FULLDICT, zstandard.DICT_TYPE_RAWCONTENT)
        made = [zstandard.ZstdCompressionDict(data, dict_type=kinds[raw]) for data, raw in dictionaries]
        self.good, self.bad = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in made
        ]

    def features(self, data: bytes) -> list:
        """Size difference in bytes per byte over the text, its least favourable piece, and the share of pieces nearer
        to the bad dictionary; all shrunk towards zero for short texts."""
        if not data:
            return [0.0, 0.0, 0.0]
        total, least, nearer = 0, 1.0, 0
        for i in range(0, len(data), PIECE):
            piece = data[i : i + PIECE]
            d = len(self.bad(piece)) - len(self.good(piece))
            total += d
            nearer += len(piece) * (d < 0)
            least = min(least, d / max(len(piece), SHORT))
        trust = len(data) / (len(data) + SHORT)
        return [trust * total / len(data), trust * least, trust * nearer / len(data)]


def _logistic(features: np.ndarray, good: np.ndarray) -> list:
    """Newton steps of a lightly penalised logistic regression on scaled features."""
    x = np.c_[np.ones(len(features)), features * [20, 20, 5]]
    w, penalty = np.zeros(4), np.diag([1e-6, 0.01, 0.01, 0.01])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(4), x.T @ (good - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample_docs=3000, sample_bytes=16384) -> dict:
    """The dictionaries and weights; `labels` holds only the rows that may be learnt from."""
    docs = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("quality")).where("quality in (0, 1)").distinct()
    sample = _sample(docs, known.join(docs.select("id"), "id", "left_semi"), sample_docs, sample_bytes)
    good, bad = sample.get(1, []), sample.get(0, [])
    if not good or not bad:
        return {"dictionaries": None, "prior": 0.5 if not good and not bad else float(bool(good))}
    halves = [(texts[0::2], texts[1::2] or texts) for texts in (good, bad)]
    dictionaries = [_dictionary(first) for first, _ in halves]
    compressors = Compressors(dictionaries)
    rest = [t for _, second in halves for t in second]
    truth = np.array([1.0] * len(halves[0][1]) + [0.0] * len(halves[1][1]))
    return {"dictionaries": dictionaries, "weights": _logistic(np.array([compressors.features(t) for t in rest]), truth)}


def score(model: dict, text: Column) -> Column:
    """The probability that the text is good."""
    if model["dictionaries"] is None:
        return F.lit(model["prior"]) + F.lit(0.0)
    dictionaries, weights, held = model["dictionaries"], model["weights"], []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Compressors(dictionaries))
        out = []
        for t in texts:
            a, b, c = held[0].features(t.encode() if t else b"")
            z = weights[0] + 20 * weights[1] * a + 20 * weights[2] * b + 5 * weights[3] * c
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return pd.Series(out, dtype="float64")

    return scored(text.cast("string"))


def keep_good(docs: DataFrame, model: dict, threshold=0.5, text_col="text") -> DataFrame:
    """`docs` without those that score below `threshold`; columns are unchanged."""
    name = fresh(docs, "score")
    return docs.withColumn(name, score(model, col(text_col))).where(F.col(name) >= threshold).drop(name)
