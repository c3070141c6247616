"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan over chunks.

Ordinary documents are encoded whole. A giant one is cut into chunks. At a cut the boundary state is the token that
covers the character before it. Each chunk yields a transfer matrix over the states of its two cuts, 0 where encoding
from the start of the left token to the end of the right one begins and ends with these very tokens, minus infinity
elsewhere. The matrices are combined by the (max, +) product, which is associative; the best path fixes one state per
cut, and every chunk is then traced back on its own.

The given vocabulary is a byte-pair one, so weights are 0 or minus infinity rather than piece scores: a sequence of its
tokens is the encoding of a text exactly if each two neighbours are the encoding of their own characters, and the only
path of weight 0 is the encoding. Cuts are moved to where a word begins if one is near: no piece crosses there, and the
state is single.

Nulls and empty texts have no tokens and decode to the empty text. Rows that repeat are encoded one by one.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscore.llm.common import col, fresh, narrow, written

#: Characters from which a document is giant, and of a chunk; the mark of a space.
GIANT, CHUNK, SPACE = 65_536, 16_384, "▁"


class Pieces:
    """The model, its pieces, and encoding of text as it stands, without the mark that the model puts in front.

    For that, a character of which no piece has any part is put before the text and its tokens are taken off again.
    """

    def __init__(self, path):
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.whole.get_piece_size()
        usable = [i for i in range(n) if not (self.whole.is_control(i) or self.whole.is_unknown(i) or self.whole.is_byte(i))]
        self.vocabulary = {self.whole.id_to_piece(i) for i in usable}
        self.longest = max(map(len, self.vocabulary))
        self.word_starts = not any(SPACE in p.lstrip(SPACE) for p in self.vocabulary)
        self.anchor = next(p for p in "aeiou" if p in self.vocabulary)
        letters = set("".join(self.vocabulary))
        self.wall = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in letters)
        self.walled = len(self.whole.encode(self.wall))

    def inner(self, text: str, kind=int) -> list:
        return self.whole.encode(self.wall + text, out_type=kind)[self.walled :]

    def spans(self, text: str) -> list:
        """(start, end) of the tokens of a text that is already escaped; the bytes of one character are one token."""
        out, at = [], 0
        for piece in self.inner(text, str):
            if piece.startswith("<0x") and piece not in self.vocabulary:
                lead = int(piece[3:5], 16)
                if lead & 0xC0 == 0x80:
                    continue
                out.append((at, at + 1))
            else:
                out.append((at, at + len(piece)))
            at = out[-1][1]
        return out

    def escaped(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def states(self, s: str, cut: int) -> list:
        """The tokens (start, end) that may cover the character before a cut."""
        if cut in (0, len(s)):
            return [(cut, cut)]
        if self.word_starts and s[cut] == SPACE and s[cut - 1] != SPACE:
            return [(cut, cut)]
        found = [(b, e) for b in range(max(0, cut - self.longest), cut) for e in range(cut, min(len(s), b + self.longest) + 1) if s[b:e] in self.vocabulary]
        return found if (cut - 1, cut) in found else [*found, (cut - 1, cut)]

    def cuts(self, s: str, chunk: int) -> list:
        """Cuts about every `chunk` characters, at the beginning of a word if there is one in the half chunk before."""
        out, chunk = [0], max(chunk, 4 * self.longest)  # so that no token covers two cuts
        while out[-1] + chunk + chunk // 2 < len(s):
            near = out[-1] + chunk
            word = max((m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", s[near - chunk // 2 : near + 1])), default=None)
            out.append(near if word is None else near - chunk // 2 + word)
        return [*out, len(s)]

    def transfer(self, s: str, lefts: list, rights: list) -> np.ndarray:
        """Max-plus weights between the states of two cuts: 0 where the tokens fit, else minus infinity."""
        out = np.full((len(lefts), len(rights)), -np.inf)
        for i, (a, b) in enumerate(lefts):
            for end in sorted({e for _, e in rights}):
                if end <= b and (end, end) not in rights:
                    continue
                spans = [(x + a, y + a) for x, y in self.spans(s[a:end])]
                fits = a == b or bool(spans) and spans[0] == (a, b)
                for j, (c, e) in enumerate(rights):
                    if e == end and fits and (c == e or bool(spans) and spans[-1] == (c, e)):
                        out[i, j] = 0
        return out


def packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def best_states(matrices: list) -> list:
    """One state per cut on a path of the greatest weight: a prefix scan of products, then a trace from the end."""
    prefixes = [matrices[0][:1]]
    for m in matrices[1:]:
        prefixes.append(product(prefixes[-1], m))
    states = [int(np.argmax(prefixes[-1][0]))]
    if prefixes[-1][0][states[0]] == -np.inf:
        raise ValueError("no path fits the model")
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(prefixes[k - 1][0] + matrices[k][:, states[-1]])))
    return [0, *states[::-1]]


def encode(docs: DataFrame, model: str, id_col="doc_id", text_col="text", giant=GIANT, chunk=CHUNK) -> DataFrame:
    """Rows (id, ids binary, decoded string), one per document; ids are little-endian unsigned 32-bit numbers."""
    rows = narrow(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, ids binary, decoded string"

    def whole(batches):
        pieces = Pieces(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 64):
                ids = pieces.whole.encode(texts[at : at + 64], num_threads=1)
                decoded = pieces.whole.decode(ids, num_threads=1) if ids else []
                part = [batch.column(0).slice(at, 64), pa.array([packed(x) for x in ids], pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(part, names=["id", "ids", "decoded"])

    ordinary = rows.where(F.length("text") < giant).mapInArrow(whole, out)
    giants = rows.where(F.length("text") >= giant).withColumn("key", F.sha2(F.concat_ws("|", F.col("id").cast("string"), "text").cast("binary"), 256))
    giants = written(giants, "giants")

    def cut(batches):
        pieces = Pieces(model)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = pieces.escaped(text)
                cuts = pieces.cuts(s, chunk)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    low, high = max(0, a - pieces.longest), min(len(s), b + pieces.longest)
                    shift = lambda states: [[x - low, y - low] for x, y in states]  # noqa: B023, E731
                    row = {"key": key, "chunk": k, "text": s[low:high], "lefts": shift(pieces.states(s, a)), "rights": shift(pieces.states(s, b))}
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("text", pa.string()), ("lefts", pa.list_(pa.list_(pa.int32()))), ("rights", pa.list_(pa.list_(pa.int32())))]))

    once = giants.dropDuplicates(["key"]).select("key", "text")
    chunks = once.mapInArrow(cut, "key string, chunk int, text string, lefts array<array<int>>, rights array<array<int>>")
    chunks = written(chunks.repartition("key", "chunk"), "chunks")

    def transfers(batches):
        pieces = Pieces(model)
        for batch in batches:
            for row in batch.to_pylist():
                m = pieces.transfer(row["text"], [tuple(x) for x in row["lefts"]], [tuple(x) for x in row["rights"]])
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]]), pa.array([row["chunk"]], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["key", "chunk", "width", "weights"])

    def scan(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        states = best_states([np.array(r["weights"]).reshape(-1, r["width"]) for r in rows])
        return pa.table({"key": pa.array([r["key"] for r in rows]), "chunk": pa.array([r["chunk"] for r in rows], pa.int32()), "left": pa.array(states[:-1], pa.int32()), "right": pa.array(states[1:], pa.int32())})

    matrices = chunks.mapInArrow(transfers, "key string, chunk int, width int, weights array<double>")
    chosen = written(matrices.groupBy("key").applyInArrow(scan, "key string, chunk int, left int, right int"), "states")

    def trace(batches):
        pieces = Pieces(model)
        lead = pieces.whole.piece_to_id(pieces.anchor)
        for batch in batches:
            for row in batch.to_pylist():
                (a, b), (_, e) = row["lefts"][row["left"]], row["rights"][row["right"]]
                ids = pieces.inner(row["text"][a:e])
                ids = ids[len(pieces.inner(row["text"][a:b])) :]
                decoded = pieces.whole.decode(ids) if row["chunk"] == 0 else pieces.whole.decode([lead, *ids])[1:]
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]]), pa.array([row["chunk"]], pa.int32()), pa.array([packed(ids)], pa.binary()), pa.array([decoded])], names=["key", "chunk", "ids", "decoded"])

    traced = chunks.join(chosen, ["key", "chunk"]).mapInArrow(trace, "key string, chunk int, ids binary, decoded string")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ids", "decoded")))
    joined = traced.groupBy("key").agg(ordered.alias("c"))
    joined = joined.select("key", F.aggregate("c", F.unhex(F.lit("")), lambda all_, c: F.concat(all_, c["ids"])).alias("ids"), F.array_join("c.decoded", "").alias("decoded"))
    return ordinary.unionByName(giants.select("id", "key").join(joined, "key").select("id", "ids", "decoded"))


def encoded(docs: DataFrame, model: str, id_col="doc_id", text_col="text", keep_ids=False, keep=(), **options) -> DataFrame:
    """Rows (id, n_tokens, ids_crc32, round_trip) and on demand ids: the number of ids, their checksum as little-endian
    unsigned 32-bit numbers, and whether decoding gives the text back. The columns `keep` of `docs` come along."""
    kept = fresh(docs, "own")
    others = [F.struct(*[col(c).alias(c) for c in keep]).alias("keep")] if keep else []
    own = F.struct(col(id_col).alias("id"), F.crc32(F.coalesce(col(text_col), F.lit("")).cast("binary")).alias("crc"), *others)
    found = encode(docs.withColumn(kept, own), model, kept, text_col, **options)
    same = F.crc32(F.col("decoded").cast("binary")) == F.col("id.crc")
    size = (F.octet_length("ids") / 4).cast("long")
    others = [F.col("id.keep").getField(c).alias(c) for c in keep]
    return found.select(F.col("id.id").alias("id"), size.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"), *["ids"] * keep_ids, *others)
