"""SentencePiece encoding and decoding by Unigram Viterbi over a double-array trie (operator 1)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import readable, sliced, table

SPACE = "▁"
#: What a character that no piece covers costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks that a Python worker remembers, in each of two generations; longer ones are not kept.
CHUNKS_KEPT, LONG_CHUNK = 120_000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their log scores, and the ids of the 256 byte pieces (none: no fallback).

    A piece with score -inf (control, unknown, byte) is never matched in a text.
    """

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    unknown_id: int


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a model file.

    A merge model scores pieces by minus their rank. As log scores they then
    follow a rank-frequency law: log(1 / (rank + 1)), up to a constant.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids]
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    raw = {i: model.get_score(i) for i in plain}
    ranked = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-raw[i], i)))}
    by_rank = all(s == int(s) for s in raw.values())
    scores = [(-math.log(ranked[i] + 1.0) - 1.0 if by_rank else raw[i]) if i in ranked else -math.inf for i in ids]
    byte_ids = [i for i in ids if model.is_byte(i)]
    return Vocabulary(pieces, scores, byte_ids if len(byte_ids) == 256 else [], model.unk_id())


@dataclass(frozen=True)
class DoubleArray:
    """A trie over bytes: from node s, byte c leads to t = base[s] + c + 1 if check[t] is s; value[t] is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: Iterable[tuple[bytes, int]]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys:
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = nxt
            values[node] = value
        size = 2 * len(children) + 1024
        base, check, value_of = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        hole, tail, todo = 1, 1, [(0, 0)]
        for node, at in todo:  # grows while it is read: breadth first
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:  # fills the holes that wider nodes leave
                while check[hole] >= 0 or hole <= codes[0]:
                    hole += 1
                start = hole - codes[0] - 1
            else:
                start = tail
                while any(check[start + c + 1] >= 0 for c in codes):
                    start += 1
                tail = max(tail, start - 256)
            if max(start, hole) + 1024 > len(check):
                more = len(check)
                base += [0] * more
                check += [-1] * more
                value_of += [-1] * more
            base[at] = start
            for c in codes:
                to = start + c + 1
                check[to] = at
                value_of[to] = values[children[node][c]]
                todo.append((children[node][c], to))
        top = max(i for i, c in enumerate(check) if c >= 0) + 258
        return DoubleArray(*(np.array((x + [f] * 258)[:top], np.int32) for x, f in ((base, 0), (check, -1), (value_of, -1))))


class Codec:
    """Encodes and decodes texts with a vocabulary and its trie."""

    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray):
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self.scores = vocabulary.scores
        finite = [s for s in self.scores if s > -math.inf]
        self.unknown_score = (min(finite) if finite else 0.0) - UNKNOWN_PENALTY
        self.byte_ids, self.unknown_id = vocabulary.byte_ids, vocabulary.unknown_id
        self.chunk = splitter(vocabulary.pieces)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes_of = [p.replace(SPACE, " ").encode("utf-8") for p in vocabulary.pieces]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        for i in {i for i, s in enumerate(self.scores) if s == -math.inf}.difference(self.byte_ids):
            self.bytes_of[i] = " ⁇ ".encode() if i == self.unknown_id else b""

    def viterbi(self, text: str) -> list[int]:
        """Ids of the segmentation with the highest sum of scores; of equals, at each end the longest last piece."""
        data = text.encode("utf-8", "surrogatepass")
        n, base, check, value, scores = len(data), self.base, self.check, self.value, self.scores
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0], at = 0.0, 0
        for ch in text:
            o = ord(ch)
            width = 1 if o < 128 else 2 if o < 2048 else 3 if o < 65536 else 4
            here, node, end, covered = best[at], 0, at, False
            while end < n:
                nxt = base[node] + data[end] + 1
                if check[nxt] != node:
                    break
                node, end = nxt, end + 1
                if (piece := value[node]) >= 0:
                    covered = covered or end == at + width
                    if here + scores[piece] > best[end]:
                        best[end], back[end] = here + scores[piece], (at, piece)
            if not covered and here + self.unknown_score > best[at + width]:
                best[at + width], back[at + width] = here + self.unknown_score, (at, -1)
            at += width
        out: list[int] = []
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(data[start:at])]
            else:
                out.append(self.unknown_id)
            at = start
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers. A space marker goes before the text; the empty text has no ids."""
        if not text:
            return b""
        chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE))
        young = self.young
        if unknown := [*set(chunks).difference(young)]:
            long = []
            for c in unknown:
                ids = self.old.get(c)
                young[c] = ids if ids is not None else np.array(self.viterbi(c), "<i4").tobytes()
                if len(c) > LONG_CHUNK:
                    long.append(c)
            out = b"".join(map(young.__getitem__, chunks))
            for c in long:
                del young[c]
            if len(young) > CHUNKS_KEPT:
                self.old, self.young = young, {}
            return out
        return b"".join(map(young.__getitem__, chunks))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: markers are spaces, the one before the text goes, runs of byte pieces are read as UTF-8."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def splitter(pieces: list[str]) -> re.Pattern[str]:
    """Pattern of the chunks that can be segmented one by one: no piece crosses their ends."""
    body = [p for p in pieces if not (p.startswith("<") and p.endswith(">"))]
    if any(SPACE in p.lstrip(SPACE) for p in body):
        return re.compile(r".+", re.S)
    if any("\n" in p for p in body):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    return re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


_CODECS: dict[str, Codec] = {}


def _codec(shared, key: str) -> Codec:
    """One codec for all tasks of a Python worker."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*shared.value)
    return _CODECS[key]


def tables(path: str | None = None) -> tuple[Vocabulary, DoubleArray]:
    v = load(path)
    return v, DoubleArray.build((p.encode("utf-8"), i) for i, p in enumerate(v.pieces) if v.scores[i] > -math.inf)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids and round_trip (decoding gives the text back) of every row of docs (doc_id, text).

    A null or empty text has no ids; bytes that are no UTF-8 are read as replacement characters. The marker character itself in a text is
    read as a space, which is the one way that a text isn't given back. Repeated
    rows each get a row, a null doc_id stays null, other columns are ignored, an
    empty table gives no rows. The tables broadcast are as large as the
    vocabulary, whatever the input.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(tables(model)), model or ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, key)
        for b in sliced(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [np.frombuffer(codec.encode(t), "<i4") for t in texts]
            same = [codec.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), column, pa.array(np.diff(ends).astype(np.int64)), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), readable("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""
    spark = encoded.sparkSession
    shared, key = spark.sparkContext.broadcast(tables(model)), model or ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, key)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else codec.decode(i) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
