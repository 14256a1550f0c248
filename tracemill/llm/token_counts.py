"""Token counts of whole texts; those of huge texts from overlapping chunks, spliced where both sides provably agree (operator 12)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, sliced, table

#: Bytes of a chunk without its overlap, and of the first overlap; a failed alignment takes an overlap WIDEN times as wide.
CHUNK, OVERLAP, WIDEN = 1 << 14, 1 << 8, 8
#: Texts of up to so many chunks are encoded in one go.
WHOLE_CHUNKS = 2
LIMIT = 1024
#: A space behind a character that is none; what no part of a text that is cut there can tell from the next one. Python's white space holds all that the tokenizer's pattern has.
PART = re.compile(r" (?<=\S )")
#: Parts whose counts a worker keeps.
MOST_KNOWN = 1 << 18
#: Bytes that are encoded in one call of the library, beyond a single text.
BATCH_MB = 4
MARKS = "array<struct<at:long,before:long>>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def lookahead(tokenizer_json: str) -> int | None:
    """Bytes after a boundary between pre-tokens that decide it, None if the tokenizer has no such bound.

    Byte-level pre-tokens without prefix space or normaliser are matched from
    left to right, one beginning where the last ended, by a pattern that looks
    one character ahead and never back. Added tokens that take no neighbouring
    white space are found before, by their own strings. So what follows a
    boundary depends on the text after it alone, and a boundary on no more text
    than the longest added token and a character.
    """
    spec = json.loads(tokenizer_json)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added):
        return None
    return max((len(t["content"].encode("utf-8")) for t in added), default=0) + 8


class Counter:
    """Counts of texts, and marks of chunks: the places of boundaries between pre-tokens with the tokens before them."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.fast = Tokenizer.from_str(tokenizer_json)
        self.fast.no_truncation()
        self.fast.no_padding()
        self.exact = Tokenizer.from_str(json.dumps(json.loads(tokenizer_json) | {"post_processor": None, "truncation": None, "padding": None}))
        self.guard = lookahead(tokenizer_json)
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text.

        No pre-token and no added token has white space behind another character,
        so that a text can be cut before each space that follows one: each part
        is encoded once for all texts that hold it.
        """
        if self.guard is None:
            return [len(e) for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [PART.split(t) for t in texts]
        new = list({w for p in parts for w in p[1:]} - self.known.keys())
        if len(self.known) + len(new) > MOST_KNOWN:
            self.known, new = {}, list({w for p in parts for w in p[1:]})
        found = [len(e) for e in self.fast.encode_batch_fast([*(p[0] for p in parts), *(" " + w for w in new)], add_special_tokens=False)]
        self.known.update(zip(new, found[len(parts) :], strict=True))
        return [first + sum(map(self.known.__getitem__, p[1:])) for first, p in zip(found, parts, strict=False)]

    def marks(self, data: bytes, start: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of data, which begins at byte start of its text and may begin and end within a character: places in the text, tokens before each, tokens in all."""
        lead = next((i for i, x in enumerate(data[:3]) if x & 0xC0 != 0x80), min(len(data), 3))
        text = data[lead:].decode("utf-8", "ignore")
        encoding = self.exact.encode(text, add_special_tokens=False)
        if not len(encoding):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        words = np.array(encoding.word_ids, np.int64)
        first = np.flatnonzero(np.diff(words, prepend=-1))
        offsets = encoding.offsets  # a list made anew at each access
        chars = np.array([offsets[i][0] for i in first.tolist()], np.int64)
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        return np.flatnonzero(raw & 0xC0 != 0x80)[chars] + start + lead, first, len(words)


_COUNTERS: dict[int, Counter] = {}


def _counter(model) -> Counter:
    """One counter for all tasks of a Python worker."""
    text = model.value
    if (key := hash(text)) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(text)
    return _COUNTERS[key]


def _valid(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.make_valid_utf8(text), F.lit("")).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long"))


def whole_counts(rows: DataFrame, model) -> DataFrame:
    """doc_id, n_bytes and n_tokens of rows (doc_id, n_bytes, text), each text encoded in one go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for b in sliced(batches, BATCH_MB):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counter.counts(b.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def chunk_marks(texts: DataFrame, model, chunk: int, overlap: int) -> DataFrame:
    """(key, no) of every chunk of texts (key, text), with head and tail: the marks in the overlap with the chunk before and after; n: its tokens.

    Chunks are cut as bytes and dealt anew, so that the chunks of one text are
    encoded by many tasks. The tail leaves out marks so near the chunk's end that
    more text could move them.
    """
    data = F.col("text").cast("binary")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int")), lambda i: F.struct(i.cast("long").alias("no"), F.substring(data, i * chunk + 1, F.lit(chunk + overlap)).alias("data"), (i == F.floor((F.octet_length("text") - 1) / chunk)).alias("last")))
    rows = texts.select("key", F.explode(cut).alias("c")).select("key", "c.no", "c.data", "c.last").hint("rebalance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for b in sliced(batches):
            heads, tails, totals = [], [], []
            for no, data, last in zip(b.column("no").to_pylist(), b.column("data"), b.column("last").to_pylist(), strict=True):
                data, start = data.as_py(), no * chunk
                at, before, n = counter.marks(data, start)
                pick = lambda keep: [{"at": a, "before": k} for a, k in zip(at[keep].tolist(), before[keep].tolist(), strict=True)]
                heads.append(pick(at < start + overlap) if no else [])
                tails.append([] if last else pick((at >= start + chunk) & (at <= start + len(data) - counter.guard)))
                totals.append(n)
            marks = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("no"), b.column("last"), pa.array(heads, marks), pa.array(tails, marks), pa.array(totals, pa.int64())], ["key", "no", "last", "head", "tail", "n"])

    return rows.mapInArrow(run, f"key string, no long, last boolean, head {MARKS}, tail {MARKS}, n long")


def splice(marked: DataFrame) -> DataFrame:
    """(key, n_tokens, failed) from the marks of all chunks; failed if two neighbours have no boundary in common.

    The first chunk begins where its text does, so that its marks are those of
    the whole text. What follows a boundary depends on the text after it alone:
    a mark that a proven chunk shares with the next one proves all later marks
    of the next one, and so on to the last.
    """
    once = marked.groupBy("key", "no").agg(F.any_value(F.struct("last", "head", "tail", "n")).alias("c")).select("key", "no", "c.*")  # equal texts have equal chunks
    span = Window.partitionBy("key").orderBy("no")
    places = lambda c: F.transform(c, lambda m: m["at"])
    before = lambda marks, at: F.get(F.filter(marks, lambda m: m["at"] == at), F.lit(0))["before"]
    seams = once.withColumn("seam", F.array_max(F.array_intersect(places(F.col("tail")), places(F.lead("head").over(span))))).withColumn("from", F.lag("seam").over(span))
    upto, since = F.when(F.col("last"), F.col("n")).otherwise(before(F.col("tail"), F.col("seam"))), F.when(F.col("no") == 0, F.lit(0)).otherwise(before(F.col("head"), F.col("from")))
    return seams.groupBy("key").agg(F.sum(upto - since).alias("n_tokens"), F.bool_or(~F.col("last") & F.col("seam").isNull()).alias("failed"))


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every row of docs (doc_id, text).

    A null text counts as empty, invalid UTF-8 as replacement characters (in
    n_bytes too). Texts of more than WHOLE_CHUNKS chunks are cut, whatever their
    length: memory is bounded by chunk and overlap. Where chunks don't align, all
    of the text is cut anew with an overlap WIDEN times as wide, in chunks of at
    least four overlaps: a run without any boundary ends in one piece, as it does
    in the library. Equal huge texts may be encoded more than once and are counted
    once. Tokenizers without a bound (see lookahead) encode all texts whole.
    Repeated rows and null ids each get a row, other columns are ignored, an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    model, rows = spark.sparkContext.broadcast(spec), _valid(docs)
    most = WHOLE_CHUNKS * chunk if lookahead(spec) is not None else None
    if most is None:
        counted = whole_counts(rows, model)
    else:
        huge = rows.where(F.col("n_bytes") > most).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
        counted = whole_counts(rows.where(F.col("n_bytes") <= most), model).unionByName(huge.select("doc_id", "n_bytes", "key").join(_huge_counts(huge, model, chunk, overlap), "key").drop("key"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _huge_counts(huge: DataFrame, model, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of every text of huge, in as many rounds as the least alignable needs."""
    done, left = None, huge.select("key", "text")
    while True:
        found = materialise(splice(chunk_marks(left, model, chunk, overlap)), "token-counts")
        good = found.where("not failed").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = found.where("failed").select("key")
        if failed.isEmpty():
            return done
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)
        left = huge.select("key", "text").join(failed, "key", "left_semi")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
