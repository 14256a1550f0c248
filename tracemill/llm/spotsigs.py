"""Document fingerprints by spot signatures (operator 10)."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, readable, sliced, table, text_hash

#: Common words of four languages; chains start at them.
ANCHORS = frozenset(
    "a an and are as at be by for from has in is it not of on or that the this to was were which with"
    " au aux avec ce dans de des du en est et il la le les par pas pour que qui sur un une"
    " als auf aus das dem den der des die ein eine für im ist mit nicht sich sie und von zu"
    " al como con del el en es las lo los no para por que se su una y".split()
)
CHAIN = 2
TOKEN = re.compile(r"\w+")
#: Bytes of text that a range of neighbouring documents holds, as long as there are no more ranges than that; a task streams its range.
RANGE_BYTES, MOST_RANGES = 16 << 20, 4000
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, n_edited_signatures long"


def signatures(text: str, anchors: Collection[str] = ANCHORS, chain: int = CHAIN) -> frozenset[int]:
    """Hashes of an anchor and the chain of content words that follow it, anchors skipped.

    A chain that the text's end cuts short counts as far as it goes, if it has a
    word. A text without any is its words in turn, as one signature; a text
    without words is itself, so that no two different texts without spots are
    alike; the empty text has no signature.
    """
    words = TOKEN.findall(text.lower())
    content: list[str] = []
    starts: list[tuple[str, int]] = []
    add, start = content.append, starts.append
    for w in words:
        if w in anchors:
            start((w, len(content)))
        else:
            add(w)
    digest, n = xxhash.xxh3_64_intdigest, len(content)
    if found := frozenset(digest(" ".join((a, *content[i : i + chain]))) for a, i in starts if i < n):
        return found
    return frozenset([digest(" ".join(words) if words else "\0" + text)]) if text else frozenset()


def fingerprint(found: Collection[int]) -> str:
    """One value for a set of signatures, 32 hex digits."""
    return hashlib.blake2b(np.sort(np.fromiter(found, np.uint64, len(found))).astype("<u8").tobytes(), digest_size=16).hexdigest()


def length_partition(size: int, threshold: float) -> int:
    """Sets in partitions that aren't neighbours differ too much in size to be as alike as threshold."""
    return 0 if size < 1 else 1 + int(math.log(size) / -math.log(threshold))


def likeness(a: frozenset[int], b: frozenset[int], threshold: float = 0.0) -> float:
    """Jaccard of two sets of signatures; 0 as soon as it can't reach threshold. Two empty sets are alike."""
    if not a and not b:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < threshold * len(large):
        return 0.0
    if 0 < threshold < 1 and abs(length_partition(len(a), threshold) - length_partition(len(b), threshold)) > 1:
        return 0.0
    common = len(small & large)
    score = common / (len(a) + len(b) - common)
    return score if score >= threshold else 0.0


def fingerprints(docs: DataFrame, anchors: Collection[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """doc_id, fingerprint and the signatures (array of long) of every row; null counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [signatures(t or "", anchors, chain) for t in b.column(1).to_pylist()]
            values = [np.sort(np.fromiter(s, np.uint64, len(s)).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(fingerprint, sets), pa.string()), pa.array(values, pa.list_(pa.int64()))], ["doc_id", "fingerprint", "signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), readable("text").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, signatures array<long>")


def _compared(doc_id: int | None, text: str, mine: frozenset[int], after: str, theirs: frozenset[int], anchors: Collection[str], chain: int) -> tuple:
    """A row of RESULT: a document against its edited text and the next document."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = signatures(edited, anchors, chain)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), fingerprint(mine), fingerprint(changed), likeness(mine, changed), likeness(mine, theirs), len(mine), len(changed)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def edited_fingerprints(docs: DataFrame, anchors: Collection[str] = ANCHORS, chain: int = CHAIN, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprint of every document, and of its text with the last half replaced; the columns of RESULT.

    The last floor(n/2) of a text's n code points give way to the first as many
    of the next document (all, if it has fewer). The next document is that of the
    next lower doc_id; the last is followed by the first. A null text is empty.
    Rows of one doc_id follow each other by text hash, and a null doc_id ranks
    lowest. A table of one row is its own next document; an empty one gives no
    rows. Other columns are ignored.

    Documents are dealt once, into ranges of doc_id and text hash, so that rows
    of one id are split too; only rows that repeat both stay together. A task
    streams its range in order and hands its first and last document to a second
    step, which compares each range's last with the next one's first: two
    documents for a range, of which there are at most MOST_RANGES.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), F.coalesce(readable("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, math.ceil(total / range_bytes)))
    order = [F.desc("key"), F.asc("th")]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    schema = f"{RESULT}, range_no int, edge string, text string"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, blank = TaskContext.get().partitionId(), None, (None,) * 8
        for b in sliced(batches):
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = signatures(text, anchors, chain)
                if last:
                    out.append((*_compared(*last, text, found, anchors, chain), here, None, None))
                else:
                    out.append((doc_id, *blank, here, "first", text))
                last = (doc_id, text, found)
            yield _table(out, schema)
        if last:
            yield _table([(last[0], *blank, here, "last", last[1])], schema)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield _table([_compared(i, t, signatures(t, anchors, chain), a, signatures(a, anchors, chain), anchors, chain) for i, t, a in rows], RESULT)

    found = materialise(dealt.mapInArrow(stream, schema), "spots-ranges")
    firsts, lasts = (found.where(F.col("edge") == e) for e in ("first", "last"))
    filled = sorted(r[0] for r in firsts.select("range_no").collect())
    after = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1])), "range_no int, next_no int")
    met = lasts.join(after, "range_no").join(firsts.select(F.col("range_no").alias("next_no"), F.col("text").alias("after")), "next_no")
    names = [c.split()[0] for c in RESULT.split(", ")]
    return found.where("edge is null").select(*names).unionByName(met.select("doc_id", "text", "after").mapInArrow(across, RESULT))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
