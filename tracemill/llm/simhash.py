"""Near-duplicate groups by 64-bit SimHash (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, readable, sliced, table, text_hash
from tracemill.llm.components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Fingerprints of a posting list that are compared pair by pair; longer lists go the other, linear way.
LIST_LIMIT = 48
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    digest, ahead = xxhash.xxh64_intdigest, [words[i:] for i in range(shingle)]
    shingles = map(b" ".join, zip(*ahead)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for lo in range(0, last, 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > last))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and th (hash of the text), a row for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), readable("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


#: The six pairs of the four blocks of two bytes, and the byte positions of each as a mask.
SLOTS = [(i, j, 3 << 2 * i | 3 << 2 * j) for i, j in combinations(range(4), 2)]


def postings(fps: DataFrame) -> DataFrame:
    """The inverted index over byte positions: (positions, bytes, fp).

    An entry holds the four bytes at the positions of one of SLOTS. A list of one
    positional byte would hold every 256th fingerprint, and its pairs grow with
    the square of the input.
    """
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    entries = [F.struct(F.lit(mask).alias("positions"), F.shiftleft(blocks[i], 16).bitwiseOR(blocks[j]).alias("bytes")) for i, j, mask in SLOTS]
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.positions", "e.bytes", "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) that join every two of the distinct fingerprints within max_bits (at most 2) bits.

    A bit that differs takes one block of two bytes out of what two fingerprints
    share, so that 8 - 2 * max_bits positional bytes are shared at least, in
    whole blocks. Posting lists of up to list_limit fingerprints give the pairs
    that they hold; the positions of a pair's common entries are tallied, pairs
    that reach the guaranteed number are kept, and their bits are counted.

    Longer lists give no pairs, whatever the input's size: each fingerprint of
    such a list is entered under itself and its 64 one-bit neighbours. Two
    fingerprints meet under a common value exactly if they differ in two bits or
    fewer, no value has over 65 fingerprints, and a link to the least of them
    keeps what they reach. Both ways are exact, and a link is found by either.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits is 1 or 2")
    index = materialise(postings(fps), "simhash-postings")
    sizes = materialise(index.groupBy("positions", "bytes").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "simhash-sizes")
    sized = index.join(sizes, ["positions", "bytes"])
    short = materialise(sized.where(F.col("size") <= list_limit).select("positions", "bytes", "fp"), "simhash-short")
    left, right = short.withColumnRenamed("fp", "a"), short.withColumnRenamed("fp", "b")
    common = left.join(right, ["positions", "bytes"]).where("a < b").groupBy("a", "b").agg(F.bit_or("positions").alias("shared"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = common.where(F.bit_count("shared") >= 8 - 2 * max_bits).where(near).select("a", "b")
    crowded = sized.where(F.col("size") > list_limit).select("fp").distinct()
    around = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("near"))
    if max_bits == 2:
        stars = around.groupBy("near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a != b")
    else:
        stars = around.join(crowded.select(F.col("fp").alias("b")), F.col("near") == F.col("b")).select(F.col("fp").alias("a"), "b").where("a < b")
    return pairs.unionAll(stars)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, th, fp, root and component_id of every row of docs (columns doc_id and text).

    root, a fingerprint, names the group; component_id is the least doc_id that a row reaches over links of at most
    max_bits differing bits. Fingerprints are made distinct first, so copies never
    form pairs. Null, empty and blank texts have fingerprint 0, linked like any
    other. Rows that repeat a doc_id each get a row; a null doc_id counts as
    larger than any other and is a component_id only where all are null. An empty
    table gives no rows; other columns are ignored.
    """
    rows = materialise(fingerprints(docs), "simhash-rows")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = materialise(components(links(classes.select("fp"), max_bits), "simhash-components"), "simhash-roots")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(classes["fp"], "first", F.coalesce("root", classes["fp"]).alias("root"))
    rooted = materialise(rooted, "simhash-rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
