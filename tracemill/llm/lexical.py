"""Ranked lexical search of a stated set of queries: MaxScore over blocks of documents, tightened by bounds of term pairs (operator 13)."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import discard, materialise, sliced, table

#: Best documents of each item.
TOP = 50
#: Documents of a block: its index is in one task's memory while all items search it.
BLOCK_DOCS = 4096
#: Bytes of item texts that one pass over the documents searches for; more items take more passes.
QUERY_BYTES = 4 << 20
#: Bytes of one text that are cut into terms at once.
STRETCH = 4 << 20
#: A term is a run of these bytes, of which A to Z are lower-cased: digits, ASCII letters, and all bytes of other characters.
_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in _KEPT else 0x20 for b in range(256))
VECTOR = "doc_id long, n long, terms array<int>, tfs array<long>"


def terms(text: bytes) -> Counter[bytes]:
    """Terms of a text with how often they occur; a long text is cut between terms."""
    if len(text) <= STRETCH:
        return Counter(text.translate(FOLD).split())
    out: Counter[bytes] = Counter()
    at = 0
    while at < len(text):
        piece = text[at : at + STRETCH].translate(FOLD)
        end = at + len(piece)
        if end < len(text) and (space := piece.rfind(b" ")) >= 0:
            piece, end = piece[:space], at + space + 1
        elif end < len(text):  # a term that is longer than a stretch
            rest = text[end:].translate(FOLD)
            stop = rest.find(b" ")
            piece, end = piece + (rest if stop < 0 else rest[:stop]), len(text) if stop < 0 else end + stop + 1
        out.update(piece.split())
        at = end
    return out


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def norm(n: int, docs: int, total: int) -> int:
    """m of a document with n terms; Python's whole numbers, so that n times the documents can't overflow."""
    return 50 + (50 * n * docs) // total


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), and the terms of the vocabulary in each document, by number, with how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in sliced(batches):
            sizes, ids, tfs, ends = [], [], [], [0]
            for text in b.column(1):
                found = terms(text.as_py() or b"")
                sizes.append(found.total())
                hits = [(i, k) for t, k in found.items() if (i := number.get(t)) is not None]
                ids += [i for i, _ in hits]
                tfs += [k for _, k in hits]
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, VECTOR)


class Block:
    """The index of a block: of each term its documents and impacts, and their maximum; of term pairs the documents that hold both, and the joint maximum.

    docs are places in the block. Pairs are those that queries are split into.
    """

    def __init__(self, ids: np.ndarray, places: np.ndarray, impacts: np.ndarray, size: int):
        self.size, self._pairs = size, {}
        order = np.lexsort((places, ids))
        ids, self._docs, self._impacts = ids[order], places[order], impacts[order]
        cuts = np.flatnonzero(np.diff(ids, prepend=-1))
        self._spans = {int(ids[a]): (int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)}
        self.most = {t: int(self._impacts[a:b].max()) for t, (a, b) in self._spans.items()}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self._spans.get(term, (0, 0))
        return self._docs[a:b], self._impacts[a:b]

    def index_pairs(self, pairs: set[tuple[int, int]]) -> None:
        """Intersection lists of the pairs that both occur, made before any query is run."""
        for a, b in pairs:
            if a in self.most and b in self.most:
                da, ia = self.postings(a)
                db, ib = self.postings(b)
                both, x, y = np.intersect1d(da, db, assume_unique=True, return_indices=True)
                self._pairs[a, b] = (both, int((ia[x] + ib[y]).max()) if len(both) else 0)

    def unit(self, pair: tuple[int, ...]) -> tuple[int, int, np.ndarray | None]:
        """Of a pair or a single term: the most that a document can get, the most without the other term, the documents with both."""
        alone = max((self.most.get(t, 0) for t in pair), default=0)
        if pair not in self._pairs:
            return alone, alone, None
        both, joint = self._pairs[pair]
        return max(alone, joint), alone, both


def paired(query: list[int], weights: list[int]) -> list[tuple[int, ...]]:
    """The terms of a query in pairs, by weight: terms of like weight are bounded together; an odd one is left single."""
    order = sorted(query, key=lambda t: (weights[t], t))
    return [tuple(sorted(order[i : i + 2])) for i in range(0, len(order), 2)]


def search(block: Block, units: list[tuple[int, ...]], floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the block's documents that score floor or more and above 0, and the number of documents scored.

    Units are put in order of their bounds. A document that has terms of the
    first ones only, as many as their bounds add up to less than floor, can't
    reach it: these units make no candidates. Of the next unit, a document with
    one of its two terms may still fall short: then only its intersection list
    makes candidates. Candidates are completed by the largest units first, and
    left as soon as what is missing can't lift them to floor.
    """
    bounds = sorted(((*block.unit(u), u) for u in units), key=lambda x: (x[0], x[3]))
    bounds = [x for x in bounds if x[0]]
    sums = [0]
    for most, _, _, _ in bounds:
        sums.append(sums[-1] + most)
    first = next((i for i in range(len(bounds)) if sums[i + 1] >= floor), len(bounds))
    acc, found = np.zeros(block.size, np.int64), np.zeros(block.size, bool)
    if first == len(bounds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    _, alone, both, pair = bounds[first]
    narrow = both is not None and sums[first] + alone < floor
    for i in range(first, len(bounds)):
        for t in bounds[i][3]:
            docs, impacts = block.postings(t)
            acc[docs] += impacts
            if not (narrow and i == first):
                found[docs] = True
    if narrow:
        found[both] = True
    places = np.flatnonzero(found)
    tried, scores = len(places), acc[places]
    for i in range(first - 1, -1, -1):
        keep = scores + sums[i + 1] >= floor
        places, scores = places[keep], scores[keep]
        for t in bounds[i][3]:
            docs, impacts = block.postings(t)
            if len(docs) and len(places):
                at = np.minimum(np.searchsorted(docs, places), len(docs) - 1)
                scores = scores + np.where(docs[at] == places, impacts[at], 0)
    keep = (scores >= floor) & (scores > 0)
    return places[keep], scores[keep], tried


class Best:
    """The top documents of an item so far: score, then the lower id, null ids last, then the earlier row."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    @property
    def floor(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def add(self, ids: list[int | None], scores: list[int]) -> None:
        for i, s in zip(ids, scores, strict=True):
            row = (s, i is not None, -(i or 0))
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, row)
            elif row > self.heap[0]:
                heapq.heapreplace(self.heap, row)

    def rows(self) -> list[tuple[int, int | None]]:
        return [(s, -i if known else None) for s, known, i in self.heap]


def scored(found: DataFrame, queries: dict[int, list[int]], weights: list[int], docs: int, total: int, top: int, block_docs: int) -> DataFrame:
    """(query, doc_id, score): of each task its top documents for each query."""
    shared = found.sparkSession.sparkContext.broadcast(({q: paired(t, weights) for q, t in queries.items()}, weights))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Block]]:
        units, weights = shared.value
        pairs = {u for us in units.values() for u in us if len(u) == 2}
        w = np.array(weights, np.int64)
        for b in sliced(batches, rows=block_docs):
            m = np.array([norm(n, docs, total) for n in b.column("n").to_pylist()], np.int64)
            sizes = np.diff(b.column("terms").offsets.to_numpy())
            ids, tfs = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            places = np.repeat(np.arange(b.num_rows), sizes)
            block = Block(ids, places, w[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[places])), b.num_rows)
            block.index_pairs(pairs)
            yield b.column("doc_id").to_pylist(), block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = defaultdict(lambda: Best(top))
        for names, block in blocks(batches):
            for q, units in shared.value[0].items():
                places, scores, _ = search(block, units, best[q].floor)
                if len(places) > 4 * top:  # most of a first block falls out at once
                    edge = np.partition(scores, -top)[-top]
                    places, scores = places[scores >= edge], scores[scores >= edge]
                best[q].add([names[p] for p in places.tolist()], scores.tolist())
        out = [(q, i, s) for q, x in best.items() for s, i in x.rows()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["query", "doc_id", "score"])

    return found.mapInArrow(run, "query long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of docs (doc_id, text) for each row of items (item_id, text).

    Ties go to the lower doc_id, null ids come last, rows that repeat an id rank
    each for themselves. Null and empty texts have no terms: such documents
    count nowhere, such items find nothing. Texts are read as bytes, so that
    invalid UTF-8 is part of a term. Rows that repeat an item are answered each.
    Items are searched in sets of query_bytes of text (one item at least), which
    bounds what is sent to the tasks; each set reads the documents once. Other
    columns are ignored, an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    numbered = materialise(asked.withColumns({"query": F.monotonically_increasing_id(), "size": F.octet_length("text").cast("long")}), "lexical-items")
    parts = numbered.groupBy(F.shiftright("query", 33).alias("part")).agg(F.sum("size").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition of the items
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("query"))
    sets = materialise(numbered.withColumn("part", F.shiftright("query", 33)).join(parts.select("part", before.alias("before")), "part").select("item_id", "query", "text", F.floor((F.col("before") + inside) / query_bytes).cast("long").alias("set")), "lexical-sets")
    out = None
    for number in sorted(r["set"] for r in sets.select("set").distinct().collect()):
        one = _ranked_set(docs, sets.where(F.col("set") == number), top, block_docs)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sets.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _ranked_set(docs: DataFrame, items: DataFrame, top: int, block_docs: int) -> DataFrame:
    words = {r["query"]: list(terms(bytes(r["text"]))) for r in items.select("query", "text").collect()}  # a set is bounded
    vocabulary = sorted({t for ts in words.values() for t in ts})
    number = {t: i for i, t in enumerate(vocabulary)}
    found = materialise(vectors(docs, vocabulary).where("n > 0"), "lexical-vectors")
    count, total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = [weight(count, df.get(i, 0)) for i in range(len(vocabulary))]
    result = materialise(scored(found.where(F.size("terms") > 0), {q: [number[t] for t in ts] for q, ts in words.items()}, weights, count, total or 1, top, block_docs), "lexical-found")
    discard(found)
    return result


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH words AS (SELECT rid, doc_id, unnest(regexp_extract_all({_FOLDED}, '{_TERMS}')) AS t FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
tf AS (SELECT rid, doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY rid),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
asked AS (SELECT DISTINCT item_id, qid, unnest(regexp_extract_all({_FOLDED}, '{_TERMS}')) AS t FROM (SELECT *, row_number() OVER () AS qid FROM benchmark)),
parts AS (SELECT item_id, qid, rid, doc_id, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))) AS part
  FROM asked JOIN tf USING (t) JOIN df USING (t) JOIN size USING (rid), whole),
sums AS (SELECT item_id, qid, rid, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts GROUP BY ALL),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM sums WHERE score > 0)
SELECT * FROM placed WHERE rank <= {TOP}
"""
