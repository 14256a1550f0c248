"""Packing documents into sequences of a fixed length by linear grouping (operator 6)."""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, sliced, table

CAPACITY, END_ID = 4096, 1
#: Lengths above this share of the capacity are large.
LARGE_SHARE = 1 / 3
GROUPS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: Words of one encoding call; its tokens are taken out before the next.
WORDS_AT_ONCE, SLICE_MB = 20_000, 16
#: Plain letters, and ASCII marks other than the apostrophe: the tokenizer folds case in a run of letters, and parts it from a run of marks.
LETTERS, MARKS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}]", r"[!-&(-/:-@\[-`{-~]"
PLAIN = f"^(?P<head>{LETTERS}+)(?P<tail>{MARKS}*)$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Token ids of texts, word by word.

    The tokenizer drops white space and lets no token cross it, so the ids of a
    text are those of its words in turn. Of many texts at once each distinct word
    is encoded once, without case and marks where PLAIN fits; the ids of the
    texts are then gathered by place. Nothing is kept from one call to the next.
    """

    def __init__(self, tokenizer_json: str):
        assert sys.byteorder == "little"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, and where those of each begin and how many they are.

        A word of one run ends at its only token that ends a word, so that many
        such words take one call; the others are encoded one by one.
        """
        one_run = pc.match_substring_regex(words, f"^({LETTERS}+|{MARKS}+)$").to_numpy(zero_copy_only=False)
        order, runs = np.argsort(~one_run, kind="stable"), int(np.count_nonzero(one_run))
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words.take(pa.array(order[at : at + WORDS_AT_ONCE])).to_pylist()
            plain = max(0, min(len(some), runs - at)) if self.ends.any() else 0
            found = np.array(self.tokenizer.encode_batch_fast([some[:plain]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[found])
            if len(last) != plain:
                raise ValueError("the tokenizer doesn't end each word with one token that ends words")
            rest = [e.ids for e in self.tokenizer.encode_batch_fast(some[plain:], add_special_tokens=False)]
            ids += [found, np.array([i for e in rest for i in e], np.uint32)]
            lengths += [np.diff(last, prepend=-1), np.array([len(e) for e in rest], np.int64)]
        back, sizes = np.argsort(order), np.concatenate(lengths)
        return np.concatenate(ids), (np.cumsum(sizes) - sizes)[back], sizes[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and where each text ends; null is empty."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        known = words.dictionary
        plain = pc.extract_regex(known, PLAIN)
        fits = plain.is_valid()
        heads, tails = pc.if_else(fits, pc.utf8_lower(plain.field("head")), known), pc.if_else(fits, plain.field("tail"), "")
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        pool, starts, lengths = self._encode(parts.dictionary)
        both = parts.indices.to_numpy().reshape(2, -1).T.ravel()
        pool, lengths = _gather(pool, starts, lengths, both), lengths[both].reshape(-1, 2).sum(axis=1)
        pool, lengths = np.append(pool, np.uint32(END_ID)), np.append(lengths, 1)
        ends = split.offsets.to_numpy()[1:]
        order = np.insert(words.indices.to_numpy(), ends, len(known))
        return _gather(pool, np.cumsum(lengths) - lengths, lengths, order), np.cumsum(lengths[order])[ends + np.arange(len(ends))]


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of pool, one after the other in the given order."""
    sizes = lengths[order]
    return pool[np.repeat(starts[order] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most capacity ids of every document: its ids, the end id, cut only where longer.

    part and nth number the pieces of equal length within a task: they are for
    pack(), and hold once the result is written.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(model), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in sliced(batches, SLICE_MB):
            ids, ends = encoder.encode(b.column(1))
            rows: list[tuple] = []
            first = 0
            for doc_id, end in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                for k, at in enumerate(range(first, end, capacity)):
                    n = min(capacity, end - at)
                    rows.append((doc_id, k, at - first, n, zlib.crc32(ids[at : at + n]), part, int(seen[n])))
                    seen[n] += 1
                first = end
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")).mapInArrow(run, PIECES)


_ENCODERS: dict[int, WordTokens] = {}


def _encoder(model) -> WordTokens:
    """One encoder for all tasks of a Python worker."""
    text = model.value
    if (key := hash(text)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordTokens(text)
    return _ENCODERS[key]


@dataclass
class Bins:
    """Bins first .. first + count - 1, all filled alike up to used."""

    first: int
    count: int
    used: int


@dataclass
class Plan:
    """Where pieces go: rows (length, lowest rank, bins, first bin, offset)."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    placed: dict[int, int] = field(default_factory=dict)
    bins: int = 0

    def open(self, count: int) -> Bins:
        self.bins += count
        return Bins(self.bins - count, count, 0)

    def put(self, where: Bins, length: int) -> None:
        """One more piece of this length in each of these bins."""
        rank = self.placed.get(length, 0)
        self.rows.append((length, rank, where.count, where.first, where.used))
        self.placed[length] = rank + where.count
        where.used += length


def groups_of(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Large lengths, longest first, in groups of equal cardinality: (longest length, runs of [length, count])."""
    total = sum(counts.values())
    each, out, room = -(-total // groups) if total else 1, [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = each
            n = min(left, room)
            out[-1][1].append([length, n])
            left, room = left - n, room - n
    merged: dict[int, list[list[int]]] = {}
    for length, runs in out:  # groups that round to the same length are one size
        merged.setdefault(length, []).extend(runs)
    return list(merged.items())


def fullest(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """Index -> copies of the configuration that holds the longest size left and fills the bin best; longer sizes first."""
    start = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[start]
    mask, reach = (1 << (room + 1)) - 1, [1]
    for i in range(start, len(sizes)):
        have, sums = left[i] - (i == start), reach[-1]
        for _ in range(min(have, room // sizes[i])):
            grown = sums | (sums << sizes[i]) & mask
            if grown == sums:
                break
            sums = grown
        reach.append(sums)
    total, used = reach[-1].bit_length() - 1, {start: 1}
    for i in range(len(sizes) - 1, start - 1, -1):
        while not reach[i - start] >> total & 1:
            total -= sizes[i]
            used[i] = used.get(i, 0) + 1
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Places for all pieces, from how many there are of each length.

    Large lengths are rounded up within groups of equal cardinality; the few
    sizes that are left are combined into configurations, each as full as can be
    and used as often as its sizes last; the pieces themselves then take the
    places of their groups, and small pieces go, longest first, where the least
    room is left. All steps work on counts, so the plan's cost depends on the
    capacity and not on the number of documents.
    """
    out, limit = Plan(capacity), int(capacity * LARGE_SHARE)
    sized = groups_of({n: c for n, c in counts.items() if n > limit}, groups)
    sizes, runs = [s for s, _ in sized], [[list(r) for r in rs] for _, rs in sized]
    left = [sum(n for _, n in r) for r in runs]
    open_bins: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    while any(left):
        used = fullest(sizes, left, capacity)
        times = min(left[i] // k for i, k in used.items())
        bins = out.open(times)
        slots = []
        for i, k in used.items():
            left[i] -= k * times
            slots += [_take(runs[i], times) for _ in range(k)]
        cuts = sorted({0, times, *(c for s in slots for c in s[0])})
        at = [0] * len(slots)
        for lo, hi in pairwise(cuts):
            some = Bins(bins.first + lo, hi - lo, 0)
            for k, (ends, lengths) in enumerate(slots):
                while ends[at[k]] <= lo:
                    at[k] += 1
                out.put(some, lengths[at[k]])
            open_bins[capacity - some.used].append(some)
    for length in sorted((n for n in counts if n <= limit), reverse=True):
        _best_fit(out, open_bins, length, counts[length])
    return out


def _take(runs: list[list[int]], n: int) -> tuple[list[int], list[int]]:
    """The next n pieces of a group: where each run of equal lengths ends, and its length."""
    ends, lengths, done = [], [], 0
    while done < n:
        k = min(runs[0][1], n - done)
        done += k
        ends.append(done)
        lengths.append(runs[0][0])
        runs[0][1] -= k
        if not runs[0][1]:
            runs.pop(0)
    return ends, lengths


def _best_fit(out: Plan, open_bins: list[list[Bins]], length: int, count: int) -> None:
    room = length
    while count:
        while room <= out.capacity and not open_bins[room]:
            room += 1
        if room > out.capacity:
            each = out.capacity // length
            open_bins[out.capacity].append(out.open(-(-count // each)))
            room = out.capacity
        bins, each = open_bins[room].pop(), room // length
        whole = min(bins.count, count // each)
        if whole:
            full = Bins(bins.first, whole, bins.used)
            for _ in range(each):
                out.put(full, length)
            open_bins[out.capacity - full.used].append(full)
            count -= whole * each
        if whole < bins.count:
            rest = Bins(bins.first + whole, bins.count - whole, bins.used)
            if count and count < each:
                one = Bins(rest.first, 1, rest.used)
                rest.first, rest.count = rest.first + 1, rest.count - 1
                for _ in range(count):
                    out.put(one, length)
                open_bins[out.capacity - one.used].append(one)
                count = 0
            if rest.count:
                open_bins[out.capacity - rest.used].append(rest)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces (as tokenized_pieces makes them, written) with sequence_id and offset.

    The driver sees one count for each length, at most capacity of them, and
    sends back the plan, whose size depends on the capacity alone. A piece's rank
    among those of its length is its number within its task plus the pieces that
    earlier tasks have; only those counts are put in order. There are as many
    counts as tasks times lengths, so they are joined by merging, not broadcast.
    """
    spark = pieces.sparkSession
    per_task = materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = plan(counts, capacity, groups)
    rows = np.array(sorted(planned.rows), np.int64).reshape(-1, 5)
    starts = spark.sparkContext.broadcast((rows[:, 0] << 48 | rows[:, 1], rows))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(per_task.select("length", "part", before.alias("before")).hint("merge"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = starts.value
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = places[np.searchsorted(keys, n << 48 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Every document of docs (doc_id, text) in as few sequences of capacity ids as it can, a row for each piece.

    A null, empty or blank text is a document of its end id alone. Longer
    documents than a sequence are cut; no other is. Rows that repeat a doc_id, or
    whole rows, are documents of their own; a null doc_id stays null. An empty
    table gives no rows; columns other than doc_id and text are ignored.
    """
    return pack(materialise(tokenized_pieces(docs, tokenizer_path, capacity), "packing-pieces"), capacity, groups)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
