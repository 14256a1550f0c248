"""Removal of lines or paragraphs that an earlier document already has (operator 2)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, readable, sliced, table, text_hash

SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
#: In production shorter lines stay: they come again by chance, or as set phrases, in documents that share nothing else.
LINE_WORDS = 25
SPACE = " \t\n\v\f\r"
TEXT_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Runs of so many words are found wherever they lie; each has an anchor of so many words.
PASSAGE_WORDS, ANCHOR_WORDS = 50, 16
BLOCK_WORDS, KNOWN_WORDS = 50_000, 200_000
UNIT = "rank long, th long, nth int, start long, end long, digest binary"


def split_units(text: str, separator: str) -> Iterator[tuple[int, int, int, str]]:
    """(nth, start, end, content) of every unit that has a word; the places leave out white space around the words."""
    at = 0
    for nth, unit in enumerate(text.split(separator)):
        if body := unit.strip(SPACE):
            start = at + unit.index(body[0]) if unit[0] in SPACE else at
            yield nth, start, start + len(body), body
        at += len(unit) + len(separator)


def _words(text: str) -> list[bytes]:
    """The words of a text, in lower case; they end at ASCII white space."""
    return text.lower().encode("utf-8", "surrogatepass").split()


def units(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """The columns of UNIT for every unit of min_words words or more.

    start and end are code points of the original text, nth is the unit's number.
    A unit is normalised to lower case, one space between words and none around;
    digest has 128 bits. rank is doc_id, or the largest long where that is null.
    """
    separator = SEPARATORS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in UNIT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for b in sliced(batches):
            out: list[tuple] = []
            for rank, th, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for nth, start, end, content in split_units(text or "", separator):
                    words = _words(content)
                    if len(words) >= min_words:
                        out.append((rank, th, nth, start, end, hashlib.blake2b(b" ".join(words), digest_size=16).digest()))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return _rows(docs).mapInArrow(run, UNIT)


def _rank() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_rank(), text_hash().alias("th"), F.col("text").cast("string").alias("text"))


def later(found: DataFrame, place: Column, label: str, keep: Column | None = None) -> DataFrame:
    """Rows of found whose digest an earlier place has, but for those that keep holds for (it may name first).

    The earliest place is an aggregate, made before the shuffle; the join has one
    row for a digest on one side, so that a very common one's rows can be split.
    """
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return found.join(materialise(first, label), "digest").where((place != F.col("first")) if keep is None else ~keep)


def repeats(found: DataFrame) -> DataFrame:
    """(rank, th, gone): the places of the units to remove, for documents that have any; the earliest by rank, text hash and place stays."""
    rows = later(found, F.struct("rank", "th", "nth"), "dedup-first")
    return rows.groupBy("rank", "th").agg(F.collect_set(F.struct("start", "end")).alias("gone"))


class _Hashes(dict):
    """64 bits for each word, of a bounded number of words remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def anchors(text: str, least: int, known: _Hashes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By block of words: its first word's number, the words' hashes, and place and hash of the anchor of each run of least words.

    A run's anchor is the group of ANCHOR_WORDS words in it with the least hash,
    so that equal runs have equal anchors, whatever surrounds them.
    """
    words = _words(text)
    runs, span = len(words) - least + 1, min(ANCHOR_WORDS, least)
    for lo in range(0, runs, BLOCK_WORDS):
        part = words[lo : min(runs, lo + BLOCK_WORDS) + least - 1]
        hashes = np.fromiter(map(known.__getitem__, part), np.uint64, len(part))
        groups = np.zeros(len(part) - span + 1, np.uint64)
        for i in range(span):
            groups = groups * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(groups) + i]
        groups = (groups ^ (groups >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        at = np.lib.stride_tricks.sliding_window_view(groups, least - span + 1).argmin(axis=1) + np.arange(len(part) - least + 1)
        yield lo, hashes, at, groups[at].view(np.int64)


def passages(docs: DataFrame, least: int = PASSAGE_WORDS) -> DataFrame:
    """(rank, th, runs): numbers of the words at which a run of least words begins that an earlier place has.

    Places are in order of rank, text hash and word; a run that overlaps the first
    of its kind in the same text stays. Words are normalised as in units. Anchors
    that come once are left out first, so that only runs around repeated anchors
    are hashed (128 bits) and shuffled. Of documents with one text only the
    earliest is searched; the runs of the others are null, which stands for all.
    """
    keys = [("rank", pa.int64()), ("th", pa.int64())]

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = _Hashes(), pa.schema([*keys, ("anchor", pa.int64())])
        for b in sliced(batches):
            found, sizes = [np.zeros(0, np.int64)], []
            for text in b.column(2).to_pylist():
                each = [f[np.flatnonzero(np.diff(at, prepend=-1))] for _, _, at, f in anchors(text or "", least, known)]
                found += each
                sizes.append(sum(map(len, each)))
            rank, th = (np.repeat(b.column(i).to_numpy(), sizes) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(th), pa.array(np.concatenate(found))], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema, digest = _Hashes(), pa.schema([*keys, ("word", pa.int32()), ("digest", pa.binary())]), xxhash.xxh3_128_digest
        for b in sliced(batches, 4):
            words, digests, sizes = [np.zeros(0, np.int64)], [], []
            for text, again in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                before = len(digests)
                for lo, hashes, _, found in anchors(text, least, known):
                    data, at = memoryview(hashes.tobytes()), np.flatnonzero(np.isin(found, again.values.to_numpy()))
                    digests += [digest(data[8 * x : 8 * (x + least)]) for x in at.tolist()]
                    words.append(at + lo)
                sizes.append(len(digests) - before)
            rank, th = (np.repeat(b.column(i).to_numpy(), sizes) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(th), pa.array(np.concatenate(words), pa.int32()), pa.array(digests, pa.binary())], schema=schema)

    rows, key = _rows(docs), ["rank", "th"]
    whole = rows.select(*key, F.md5(F.col("text").cast("binary")).alias("digest")).where("digest is not null")
    copies = materialise(later(whole, F.struct(*key), "dedup-texts").select(*key).distinct(), "dedup-copies")
    all_anchors = materialise(rows.mapInArrow(anchored, "rank long, th long, anchor long"), "dedup-anchors")
    more = all_anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    again = all_anchors.join(materialise(more, "dedup-repeated"), "anchor").groupBy(*key).agg(F.collect_set("anchor").alias("again"))
    again = materialise(again.join(copies, key, "left_anti"), "dedup-again")
    near = rows.join(again, key).select(*key, "text", "again")
    found = materialise(near.mapInArrow(hashed, "rank long, th long, word int, digest binary"), "dedup-runs")
    overlaps = (F.col("first.rank") == F.col("rank")) & (F.col("first.th") == F.col("th")) & (F.col("word") - F.col("first.word") < least)
    gone = later(found, F.struct("rank", "th", "word"), "dedup-first-runs", keep=overlaps)
    return gone.groupBy(*key).agg(F.collect_set("word").alias("runs")).unionByName(copies.withColumn("runs", F.lit(None).cast("array<int>")))


def cut(text: str, places: list[tuple[int, int]], runs: list[int] | None, least: int) -> tuple[str, list[dict]]:
    """text without the places and the runs of least words that begin at the words numbered in runs (null: at every word), and what was cut, merged.

    Of the white space around a cut the side with more line ends stays, neither at the text's ends.
    """
    words = [(m.start(), m.end()) for m in TEXT_WORD.finditer(text)] if runs is None or runs else []
    spans: list[list[int]] = []
    runs = range(len(words) - least + 1) if runs is None else runs
    for lo, hi in sorted([*places, *((words[r][0], words[r + least - 1][1]) for r in runs)]):
        if spans and (lo <= spans[-1][1] or not text[spans[-1][1] : lo].strip(SPACE)):
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    out, at = "", 0
    for lo, hi in [*spans, [len(text), len(text)]]:
        piece = text[at:lo]
        if at:
            body, left = piece.lstrip(SPACE), out.rstrip(SPACE)
            gaps = (out[len(left) :], piece[: len(piece) - len(body)])
            out, piece = left, (max(gaps, key=lambda g: g.count("\n")) if left and body else "") + body
        out, at = out + piece, hi
    return out, [{"start": lo, "end": hi} for lo, hi in spans]


def dedup(docs: DataFrame, unit: str = "line", min_words: int = 1, passage_words: int | None = None) -> DataFrame:
    """docs with text cut, and removed: the cut places [start, end) in the original text, in order.

    Of equal units (lines or paragraphs) of min_words words or more over all
    documents, and within one, that of the least doc_id (then text hash, then
    place) stays. Places that only white space parts are one. All rows and
    columns stay; a text of which all is cut is empty, a null text null, with
    nothing removed; bytes that are no UTF-8 come back as replacement characters.
    Rows that repeat both doc_id and text are one document and
    are cut alike. A null doc_id ranks last. An empty table gives no rows. A
    column of docs named removed is replaced; any other name may be there.

    With passage_words, every run of so many words that an earlier place of the
    original texts has goes as well, wherever lines end.
    """
    docs = docs.withColumn("text", readable("text"))
    rows = docs.drop("removed").select(F.struct("*").alias("row"), _rank(), text_hash().alias("th"))
    inner = docs.select("doc_id", "text")
    gone = materialise(repeats(materialise(units(inner, unit, min_words), "dedup-units")), "dedup-gone")
    joined = rows.join(gone, ["rank", "th"], "left").withColumns({"hit": F.lit(False), "runs": F.lit(None).cast("array<int>")})
    if passage_words:
        more = materialise(passages(inner, passage_words).withColumn("hit", F.lit(True)), "dedup-passages")
        joined = joined.drop("hit", "runs").join(more, ["rank", "th"], "left")

    @F.pandas_udf("struct<text: string, removed: array<struct<start: bigint, end: bigint>>>")
    def trimmed(text: pd.Series, gone: pd.Series, hit: pd.Series, runs: pd.Series) -> pd.DataFrame:
        places = ([(x["start"], x["end"]) for x in g] if g is not None else [] for g in gone)
        starts = (None if h and r is None else [] if r is None else r.tolist() for h, r in zip(hit == True, runs))  # noqa: E712
        both = [(t, []) if t is None else cut(t, p, r, passage_words or 1) for t, p, r in zip(text, places, starts)]
        return pd.DataFrame({"text": [t for t, _ in both], "removed": [p for _, p in both]}, dtype=object)

    done = joined.select("row", trimmed(F.col("row.text").cast("string"), "gone", "hit", "runs").alias("cut"))
    return done.select(F.col("row").withField("text", F.col("cut.text")).alias("row"), F.col("cut.removed").alias("removed")).select("row.*", "removed")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=LINE_WORDS, passage_words=PASSAGE_WORDS)
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


SQL = rf"""
WITH split AS (
  SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS parts FROM documents)
), placed AS (
  SELECT *, part NOT SIMILAR TO '[\x20\x09-\x0D]+' AS word, sum(length(part)) OVER o - length(part) AS start, sum(len(string_split(part, chr(10))) - 1) OVER o AS line, lag(part) OVER o AS before, lead(part) OVER o AS after
  FROM split WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), words AS (
  SELECT doc_id, lower(part) AS norm, part, start, start + length(part) AS stop, line, coalesce(before, '') AS before, coalesce(after, '') AS after, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM placed WHERE word
), lines AS (
  SELECT doc_id, line, count(*) AS size, string_agg(norm, ' ' ORDER BY n) AS norm FROM words GROUP BY 1, 2
), gone_lines AS (
  SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line) AS nth FROM lines WHERE size >= {LINE_WORDS}) WHERE nth > 1
), texts AS (
  SELECT doc_id, list(norm ORDER BY n) AS ws FROM words GROUP BY 1
), runs AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + {PASSAGE_WORDS}], ' ')) AS digest FROM (SELECT doc_id, ws, unnest(range(len(ws) - {PASSAGE_WORDS - 1})) AS i FROM texts WHERE len(ws) >= {PASSAGE_WORDS})
), firsts AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(i) OVER w AS first_i FROM runs WINDOW w AS (PARTITION BY digest ORDER BY doc_id, i)
), gone_runs AS (
  SELECT doc_id, i AS n FROM firsts WHERE doc_id <> first_doc OR i - first_i >= {PASSAGE_WORDS}
), marked AS (
  SELECT w.*, g.doc_id IS NOT NULL OR coalesce(max(r.n) OVER (PARTITION BY w.doc_id ORDER BY w.n ROWS BETWEEN {PASSAGE_WORDS - 1} PRECEDING AND CURRENT ROW), -1) >= 0 AS gone, max(w.n) OVER (PARTITION BY w.doc_id) AS last
  FROM words w LEFT JOIN gone_lines g USING (doc_id, line) LEFT JOIN gone_runs r ON w.doc_id = r.doc_id AND w.n = r.n
), islands AS (
  SELECT doc_id, min(start) AS lo, max(stop) AS hi FROM (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM marked WHERE gone) GROUP BY doc_id, island
), removed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(CAST(lo AS BIGINT) || '-' || CAST(hi AS BIGINT), ',' ORDER BY lo) AS removed FROM islands GROUP BY 1
), kept AS (
  SELECT *, lag(n) OVER o AS before_n, lag(after) OVER o AS left_gap, lead(n) OVER o IS NULL AS final FROM marked WHERE NOT gone WINDOW o AS (PARTITION BY doc_id ORDER BY n)
), joined AS (
  SELECT doc_id, string_agg(CASE WHEN n = coalesce(before_n, -1) + 1 THEN before WHEN before_n IS NULL THEN '' WHEN len(string_split(before, chr(10))) > len(string_split(left_gap, chr(10))) THEN before ELSE left_gap END || part || CASE WHEN final AND n = last THEN after ELSE '' END, '' ORDER BY n) AS left_over FROM kept GROUP BY 1
)
SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN d.text ELSE coalesce(j.left_over, '') END AS text, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.removed, '') AS removed
FROM documents d LEFT JOIN removed r USING (doc_id) LEFT JOIN joined j USING (doc_id)
"""
