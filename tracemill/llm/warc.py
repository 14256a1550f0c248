"""Web archives: writing captures, reading them back, and one ordered index over all (operator 9)."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import fresh_path, materialise, table

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
#: An archive is read by one task: most records in it, and about how many bytes before compression.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 2000, 128 << 20
#: Index entries that one task merges.
RANGE_ENTRIES = 20_000
#: Captures have no time of their own; they get a second of the year that begins here, by a hash of their page_id.
EPOCH, YEAR_S = 1_704_067_200, 31_622_400
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "run string, seq long, url_key string, captured_at string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long"


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit("page"), page_id.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))), F.substring(h, 21, 12), F.lit(">"))


def captures(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """pages with payload (html or the empty string), payload_bytes, payload_digest, first (page_id of the response, null for one).

    Of equal payloads of least_revisit bytes or more the least page_id is stored,
    null last. The first of each digest is aggregated before the shuffle, and the
    join has one row for it, so that many copies of one page can be split.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    first = rows.where(F.col("payload_bytes") >= least_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    first = materialise(first.where("n > 1 and least is not null").select("payload_digest", "least"), "warc-first")
    joined = rows.join(first, "payload_digest", "left")
    stored = F.col("least").isNull() | F.col("least").eqNullSafe(F.col("page_id")) | (F.col("payload_bytes") < least_revisit)
    return joined.withColumn("first", F.when(~stored, F.col("least"))).drop("least")


def records(found: DataFrame) -> DataFrame:
    """One WARC/1.1 record as text for each capture, without the two line ends that close it."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.concat(head, F.col("payload")))
    fields: list[tuple[str, Column]] = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        ("WARC-Date", F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.xxhash64("page_id"), F.lit(YEAR_S))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("first"), F.col("payload_digest")))),
        ("Page-Id", F.col("page_id").cast("string")),
        ("Refers-To-Page-Id", F.col("first").cast("string")),
        ("Payload-Length", F.col("payload_bytes").cast("string")),
        ("Content-Type", F.when(~revisit, F.lit("application/http; msgtype=response"))),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields))
    return found.select(F.concat(lines, F.lit("\r\n\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Gzipped WARC files under path, a record for each row of pages (page_id, url, html).

    The mean size of a payload says how many records an archive holds, so that
    archives of large pages have few.
    """
    mean = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    most = max(1, min(ARCHIVE_RECORDS, int(archive_bytes / (mean + 1000))))
    records(captures(pages, least_revisit)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(fields, block, offset, length) of each record; places are in the unzipped archive."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    at = 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {start}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            at += len(line)
            key, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
            fields[key.lower()] = value.strip()
        at += len(line)
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"the record at byte {start} is cut short")
        at += size
        yield fields, block, start, at - start


def url_key(url: str | None) -> str:
    """Sort key of a URL: host from its end, then path and query; no scheme, user, default port, www or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    port_text = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of each archive under path, sorted within it: a run for each file. See ENTRY.

    The payload's length and digest are those of the bytes read back, for a
    response; they have to agree with its header.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [_entry(*r) for r in read_records(content.as_py())]
                rows.sort(key=_order)
                out = [(name, i, *r) for i, r in enumerate(rows)]
                if out:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    names = [c.split()[0] for c in ENTRY.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("run"), "content").mapInArrow(run, ENTRY)


def _entry(fields: dict[str, str], block: bytes, offset: int, length: int) -> tuple:
    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["payload-length"])
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} is not what its header says")
    page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
    return url_key(fields.get("warc-target-uri")), fields["warc-date"], int(page) if page else None, fields["warc-type"], int(refers) if refers else None, size, digest, offset, length


def _order(row: tuple) -> tuple:
    """Of an entry without run and seq: URL key, time, page_id (null first), place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7]


class LoserTree:
    """Merges sorted iterators: an inner node keeps the loser of its match, so a new head plays only those on its way up."""

    def __init__(self, runs: list[Iterator[Any]], key: Callable[[Any], Any]):
        self.runs, self.key, self.size = runs, key, max(1, len(runs))
        self.heads: list[tuple | None] = [self._pull(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.size
        winners = [-1] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _pull(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] <= y[:2])

    def __iter__(self) -> Iterator[Any]:
        while head := self.heads[self.winner]:
            yield head[2]
            me = self.winner
            self.heads[me] = self._pull(me)
            node = (me + self.size) // 2
            while node:
                if not self._beats(me, self.losers[node]):
                    me, self.losers[node] = self.losers[node], me
                node //= 2
            self.winner = me


def merged_index(runs: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """All captures in one order: range_no, then place within it; by URL key, time and page_id.

    The keys' space is cut into ranges, a task for each; the time and page_id are
    part of the cut, so that one URL with very many captures is cut too. A task
    merges its slices of the runs, each still sorted, with a loser tree.
    """
    total = runs.count()
    ranges = max(1, -(-total // range_entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        schema = None
        for b in batches:
            schema = b.schema
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                slices.setdefault(row[0], []).append(row)
        for rows in slices.values():
            rows.sort(key=lambda r: r[1])  # the shuffle may deal a run's blocks in any order
        if schema is None:
            return
        here, place, out = TaskContext.get().partitionId(), 0, []
        tree = LoserTree([iter(r) for _, r in sorted(slices.items())], key=lambda r: _order(r[2:]))
        for row in tree:
            out.append(row)
            if len(out) == 5000:
                yield _numbered(out, schema, here, place)
                place, out = place + len(out), []
        if out:
            yield _numbered(out, schema, here, place)

    dealt = runs.repartitionByRange(ranges, "url_key", "captured_at", F.col("page_id").asc_nulls_first())
    return dealt.mapInArrow(run, f"{ENTRY}, range_no int, place long")


def _numbered(rows: list[tuple], schema: pa.Schema, range_no: int, place: int) -> pa.RecordBatch:
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([range_no] * len(rows), pa.int32()), pa.array(range(place, place + len(rows)), pa.int64())], [*schema.names, "range_no", "place"])


def archive_and_index(pages: DataFrame, path: str | None = None, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write pages as archives (to a new shared folder if path is not given), read them back, merge the index.

    A row for each row of pages: ENTRY, range_no and place. Null html is an empty
    payload, and payloads below least_revisit bytes are all responses. Rows that
    repeat a page_id and its payload are all responses, or all revisits. A null
    page_id is never the response that others refer to; a null url has the empty
    key. Columns other than page_id, url and html are ignored; an empty table
    gives no rows.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc-archives")
    write_archives(pages, path, least_revisit)
    return merged_index(materialise(capture_runs(spark, path), "warc-runs"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> least THEN least END AS refers_to
FROM f
"""
