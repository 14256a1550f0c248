"""The scan job: transcript files into tables, only what changed, any number of times.

Files are listed first; only those whose size or time changed are opened, for
their head, and only those that the decision names are read and parsed, once.
The store (tracemill.sources.store) then gets the buckets of their sessions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import privacy, retention
from tracemill.sources import transcripts as tr
from tracemill.sources.scratch import discard, written
from tracemill.sources.store import BUCKETS, Store

#: Tables of a store and their keys; the first hang on sessions.
TABLES = {
    "prompts": ["session_id", "sequence"], "model_requests": ["session_id", "message_id"], "tool_calls": ["session_id", "line_no", "call_id"], "file_activity": ["session_id", "id", "ts"], "command_runs": ["session_id", "id", "ts"],
    "verification_runs": ["session_id", "id", "ts"], "compactions": ["session_id", "line_no"], "diagnostics": ["session_id", "line_no", "note"], "sessions": ["session_id"], "scan_state": ["uri"],
}
LINES = "uri string, session_id string, line_no int, offset long, value string"
STATE = "uri string, session_id string, size long, mtime long, head_hash string, import_version int"


def tables(parsed: DataFrame, home: str = "/home/u", repo: str | None = None, mode: str = "redacted-content", since_ms: int | None = None, until_ms: int | None = None, calls: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table that hangs on sessions, and sessions, from parsed lines.

    Content is redacted; features are made elsewhere, from the text as it was.
    Calls are paired before the range of time is cut, sessions keep their counts.
    calls, if they are made already: as of transcripts.tool_calls().
    """
    placed = tr.place(parsed)
    calls = tr.tool_calls(placed) if calls is None else calls
    requests = tr.model_requests(placed)
    kept = tr.within(calls, since_ms, until_ms)
    commands = tr.command_runs(kept)
    said = tr.prompts(placed).withColumn("content", tr.text.redact(F.col("content")))
    out = {
        "prompts": tr.within(said, since_ms, until_ms), "model_requests": tr.within(requests, since_ms, until_ms), "tool_calls": kept.where("state <> 'orphan'"), "file_activity": tr.file_activity(kept, home, repo), "command_runs": commands,
        "verification_runs": tr.verification_runs(commands), "compactions": tr.within(tr.compactions(placed), since_ms, until_ms), "diagnostics": tr.diagnostics(parsed, calls), "sessions": tr.sessions(parsed, calls, requests),
    }
    return {name: privacy.gate(df, name, mode) for name, df in out.items()}


def open_store(spark: SparkSession, store: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, store, dict.fromkeys(TABLES, "session_id"), buckets)


class Tables(Mapping):
    """The tables of a store by name; one is listed and read when it is asked for."""

    def __init__(self, held: Store):
        self.held = held

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.held.schemas:
            raise KeyError(name)
        return self.held.read(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.held.schemas)

    def __len__(self) -> int:
        return len(self.held.schemas)


def read(spark: SparkSession, store: str) -> Tables:
    """The tables of a store as its last complete commit left them; none if there is none."""
    return Tables(open_store(spark, store))


def decide(spark: SparkSession, root: str, store: str, excluded: list[str] = (), force: bool = False, layout: str = tr.LAYOUT, glob: str = "*.jsonl", extra: list[str] = ()) -> DataFrame:
    """What a scan would do with each file: the columns of discover() and head_hash, reason, action. A dry run is this alone.

    The listing tells which files are as the last scan saw them; of the others
    the first bytes are read. A file that can't be opened is skipped, and said so.
    """
    files = tr.discover(spark, root, extra, excluded, layout, glob)
    state = None if (held := open_store(spark, store)).empty else held.read("scan_state")
    state = spark.createDataFrame([], STATE) if state is None else state
    known = state.select("uri", "size", "mtime", F.col("import_version").alias("version")).where(F.lit(not force) & (F.col("version") == tr.IMPORT_VERSION))
    same = files.join(known.drop("version"), ["uri", "size", "mtime"], "left_semi").withColumn("head_hash", F.lit(None).cast("string"))
    opened = tr.head_hashes(files.join(known.drop("version"), ["uri", "size", "mtime"], "left_anti"))
    found = written(same.unionByName(opened), "listed")
    decided = found.join(tr.import_decisions(found, state, force), "uri")
    lost = F.col("head_hash").isNull() & (F.col("reason") != "unchanged")
    return decided.withColumns({"reason": F.when(lost, "can't be opened").otherwise(F.col("reason")), "action": F.when(lost, "skip").otherwise(F.col("action"))})


def scan(spark: SparkSession, root: str, store: str, excluded: list[str] = (), force: bool = False, mode: str = "redacted-content", home: str = "/home/u", now_ms: int | None = None, retention_days: int = 0, layout: str = tr.LAYOUT, glob: str = "*.jsonl", extra: list[str] = (), since_ms: int | None = None, until_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Load what changed below root and extra into store, and say what was done with each file: uri, session_id, reason, action, diagnostics, pruned.

    Text is read of the files to load alone, which tasks open by the names of the
    listing: they are not listed again. It is parsed once; the nine tables are
    made from what that wrote. Rows of files that are imported afresh go first; children
    are inserted where their key is new, sessions replaced. Only the buckets of
    loaded and expired sessions are rewritten, in one commit: a scan that is
    broken off changes nothing, one that finds nothing to do writes nothing.
    since_ms and until_ms keep rows of that time, both ends included. With
    retention_days expired sessions go; pruned, in each row, is their number.
    """
    held = open_store(spark, store, buckets)
    decided = written(decide(spark, root, store, excluded, force, layout, glob, extra), "decided")
    todo = decided.where("action <> 'skip'")
    some = not todo.isEmpty()
    gone = retention.expired(held.read("sessions"), now_ms, retention_days) if retention_days > 0 and now_ms is not None and not held.empty else None
    notes, pruned = spark.createDataFrame([], "session_id string, diagnostics long"), 0
    if some or gone is not None or held.empty:
        lines = tr.read_lines(spark, tr.Chosen(todo.select("uri", "size")), layout=layout, glob=glob) if some else spark.createDataFrame([], LINES)
        parsed = written(tr.timed(tr.parse(lines)).drop("value", "v"), "parsed")
        calls = written(tr.tool_calls(tr.place(parsed)), "calls")
        new = tables(parsed, home, None, mode, since_ms, until_ms, calls)
        new["scan_state"] = todo.select("uri", "session_id", "size", "mtime", "head_hash", F.lit(tr.IMPORT_VERSION).alias("import_version"))
        ids = todo.select("session_id")
        touched = held.touched(ids if gone is None else ids.unionByName(gone))
        redone = todo.where("action = 'delete and import'").select("session_id")
        merged = {name: _merged(held.read(name, touched), new[name], name, redone) for name in TABLES}
        if retention_days > 0 and now_ms is not None:
            pruned = retention.expired(merged["sessions"], now_ms, retention_days).count()
            merged |= retention.prune({name: df for name, df in merged.items() if name != "scan_state"}, now_ms, retention_days)
        if touched or held.empty:
            held.commit(merged, touched)
        notes = written(new["diagnostics"].groupBy("session_id").agg(F.count(F.lit(1)).alias("diagnostics")), "notes")
        discard(parsed)
        discard(calls)
    out = decided.select("uri", "session_id", "reason", "action").join(notes, "session_id", "left").na.fill(0, ["diagnostics"])
    return out.withColumn("pruned", F.lit(pruned).cast("long"))


def _merged(before: DataFrame | None, new: DataFrame, name: str, redone: DataFrame) -> DataFrame:
    """What a table holds of the touched buckets after the load."""
    if before is None:
        return new.dropDuplicates(TABLES[name])
    if name == "scan_state":
        return tr.upsert(before, new, ["uri"])
    before = before.join(redone, "session_id", "left_anti")
    return tr.upsert(before, new, TABLES[name]) if name == "sessions" else tr.load(before, new, TABLES[name])


def purge(spark: SparkSession, store: str, gone: DataFrame | None = None) -> DataFrame:
    """Remove the sessions of gone (session_id) with what hangs on them, or all that the store holds; of each table rows before and after.

    Only the buckets of gone are read and rewritten. The scan state goes with
    everything alone: a session that was purged or has expired is not imported
    again before its file changes.
    """
    held = open_store(spark, store)
    touched = held.touched(gone) if gone is not None else None
    before = {name: held.read(name, touched) for name in TABLES if gone is None or name != "scan_state"}
    after = retention.purge_all(before) if gone is None else retention.without(before, gone)
    counts = written(retention.summary(before, after), "purged")
    held.commit(after, touched)
    return counts


def summary(scanned: DataFrame) -> DataFrame:
    """Files discovered, imported and skipped, diagnostics of what was imported, and sessions that were pruned, of a scan."""
    return scanned.agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("action") != "skip").alias("imported"), F.count_if(F.col("action") == "skip").alias("skipped"), F.coalesce(F.sum("diagnostics"), F.lit(0)).alias("diagnostics"), F.coalesce(F.max("pruned"), F.lit(0)).alias("pruned"))
