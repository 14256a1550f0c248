"""Session transcripts: JSON lines in, typed tables out.

A transcript is a file of one session; its lines are kept in order by number.
Bad lines never stop a scan: they become diagnostics.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracemill.functions import text

KINDS = ("summary", "user", "assistant", "system")
TOKENS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
FILE_OPERATIONS = {"Read": "read", "Write": "write", "Edit": "edit", "MultiEdit": "edit", "NotebookEdit": "edit", "Grep": "search", "Glob": "list"}
IMPORT_VERSION = 1
HEAD_BYTES, SIGNATURE_CHARS = 65_536, 120
#: How a file's project and session are told from its path.
LAYOUT = r"/projects/([^/]+)/([^/]+)\.jsonl$"


def _named(uri: Column, layout: str, group: int) -> Column:
    """A part of a file's name; Spark's names are encoded as in URLs, but for the plus sign."""
    return F.url_decode(F.replace(F.regexp_extract(uri, layout, group), F.lit("+"), F.lit("%2B")))


def discover(spark: SparkSession, root: str, extra: list[str] = (), excluded: list[str] = (), layout: str = LAYOUT, glob: str = "*.jsonl") -> DataFrame:
    """Files (uri, project, session_id, size, mtime) below root and extra that the layout fits, but for projects below an excluded path.

    This is the listing alone: without its content column the source opens no file.
    Spark lists no files of zero bytes: one that was emptied keeps what it held.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load([root, *extra])
    uri = F.col("_metadata.file_path")
    files = found.select(uri.alias("uri"), _named(uri, layout, 1).alias("project"), _named(uri, layout, 2).alias("session_id"), F.col("_metadata.file_size").alias("size"), F.unix_millis("_metadata.file_modification_time").alias("mtime"))
    path = text.path_of_folder(F.col("project"))
    for prefix in excluded:
        files = files.where(~((path == prefix) | path.startswith(prefix.rstrip("/") + "/")))
    few = 4 * spark.sparkContext.defaultParallelism  # Spark's splits hold few small files each; nothing is read of them here
    return files.where("session_id <> ''").coalesce(few)


class Chosen:
    """Files to read, by a DataFrame of their uri and size. Their paths pass the driver only if they are iterated over."""

    def __init__(self, files: DataFrame):
        self.files = files

    def __iter__(self) -> Iterator[str]:
        return (as_path(r["uri"]) for r in self.files.select("uri").toLocalIterator())


def read_lines(spark: SparkSession, root: str | list[str] | Chosen, extra: list[str] = (), layout: str = LAYOUT, glob: str = "*.jsonl") -> DataFrame:
    """(uri, session_id, line_no, offset, value) of every line that isn't blank, the unended last one too, of the files below root (a folder, or paths).

    Files are read by Spark's own splits, not whole: lines are put in order by
    the place of their split in the file and their place in it, within the file.
    Chosen files are not listed again: tasks open each where it lies and stream it.
    """
    if isinstance(root, Chosen):
        placed = _lines_of(root.files)
        return placed.where(F.trim("value") != "").select("uri", _named(F.col("uri"), layout, 2).alias("session_id"), "line_no", "offset", "value")
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text([*([root] if isinstance(root, str) else root), *extra])
    lines = read.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    order = Window.partitionBy("uri").orderBy("block", "row")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumns({"line_no": F.row_number().over(order), "offset": F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0))})
    return placed.where(F.trim("value") != "").select("uri", _named(F.col("uri"), layout, 2).alias("session_id"), "line_no", "offset", "value")


def opened_at(uri: str) -> tuple:
    """Arrow's file system of a file or folder, and its path there. A name without a scheme is a path of this machine."""
    from pyarrow import fs

    local = re.match("(file:)?/", uri)
    return (fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", uri)) if uri.startswith("file:") else uri) if local else fs.FileSystem.from_uri(uri)


#: What a task of _lines_of() reads: bytes of a file at a time, bytes of lines in a batch, and so many bytes and files in all.
CHUNK_BYTES, BATCH_BYTES, TASK_BYTES, TASK_FILES = 1 << 20, 4 << 20, 32 << 20, 4000


def _lines_of(files: DataFrame) -> DataFrame:
    """(uri, line_no, offset, value) of every line of files (uri, size), blank ones too; a file is streamed by one task, as its session is put in order by one."""
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-total["bytes"] // TASK_BYTES), -(-total["n"] // TASK_FILES))

    def lines(uri: str) -> Iterator[bytes]:
        at, path = opened_at(uri)
        with at.open_input_stream(path) as f:
            rest = []
            while chunk := f.read(CHUNK_BYTES):
                first, *more = chunk.split(b"\n")
                rest.append(first)
                if more:
                    yield b"".join(rest)
                    yield from more[:-1]
                    rest = [more[-1]]
            if last := b"".join(rest):
                yield last

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        uris, numbers, offsets, values = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(numbers, pa.int32()), pa.array(offsets, pa.int64()), pa.array(values, pa.string())], ["uri", "line_no", "offset", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for uri in b.column("uri").to_pylist():
                offset = 0
                for n, line in enumerate(lines(uri), 1):
                    rows.append((uri, n, offset, (line.removeprefix(b"\xef\xbb\xbf") if n == 1 else line).decode("utf-8", "replace")))
                    offset, held = offset + len(line) + 1, held + len(line) + len(uri)
                    if held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return files.select("uri").repartition(tasks, "uri").mapInArrow(run, "uri string, line_no int, offset long, value string")


def as_path(uri: str) -> str:
    """A file's name as Spark's readers take it: not encoded, and with nothing in it that they would read as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def head_hashes(files: DataFrame, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """files (uri and others) with head_hash: of the first head_bytes bytes, null for a file that can't be opened.

    Tasks open each file where it lies and read no more than its head. Stores
    that Arrow has no file system for are refused.
    """
    names = [c for c in files.columns if c != "head_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = []
            for uri in b.column("uri").to_pylist():
                at, path = opened_at(uri)
                try:
                    with at.open_input_file(path) as f:
                        hashes.append(hashlib.sha256(f.read(head_bytes)).hexdigest())
                except OSError:
                    hashes.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.string())], [*b.schema.names, "head_hash"])

    return files.select(*names).mapInArrow(run, StructType([*files.select(*names).schema, StructField("head_hash", StringType())]))


def import_decisions(files: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """What to do with each file (uri, size, mtime, head_hash), given what the last scan saw: action and reason. A dry run stops here."""
    s = state.select("uri", *(F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "head_hash", "import_version")))
    seen = F.col("old_size").isNotNull()
    reason = (
        F.when(F.lit(force), "forced").when(~seen, "first import").when(F.col("old_import_version") != IMPORT_VERSION, "parser changed")
        .when((F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")), "unchanged").when(F.col("size") < F.col("old_size"), "shrank").when(F.col("head_hash") != F.col("old_head_hash"), "head changed").otherwise("grew")
    )
    out = files.join(s, "uri", "left").withColumn("reason", reason)
    action = F.when(F.col("reason") == "unchanged", "skip").when(F.col("reason") == "grew", "append").when(F.col("reason") == "first import", "import").otherwise("delete and import")
    return out.select("uri", "reason", action.alias("action"))


def _get(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.expr(f"try_variant_get({of}, '{path}', '{kind}')")


def parse(lines: DataFrame) -> DataFrame:
    """Lines with their record: kind, raw timestamp, message parts; level and note where something is wrong."""
    p = lines.withColumn("v", F.expr("try_parse_json(value)"))
    isobject = F.expr("schema_of_variant(v) like 'OBJECT%'")
    kind = _get("$.type")
    p = p.withColumns({"kind": F.when(kind.isin(*KINDS), kind).otherwise("unknown"), "raw_ts": _get("$.timestamp"), "cwd": _get("$.cwd"), "sidechain": _get("$.isSidechain", "boolean"), "subtype": _get("$.subtype")})
    level = F.when(F.col("v").isNull(), "error").when(~isobject, "warn").when(F.col("kind") == "unknown", "info")
    note = F.when(F.col("v").isNull(), "malformed JSON").when(~isobject, "not a record").when(F.col("kind") == "unknown", "unknown type")
    p = p.withColumns({"level": level, "note": note, "content": F.expr("try_variant_get(v, '$.message.content', 'variant')"), "message_id": _get("$.message.id"), "model": _get("$.message.model"), "stop_reason": _get("$.message.stop_reason")})
    return p.withColumns({t: _get(f"$.message.usage.{t}", "long") for t in TOKENS})


def diagnostics(parsed: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Lines with something wrong: malformed, no record, unknown kind, nothing to take a time from, a result without its use. calls: as of tool_calls()."""
    wrong = parsed.where("level is not null").select("session_id", "line_no", "level", "note")
    placed = parsed if "prompt_seq" in parsed.columns else timed(parsed)
    untimed = placed.where("ts is null and coalesce(level, 'info') = 'info'").select("session_id", "line_no", F.lit("warn").alias("level"), F.when(_missing_time(), "no timestamp yet").otherwise("invalid timestamp").alias("note"))
    orphans = (tool_calls(place(placed)) if calls is None else calls).where("state = 'orphan'").select("session_id", "line_no", F.lit("warn").alias("level"), F.lit("result without a use").alias("note"))
    return wrong.unionByName(untimed).unionByName(orphans)


def _missing_time() -> Column:
    return F.col("raw_ts").isNull() | (F.col("raw_ts") == "")


def timed(parsed: DataFrame) -> DataFrame:
    """parsed with ts (of a record: its own, or the last valid one before it; null where there is none), said and prompt_seq (prompts so far): what all tables are made of."""
    records = F.coalesce("level", F.lit("info")) == "info"
    got = F.when(records, F.unix_millis(F.expr("try_to_timestamp(raw_ts)")))
    order = Window.partitionBy("session_id").orderBy("line_no")
    before = F.last(got, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = parsed.withColumn("ts", F.when(records, F.when(_missing_time(), before).otherwise(got)))
    rows = rows.withColumn("said", F.when(F.col("ts").isNotNull(), prompt_text()))
    return rows.withColumn("prompt_seq", F.sum(F.col("said").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def place(parsed: DataFrame) -> DataFrame:
    """Records in time, with the number of prompts so far: a missing timestamp is the last valid one before it, an invalid one drops the record."""
    return (parsed if "prompt_seq" in parsed.columns else timed(parsed)).where("ts is not null")


def within(rows: DataFrame, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Rows whose ts lies in the range, both ends included."""
    rows = rows if since_ms is None else rows.where(F.col("ts") >= since_ms)
    return rows if until_ms is None else rows.where(F.col("ts") <= until_ms)


def blocks(placed: DataFrame) -> DataFrame:
    """Content blocks: (session_id, line_no, ts, kind, sidechain, prompt_seq, pos, type, block)."""
    keep = ["session_id", "line_no", "ts", "kind", "sidechain", "prompt_seq"]
    arrays = placed.where("schema_of_variant(content) like 'ARRAY%'").select(*keep, F.expr("try_cast(content as array<variant>)").alias("items"))
    return arrays.select(*keep, F.posexplode("items").alias("pos", "block")).withColumn("type", _get("$.type", of="block"))


def prompt_text() -> Column:
    """What a user's record says: string content as it is; else the text blocks, unless the record answers a tool; null if nothing."""
    items = F.expr("try_cast(content as array<variant>)")
    kind = lambda b: F.try_variant_get(b, "$.type", "string")
    words = F.trim(F.array_join(F.transform(F.filter(items, lambda b: kind(b) == "text"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))), "\n"))
    answer = F.exists(items, lambda b: F.coalesce(kind(b) == "tool_result", F.lit(False)))
    isarray = F.expr("schema_of_variant(content) like 'ARRAY%'")
    said = F.when(isarray, F.when(~answer & (words != ""), words)).when(F.expr("schema_of_variant(content) = 'STRING'"), F.expr("try_cast(content as string)"))
    return F.when(F.col("kind") == "user", said)


def prompts(placed: DataFrame) -> DataFrame:
    """User prompts, numbered within their session."""
    found = placed.where("said is not null").withColumn("content", F.col("said"))
    return found.select("session_id", F.col("prompt_seq").alias("sequence"), "ts", "content", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("character_count"), F.ceil(F.length("content") / 4).alias("approximate_tokens"))


def model_requests(placed: DataFrame) -> DataFrame:
    """One row for each message id: the first line's time and prompt, the largest counts; a missing model is the session's last."""
    a = placed.where("kind = 'assistant'").withColumn("message_id", F.coalesce("message_id", F.concat(F.lit("noid-"), "line_no")))
    last = a.groupBy("session_id").agg(F.max_by(F.col("model"), F.when(F.col("model").isNotNull(), F.col("line_no"))).alias("last_model"))
    rows = a.groupBy("session_id", "message_id").agg(F.min_by("ts", "line_no").alias("ts"), F.min_by("prompt_seq", "line_no").alias("prompt_seq"), F.min_by("model", "line_no").alias("model"), *(F.max(t).alias(t) for t in TOKENS))
    return rows.join(last, "session_id").select("session_id", "message_id", "ts", prompt_id(), F.coalesce("model", "last_model").alias("model_id"), *TOKENS)


def prompt_id() -> Column:
    """Key of the prompt that a row came after, null before the first."""
    return F.when(F.col("prompt_seq") > 0, F.concat_ws(":", "session_id", F.lit("p"), "prompt_seq")).alias("prompt_id")


def tool_calls(placed: DataFrame) -> DataFrame:
    """Tool uses with their results: state matched, overwritten, partial or orphan; success, sizes, duration, and what a call was on."""
    b = blocks(placed)
    keep = ["session_id", "line_no", "pos", "ts", "sidechain", "prompt_seq"]
    null = lambda kind: F.lit(None).cast(kind)
    use = b.where("kind = 'assistant' and type = 'tool_use'").select(*keep, F.lit(True).alias("is_use"), _get("$.id", of="block").alias("call_id"), F.coalesce(_get("$.name", of="block"), F.lit("unknown")).alias("tool"), F.expr("try_variant_get(block, '$.input', 'variant')").alias("input"), null("boolean").alias("error"), null("long").alias("out_bytes"), null("string").alias("out_text"))
    body = F.expr("try_variant_get(block, '$.content', 'variant')")
    isstring = F.schema_of_variant(body) == "STRING"
    strings = F.transform(F.filter(F.expr("try_cast(try_variant_get(block, '$.content', 'variant') as array<variant>)"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.octet_length(F.try_variant_get(x, "$", "string")))
    size = F.when(isstring, F.octet_length(body.cast("string"))).otherwise(F.aggregate(strings, F.lit(0), lambda n, x: n + x))
    error = F.coalesce(_get("$.is_error", "boolean", "block"), _get("$.isError", "boolean", "block"), F.lit(False))
    result = b.where("kind = 'user' and type = 'tool_result'").select(*keep, F.lit(False).alias("is_use"), _get("$.tool_use_id", of="block").alias("call_id"), null("string").alias("tool"), null("variant").alias("input"), error.alias("error"), size.cast("long").alias("out_bytes"), F.when(isstring, body.cast("string")).alias("out_text"))
    w = Window.partitionBy("session_id", "call_id").orderBy("line_no", "pos")
    rows = use.unionByName(result).where("call_id is not null")
    ahead = {c: F.lead(c).over(w) for c in ("is_use", "error", "out_bytes", "out_text", "ts")}
    rows = rows.withColumns({f"next_{c}": x for c, x in ahead.items()} | {"before": F.lag("is_use").over(w)})
    state = F.when(F.col("is_use"), F.when(F.col("next_is_use").isNull(), "partial").when(F.col("next_is_use"), "overwritten").otherwise("matched")).when(~F.coalesce(F.col("before"), F.lit(False)), "orphan")
    rows = rows.withColumn("state", state).where("state is not null")
    path = F.coalesce(_get("$.file_path", of="input"), _get("$.notebook_path", of="input"))
    operation = F.create_map(*(F.lit(x) for kv in FILE_OPERATIONS.items() for x in kv))[F.col("tool")]
    matched = F.col("state") == "matched"
    success = F.when(matched, ~F.col("next_error")).when(F.col("state") == "orphan", None).otherwise(False)
    return rows.select(
        "session_id", "line_no", "call_id", "ts", prompt_id(), F.when(F.col("sidechain"), "subagent").alias("attribution"), "tool", F.sha2(F.to_json("input").cast("binary"), 256).alias("input_hash"), "state", success.alias("success"), F.when(~success, F.when(matched, "error").otherwise("unknown")).alias("failure_type"),
        F.octet_length(F.to_json("input")).cast("long").alias("input_bytes"), F.when(matched, F.col("next_out_bytes")).alias("output_bytes"), F.when(matched, F.col("next_ts") - F.col("ts")).alias("duration_ms"), operation.alias("operation"), F.when(operation.isNotNull(), path).alias("path"),
        F.when(operation.isNotNull(), F.octet_length(_get("$.content", of="input"))).cast("long").alias("content_bytes"), F.when(F.col("tool") == "Bash", _get("$.command", of="input")).alias("command"), F.when(matched & F.col("next_error"), failure_signature(F.col("next_out_text"))).alias("failure_signature"),
    )


def failure_signature(output: Column) -> Column:
    """The first line of an error's output that isn't blank, cut to SIGNATURE_CHARS."""
    return F.substring(F.get(F.filter(F.split(output, "\n"), lambda x: F.trim(x) != ""), F.lit(0)), 1, SIGNATURE_CHARS)


def file_activity(calls: DataFrame, home: str, repo: str | None = None) -> DataFrame:
    """The calls that worked on files: operation, shown path, its hash, success, bytes of content."""
    shown, hashed = text.redact_path(F.col("path"), home, repo)
    rows = calls.where("operation is not null and path is not null and state <> 'orphan'")
    return rows.select(F.concat("call_id", F.lit(":file")).alias("id"), "session_id", "call_id", "ts", "operation", shown.alias("path"), hashed.alias("path_hash"), "success", "content_bytes")


def command_runs(calls: DataFrame) -> DataFrame:
    """Shell commands: classes, scope and hash, success, size of the output, what a failure said, and the commit that is named."""
    rows = calls.where("command is not null and state <> 'orphan'").withColumns(text.command_columns(F.col("command")))
    commit = F.nullif(F.regexp_extract("command", r"(?:^|[^0-9A-Za-z_])([0-9a-f]{40})(?:$|[^0-9A-Za-z_])", 1), F.lit(""))
    return rows.select(F.concat("call_id", F.lit(":cmd")).alias("id"), "session_id", "call_id", "ts", "executable", "family", text.redact(F.col("command")).alias("command"), "command_hash", "classification", "scope", "success", "output_bytes", "failure_signature", commit.alias("commit_id"))


def verification_runs(commands: DataFrame) -> DataFrame:
    """The commands that check something, by kind."""
    kind = F.create_map(*(F.lit(x) for kv in text.VERIFICATION_KINDS.items() for x in kv))[F.col("classification")]
    return commands.withColumn("kind", kind).where("kind is not null").select(F.concat("call_id", F.lit(":verify")).alias("id"), "session_id", "call_id", "ts", "kind", "success")


def compactions(placed: DataFrame) -> DataFrame:
    return placed.where((F.col("kind") == "system") & F.col("subtype").rlike("(?i)compact")).select("session_id", "line_no", "ts", F.col("subtype").alias("trigger"))


def sessions(parsed: DataFrame, calls: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
    """Start, end, duration, completion, counts and completeness of every session that has a placed record.

    Start and end are the times of the first and the last placed record by their
    place in the file, so that a clock that was put back gives a duration below 0.
    calls and requests: as of tool_calls() and model_requests().

    Completeness flags: tail-missing without an explicit end, metrics-missing if
    no request states its tokens, prompts-missing; complete where there are none.
    """
    placed = place(parsed)
    calls = (tool_calls(placed) if calls is None else calls).where("state <> 'orphan'")
    requests = model_requests(placed) if requests is None else requests
    real = F.col("kind") != "summary"
    last_stop = F.max_by("stop_reason", F.when(F.col("stop_reason").isNotNull(), F.col("line_no")))
    s = placed.groupBy("session_id").agg(
        F.min_by("ts", "line_no").alias("started_at"), F.max_by("ts", "line_no").alias("ended_at"), last_stop.alias("stop"), F.count_if(real).alias("records"), F.min_by("cwd", F.when(real & F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"), F.min_by("sidechain", F.when(real, F.col("line_no"))).alias("sidechain"),
        F.count_if((F.col("kind") == "system") & F.col("subtype").rlike("(?i)compact")).alias("compactions"), F.count("said").alias("prompts"),
    )
    used = calls.groupBy("session_id").agg(F.count_if(F.col("state") != "overwritten").alias("tool_calls"), F.count_if(F.col("state") == "partial").alias("open_calls"), F.count("attribution").alias("subagent_calls"))
    asked = requests.groupBy("session_id").agg(F.count(F.lit(1)).alias("model_requests"), F.count(F.coalesce(*TOKENS)).alias("measured"))
    s = s.join(used, "session_id", "left").join(asked, "session_id", "left").na.fill(0, ["tool_calls", "open_calls", "subagent_calls", "model_requests", "measured"])
    done = F.when(F.col("stop") == "end_turn", "completed").when((F.col("open_calls") > 0) | (F.col("records") > 0), "interrupted").otherwise("unknown")
    flags = F.array_compact(F.array(F.when(~F.coalesce(F.col("stop") == "end_turn", F.lit(False)), "tail-missing"), F.when((F.col("model_requests") > 0) & (F.col("measured") == 0), "metrics-missing"), F.when(F.col("prompts") == 0, "prompts-missing")))
    return s.select(
        "session_id", "started_at", "ended_at", (F.col("ended_at") - F.col("started_at")).alias("duration_ms"), done.alias("completion"), F.when(F.col("sidechain"), "subagent").otherwise("unknown").alias("entry_point"), "cwd",
        "prompts", "model_requests", "tool_calls", "compactions", "subagent_calls", F.when(F.size(flags) == 0, F.array(F.lit("complete"))).otherwise(flags).alias("completeness"),
    )


def load(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of existing, and those of incoming whose key is new: loading twice changes nothing."""
    return existing.unionByName(incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti"))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming, and those of existing that it has no row for."""
    return incoming.unionByName(existing.join(incoming.select(*key), key, "left_anti"))
