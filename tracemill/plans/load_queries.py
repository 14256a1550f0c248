"""Queries over tables that the scan job loads: conversations are written as transcript files, discovered and scanned twice."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import coaching, metrics, privacy, summaries
from tracemill.sources import load, scratch

LAYOUT, GLOB = load.tr.LAYOUT, "*.jsonl"
BASE_MS = 1_704_067_200_000
TOOLS = ("Read", "Edit", "Bash", "Bash", "Grep", "Task")
_stores: dict[tuple[str, str], tuple[str, str, str]] = {}


def transcript_lines(turns: DataFrame) -> DataFrame:
    """(project, session, turn, sub, value): the lines of a transcript for each conversation.

    A user's turn is a prompt; an assistant's is a request over two lines, a tool
    call and mostly its result; a system's a compaction. Some conversations have
    a summary, a broken line, another record, or a record of no time.
    """
    c, turn = F.col("conv_id"), F.col("turn")
    minute = F.when(F.pmod(c, F.lit(7)) == 4, 59 - F.pmod(turn, F.lit(60))).otherwise(F.pmod(turn, F.lit(60)))  # some clocks run backwards
    stamp = lambda sub: F.concat(F.lit("2024-01-01T"), F.lpad(F.pmod(c, F.lit(24)).cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(f":0{sub}Z"))
    k = F.pmod(c + turn, F.lit(6))
    folder = F.concat(F.lit("/home/u/p"), F.pmod(c, F.lit(5)).cast("string"))
    path = F.concat(folder, F.lit("/src/f"), F.pmod(turn, F.lit(3)).cast("string"), F.lit(".py"))
    call = F.concat(F.lit("t"), turn.cast("string"), F.lit("-"), c.cast("string"))
    pairs = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    commit = F.concat(F.lit("git commit -m x "), F.substring(F.sha2(turn.cast("string"), 256), 1, 40))
    given = F.when(k == 0, pairs("file_path", path)).when(k == 1, pairs("content", "héé", "file_path", path)).when(k == 2, pairs("command", "npm test")).when(k == 3, pairs("command", commit)).when(k == 4, pairs("pattern", "x")).otherwise(F.create_map().cast("map<string,string>"))
    measured = F.pmod(c, F.lit(10)) != 7
    usage = lambda out, cache: F.when(measured, F.struct(F.length("text").alias("input_tokens"), out.alias("output_tokens"), cache.alias("cache_read_input_tokens")))
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (k + 1).cast("int"))
    use = F.struct(F.lit("tool_use").alias("type"), call.alias("id"), tool.alias("name"), given.alias("input"))
    failed = F.pmod(c + turn, F.lit(4)) == 0
    say = lambda kind, at, **more: F.to_json(F.struct(F.lit(kind).alias("type"), at.alias("timestamp"), *(v.alias(n) for n, v in more.items())))
    message = lambda **f: F.struct(*(v.alias(n) for n, v in f.items()))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    model = F.when(F.pmod(c, F.lit(3)) == 0, "north-large").when(F.pmod(c, F.lit(3)) == 2, "delta-mid")
    ident, none = F.concat(F.lit("m"), turn.cast("string")), F.lit(None).cast("string")
    result = lambda content: F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), failed.alias("is_error"), content.alias("content"))
    answer = F.when(failed, say("user", stamp(3), message=message(content=F.array(result(F.concat(F.lit("\n  line "), turn.cast("string"), F.lit(" failed\nmore"))))))).otherwise(say("user", stamp(3), message=message(content=F.array(result(F.array(F.lit("ok"), F.lit("é")))))))
    odd = F.when(F.pmod(c, F.lit(9)) == 0, F.lit("{bad")).when(F.pmod(c, F.lit(9)) == 1, say("other", stamp(5))).when(F.pmod(c, F.lit(9)) == 2, say("user", F.lit("soon"), message=message(content=F.lit("dropped")))).when(F.pmod(c, F.lit(9)) == 3, F.lit("[1]"))
    user, assistant, system = (F.col("role") == r for r in ("user", "assistant", "system"))
    each = {
        -1: F.when((turn == 0) & (F.pmod(c, F.lit(8)) == 0), F.to_json(F.struct(F.lit("summary").alias("type"), F.lit("x").alias("summary")))),
        0: F.when(user, F.when(F.pmod(turn, F.lit(5)) == 4, say("user", stamp(0), cwd=folder, message=message(content=block))).otherwise(say("user", stamp(0), cwd=folder, message=message(content=F.col("text"))))).when(system, say("system", stamp(0), subtype=F.lit("compact_boundary"))),
        1: F.when(assistant, say("assistant", stamp(1), isSidechain=k == 5, message=message(id=ident, model=model, usage=usage(F.lit(1), F.lit(None).cast("long")), content=F.array(use)))),
        2: F.when(assistant, say("assistant", none, message=message(id=ident, stop_reason=F.when(F.pmod(turn, F.lit(4)) == 1, "end_turn").otherwise("tool_use"), usage=usage(turn + 2, F.when(F.pmod(c, F.lit(2)) == 0, turn * 10)), content=block))),
        3: F.when(assistant & (F.pmod(turn, F.lit(7)) != 3), answer), 5: F.when(turn == 0, odd),
    }
    lines = F.filter(F.array(*(F.struct(F.lit(sub).alias("sub"), v.alias("value")) for sub, v in each.items())), lambda x: x["value"].isNotNull())
    return turns.select(F.concat(F.lit("-home-u-p"), F.pmod(c, F.lit(5)).cast("string")).alias("project"), c.alias("session"), "turn", F.explode(lines).alias("l")).select("project", "session", "turn", "l.sub", "l.value")


def write_transcripts(turns: DataFrame, root: str) -> None:
    """A file for each conversation below root; those of conversations that have one already are replaced.

    A task writes the files of its conversations into the folder of their
    project. A folder for each, as Spark's writer makes them, would be moved one
    by one by the driver, and listed one by one with every scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, top = load.tr.opened_at(f"{root}/projects")
        folders, held, own, out = set(), None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                at.move(own, f"{top}/{held[0]}/{held[1]}.jsonl")

        for b in batches:
            for *place, value in zip(*(b.column(c).to_pylist() for c in ("project", "session", "value"))):
                if place != held:
                    close()
                    held, folder = place, f"{top}/{place[0]}"
                    if folder not in folders:
                        at.create_dir(folder, recursive=True)
                        folders.add(folder)
                    own = f"{folder}/.{place[1]}-{uuid.uuid4().hex}"
                    out = at.open_output_stream(own)
                out.write(value.encode() + b"\n")
        close()
        yield from ()

    lines = transcript_lines(turns).repartition("session").sortWithinPartitions("project", "session", "turn", "sub")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c)
    lines.select(name("project"), name("session"), "value").mapInArrow(run, "session string").write.format("noop").mode("overwrite").save()


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def store(spark: SparkSession, d: str) -> tuple[str, str]:
    """Root of the transcripts of d, and the store that they were scanned into; made once for as long as the table's files and the store stay."""
    key = (spark.sparkContext.applicationId, d)
    state = scratch.state_of(spark, f"{d}/conversations.parquet")
    if key not in _stores or _stores[key][2] != state or not scratch.exists(spark, _stores[key][1]):
        root, tables = scratch.fresh_path(spark, "transcripts"), scratch.fresh_path(spark, "store")
        write_transcripts(conversations(spark, d), root)
        load.scan(spark, root, tables, excluded=["/home/u/p9"], layout=LAYOUT, glob=GLOB)
        _stores[key] = (root, tables, state)
    return _stores[key][:2]


def loaded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return load.read(spark, store(spark, d)[1])


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def loaded_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = loaded(spark, d)["prompts"]
    return p.select("session_id", *_long("sequence"), "ts", F.sha2("content", 256).alias("content_sha256"), "content_hash", *_long("character_count"), "approximate_tokens")


def loaded_requests(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d)["model_requests"]


def loaded_calls(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d)["tool_calls"].drop("line_no")


def loaded_files(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d)["file_activity"]


def loaded_commands(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d)["command_runs"]


def loaded_verifications(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d)["verification_runs"]


def loaded_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = loaded(spark, d)["sessions"]
    return s.withColumn("completeness", F.array_join("completeness", ",")).withColumns({c: F.col(c).cast("long") for c in ("prompts", "model_requests", "tool_calls", "compactions", "subagent_calls")})


def loaded_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d)["diagnostics"].select("session_id", *_long("line_no"), "level", "note")


def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    """A scan after the first one: nothing has changed, and nothing is opened; one that is forced, which loads everything afresh; and a dry one."""
    root, tables = store(spark, d)
    again = load.summary(load.scan(spark, root, tables, layout=LAYOUT, glob=GLOB)).withColumn("run", F.lit("again"))
    forced = load.summary(load.scan(spark, root, scratch.fresh_path(spark, "store"), force=True, layout=LAYOUT, glob=GLOB)).withColumn("run", F.lit("forced"))
    dry = load.decide(spark, root, tables, excluded=["/home/u/p1"], layout=LAYOUT, glob=GLOB).withColumns({"diagnostics": F.lit(0).cast("long"), "pruned": F.lit(0).cast("long")})
    return again.unionByName(forced).unionByName(load.summary(dry).withColumn("run", F.lit("dry, a project excluded")))


def store_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """What a scan rewrites after the sessions of one project grew by their last turn: of each table the buckets that hold rows, those written and those left alone."""
    turns, root, path = conversations(spark, d), scratch.fresh_path(spark, "transcripts"), scratch.fresh_path(spark, "store")
    grows = F.pmod("conv_id", F.lit(5)) == 3
    last = turns.where(grows).groupBy("conv_id").agg(F.max("turn").alias("turn"))
    write_transcripts(turns.join(last, ["conv_id", "turn"], "left_anti"), root)
    load.scan(spark, root, path, layout=LAYOUT, glob=GLOB)
    write_transcripts(turns.where(grows), root)
    load.scan(spark, root, path, layout=LAYOUT, glob=GLOB)
    return load.open_store(spark, path).rewritten()


#: Of scan_range: the hours of the day whose rows are kept, the hour before which sessions have expired, and a project that is purged.
HOURS, EXPIRED_HOUR, PURGED = (6, 18), 9, 2


def scan_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table after a scan of a range of time with retention, and how many of them a purge of one project's sessions takes."""
    root, path, hour = store(spark, d)[0], scratch.fresh_path(spark, "store"), 3_600_000
    scanned = load.scan(spark, root, path, layout=LAYOUT, glob=GLOB, since_ms=BASE_MS + HOURS[0] * hour, until_ms=BASE_MS + HOURS[1] * hour, now_ms=BASE_MS + EXPIRED_HOUR * hour + 86_400_000, retention_days=1)
    counts = None
    for name, df in load.read(spark, path).items():
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        counts = row if counts is None else counts.unionByName(row)
    counts = scratch.written(counts, "counts")
    gone = load.read(spark, path)["sessions"].where(F.pmod(F.col("session_id").cast("long"), F.lit(5)) == PURGED).select("session_id")
    purged = load.purge(spark, path, scratch.written(gone, "gone")).select("table", "gone")
    pruned = load.summary(scanned).select(F.lit("pruned sessions").alias("table"), F.col("pruned").alias("rows"), F.lit(0).cast("long").alias("gone"))
    return counts.join(purged, "table", "left").na.fill(0, ["gone"]).unionByName(pruned)


def completeness(spark: SparkSession, d: str) -> DataFrame:
    return summaries.completeness(loaded(spark, d)["sessions"])


def scan_provenance(spark: SparkSession, d: str) -> DataFrame:
    s = loaded(spark, d)["sessions"].withColumns({"source_id": F.concat(F.lit("s"), F.pmod(F.col("session_id").cast("long"), F.lit(2)).cast("string")), "import_provenance": F.lit(f"parser:v{load.tr.IMPORT_VERSION}")})
    sources = spark.createDataFrame([("s0", "1.2"), ("s1", "1.3")], "source_id string, adapter_version string")
    return summaries.scan_provenance(s, sources)


def session_timeline(spark: SparkSession, d: str) -> DataFrame:
    """All seven tables of events of every session, in one order."""
    t = loaded(spark, d)
    return metrics.session_timeline(t["prompts"], t["model_requests"], t["tool_calls"], t["file_activity"], t["command_runs"], t["verification_runs"], t["compactions"])


def prompt_comparison(spark: SparkSession, d: str) -> DataFrame:
    t = loaded(spark, d)
    p = t["prompts"].withColumns(text.prompt_features(F.col("content"), F.col("sequence")))
    found = coaching.comparison(p, coaching.outcome_evidence(p, t["file_activity"], t["verification_runs"]))
    joined = {c: F.array_join(c, "; ") for c in ("strengths", "ambiguities", "missing", "outcome")}
    return found.withColumns(joined).select("session_id", *_long("sequence"), *joined, F.sha2("suggestion", 256).alias("suggestion_sha256"), "disclaimer")


def metadata_only(spark: SparkSession, d: str) -> DataFrame:
    """What tables hold of content when read in metadata mode: rows, and values left in each table's content columns."""
    t, out = loaded(spark, d), None
    for name in ("prompts", "tool_calls", "file_activity", "command_runs"):
        gated = privacy.gate(t[name], name)
        row = gated.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), sum((F.count(c) for c in privacy.CONTENT[name]), F.lit(0)).cast("long").alias("content_values"))
        out = row if out is None else out.unionByName(row)
    return out


def tool_behaviour(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tool_behaviour(loaded(spark, d)["tool_calls"])


def _of_project(rows: DataFrame) -> DataFrame:
    return rows.withColumn("project", F.pmod(F.col("session_id").cast("long"), F.lit(5)))


def repeated_tool_searches(spark: SparkSession, d: str) -> DataFrame:
    return metrics.repeated_searches(_of_project(loaded(spark, d)["tool_calls"]), "project")


def overview_tops(spark: SparkSession, d: str) -> DataFrame:
    """The six tools and the five kinds of commands that are used most."""
    t = loaded(spark, d)
    kinds = t["command_runs"].withColumn("name", F.concat_ws(" ", "executable", "classification"))
    lists = {"tools": metrics.top(t["tool_calls"], "tool", 6), "commands": metrics.top(kinds, "name", 5)}
    return lists["tools"].withColumn("list", F.lit("tools")).unionByName(lists["commands"].withColumn("list", F.lit("commands")))


def loaded_usage(spark: SparkSession, d: str) -> DataFrame:
    """Sessions, compactions, calls of subagents and of all, of each project and of all."""
    sums = (F.sum(c).cast("long").alias(c) for c in ("compactions", "subagent_calls", "tool_calls"))
    return _of_project(loaded(spark, d)["sessions"]).rollup("project").agg(F.count(F.lit(1)).alias("sessions"), *sums)


QUERIES = {
    "tool_behaviour": tool_behaviour, "repeated_tool_searches": repeated_tool_searches, "overview_tops": overview_tops, "loaded_usage": loaded_usage,
    "loaded_prompts": loaded_prompts, "loaded_requests": loaded_requests, "loaded_calls": loaded_calls, "loaded_files": loaded_files, "loaded_commands": loaded_commands, "loaded_verifications": loaded_verifications, "loaded_sessions": loaded_sessions,
    "loaded_diagnostics": loaded_diagnostics, "scan_summary": scan_summary, "store_rewrites": store_rewrites, "scan_range": scan_range, "completeness": completeness, "scan_provenance": scan_provenance, "session_timeline": session_timeline, "prompt_comparison": prompt_comparison, "metadata_only": metadata_only,
}
