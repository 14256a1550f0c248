"""Queries over hook events: envelopes are made from events, parsed, redacted, spooled and drained as a stream; with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import correlation
from tracemill.plans import queries as base
from tracemill.sources import bindings, otlp, scratch
from tracemill.sources.scratch import fresh_path
from tracemill.streaming import correlating, hooks

NAMES = {"signup": "UserPromptSubmit", "view": "PreToolUse", "click": "PostToolUse", "purchase": "SessionEnd", "error": "Stop"}
_spools: dict[tuple[str, str], tuple[str, str]] = {}
_drained: dict[tuple[str, str], tuple[str, str]] = {}


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """A hook payload (body) for each event: some broken, some no object, some without a name or of an unknown one."""
    e = bindings.activity(spark, d)
    name = F.when(F.col("event_id") % 8 == 2, None).when(F.col("event_id") % 8 == 3, "Custom").otherwise(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))[F.col("event_type")])
    user = F.col("user_id").cast("string")
    fields = F.struct(
        user.alias("session_id"), name.alias("hook_event_name"), F.concat(F.lit("/home/u/p"), (F.col("user_id") % 5).cast("string")).alias("cwd"), F.col("event_id").cast("string").alias("agent_id"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("use token=abcdef"), F.col("event_id").cast("string"), F.lit(" now"))).alias("prompt"), F.when(F.col("kind").isin("read", "edit"), "Read").alias("tool_name"),
        F.when(F.col("kind").isin("read", "edit"), F.struct(F.col("path_hash").alias("z"), F.lit("/home/u/a").alias("file_path"))).alias("tool_input"),
    )
    body = F.when(F.col("event_id") % 8 == 0, F.concat(F.lit("oops "), F.col("event_id").cast("string"))).when(F.col("event_id") % 8 == 1, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).otherwise(F.to_json(fields))
    return e.select("event_id", "user_id", "ts", "project_id", body.alias("body"))


def hook_events(spark: SparkSession, d: str) -> DataFrame:
    """Every envelope as it would be stored, with content and without."""
    parsed, out = hooks.parse(envelopes(spark, d)), None
    for mode in ("redacted-content", "metadata-only"):
        kept = hooks.redact(parsed, mode).select(F.lit(mode).alias("mode"), "event_id", "hook_event_name", "known", "diagnostic", "source_session_id", "tool_name", "cwd_path", "cwd_hash", "payload_hash")
        out = kept if out is None else out.unionByName(kept)
    return out


def spool_lines(spark: SparkSession, d: str) -> DataFrame:
    """The spool's lines of d's envelopes: every tenth event twice; broken payloads are broken lines, and those that are no object have another version."""
    e = envelopes(spark, d)
    received = F.concat(F.lit("2024-01-01T"), F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))
    line = F.concat(F.lit('{"v":'), F.when(F.col("event_id") % 8 == 1, "2").otherwise("1"), F.lit(',"provenance":"hook","receivedAt":"'), received, F.lit('","payload":'), F.when(F.col("event_id") % 8 == 1, F.lit("{}")).otherwise(F.col("body")), F.lit("}"))
    copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return e.select("event_id", line.alias("value"), F.explode(copies).alias("copy"))


def spool(spark: SparkSession, d: str) -> str:
    """The spool of d's envelopes, written once for as long as the table's files and the spool stay: each task writes its own file."""
    key, state = (spark.sparkContext.applicationId, d), scratch.state_of(spark, f"{d}/events.parquet")
    if key not in _spools or _spools[key][1] != state or not scratch.exists(spark, _spools[key][0]):
        path = fresh_path(spark, "spool")
        spool_lines(spark, d).select("value").write.text(path)
        _spools[key] = (path, state)
    return _spools[key][0]


def drained(spark: SparkSession, d: str) -> tuple[str, str]:
    """The spool of d's envelopes and the table that it was drained into, made once for as long as the spool and the drained table stay."""
    key, path = (spark.sparkContext.applicationId, d), spool(spark, d)
    if key not in _drained or _drained[key][0] != path or not scratch.exists(spark, _drained[key][1]):
        table = fresh_path(spark, "hooks")
        hooks.ingest(hooks.redact(hooks.parse(hooks.spooled(_spool(spark, path, stream=True)), sent="sent")), table, fresh_path(spark, "hooks-checkpoint"))
        _drained[key] = (path, table)
    return _drained[key]


def spool_drain(spark: SparkSession, d: str) -> DataFrame:
    """What two drains of one spool count as they go: of the even events, then of all, so that the even ones are known by then. What is left in the spool, archived, and dead."""
    inbox, table, log, dead, archive, checkpoint = (fresh_path(spark, n) for n in ("spool", "hooks", "log", "dead", "archive", "hooks-checkpoint"))
    lines, out, seen = spool_lines(spark, d), None, 0
    for run, some in (("even events", lines.where("event_id % 2 = 0")), ("all events", lines)):
        some.select("value").repartition(4).write.mode("append").text(inbox)
        hooks.drain(spark, inbox, table, checkpoint, log_path=log, dead_path=dead, glob="part-*")
        done = hooks.read_log(spark, log).where(F.col("batch") >= seen)
        counts = hooks.drained_counts(done)
        seen = done.agg(F.max("batch")).first()[0] + 1
        archived = hooks.sweep(spark, done, archive)
        left = _spool(spark, inbox).select("file").distinct().count()
        row = counts.withColumns({"left": F.lit(left).cast("long"), "archived": F.lit(archived), "run": F.lit(run)})
        out = scratch.written(row, "drain") if out is None else out.unionByName(row)
    kinds = spark.read.option("recursiveFileLookup", True).parquet(dead).groupBy("wrong").agg(F.count(F.lit(1)).alias("lines")).withColumnRenamed("wrong", "run")
    return out.unionByName(kinds, allowMissingColumns=True)


def both_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Events of each kind where all envelopes came online as well as by the spool: each is stored once, as the first delivery."""
    table, folder = fresh_path(spark, "hooks"), fresh_path(spark, "online")
    bodies = envelopes(spark, d).where("event_id % 8 > 1").select(F.col("body").alias("value"))
    bodies.write.text(folder)
    hooks.ingest(hooks.redact(hooks.parse(hooks.online(spark.readStream.text(folder)))), table, fresh_path(spark, "hooks-checkpoint"))
    hooks.drain(spark, spool(spark, d), table, fresh_path(spark, "hooks-checkpoint"), glob="part-*")
    return spark.read.parquet(table).groupBy("delivery", "hook_event_name").agg(F.count(F.lit(1)).alias("events"))


def _spool(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Spark's own writer made the spool: its files are named part-*."""
    return hooks.read_spool(spark, path, stream, glob="part-*")


def hook_stream(spark: SparkSession, d: str) -> DataFrame:
    return hooks.by_kind(spark.read.parquet(drained(spark, d)[1]))


def hook_counters(spark: SparkSession, d: str) -> DataFrame:
    path, table = drained(spark, d)
    return hooks.counters(hooks.opened(_spool(spark, path)), spark.read.parquet(table))


def recent_hooks(spark: SparkSession, d: str) -> DataFrame:
    return hooks.recent(spark.read.parquet(drained(spark, d)[1]), 20).select("received_at", "hook_event_name", "payload_hash")


def live_status(spark: SparkSession, d: str) -> DataFrame:
    """Stored events, telemetry records of the conversations, and files that no stored event came from."""
    path, table = drained(spark, d)
    stored = spark.read.parquet(table)
    return hooks.live_status(stored, spark.read.parquet(f"{d}/conversations.parquet"), hooks.backlog(spark, path, stored, glob="part-*"))


def correlated_hooks(spark: SparkSession, d: str) -> DataFrame:
    """Stored events with the session that was found for them, late; those that none fits stay."""
    a = bindings.activity(spark, d)
    stated = F.when(F.col("event_id") % 4 == 0, F.col("session_id"))
    events = a.select("event_id", F.when(F.col("event_id") % 4 < 3, F.col("project_id")).alias("project_id"), stated.alias("source_session_id"), "ts", "event_type")
    some = bindings.sessions(a).where(F.col("prompts") > 0)
    return correlation.write_back(events, correlation.correlate(events, some)).select("event_id", "event_type", "correlated_session_id", "correlation_confidence")


def stream_correlated(spark: SparkSession, d: str) -> DataFrame:
    """Events and sessions as two streams of files that are joined as they come; the best link of each event."""
    a = bindings.activity(spark, d)
    stated = F.when(F.col("event_id") % 4 == 0, F.col("session_id"))
    sides = {"events": a.select("event_id", F.when(F.col("event_id") % 4 < 3, F.col("project_id")).alias("project_id"), stated.alias("source_session_id"), "ts"), "sessions": bindings.sessions(a).select("session_id", "project_id", "started_at")}
    folders = {name: fresh_path(spark, name) for name in sides}
    for name, rows in sides.items():
        rows.write.parquet(folders[name])
    streams = {name: spark.readStream.schema(rows.schema).parquet(folders[name]) for name, rows in sides.items()}
    found = fresh_path(spark, "links")
    correlating.correlate(streams["events"], streams["sessions"], found, fresh_path(spark, "links-checkpoint"))
    return correlating.best(spark.read.schema("event_id long, tier int, started_at long, session_id string").parquet(found))


def affected_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the projects that a batch (the purchases of user 7) touches: what is analysed again."""
    a = bindings.activity(spark, d)
    s = bindings.sessions(a)
    return hooks.analyse_affected(a.where("event_type = 'purchase' and user_id = 7"), s).groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions"))


def telemetry_bodies(spark: SparkSession, d: str) -> DataFrame:
    """(kind, body): each event as a body of metrics, logs or spans by its number; every tenth comes twice, every eleventh is empty, every thirteenth has a record that is none."""
    a = bindings.activity(spark, d)
    kind = F.element_at(F.array(F.lit("metric"), F.lit("log"), F.lit("trace")), (F.col("event_id") % 3 + 1).cast("int"))
    lists = F.create_map(*(F.lit(x) for k, v in otlp.LISTS.items() for x in (k, ",".join(v))))[kind]
    part = lambda i: F.split(lists, ",")[i]
    time = F.when(kind == "trace", "startTimeUnixNano").otherwise("timeUnixNano")
    record = F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit(',"'), time, F.lit('":"'), F.col("ts").cast("string"), F.lit('000000"'), F.when(F.col("event_type") != "view", F.concat(F.lit(',"name":"'), F.col("event_type"), F.lit('"'))).otherwise(""), F.lit("}"), F.when(F.col("event_id") % 13 == 0, ",7").otherwise(""))
    body = F.concat(F.lit('{"'), part(0), F.lit('":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"x"}},{"key":"session_id","value":{"intValue":'), F.col("user_id").cast("string"), F.lit('}},{"key":"session.id","value":{"stringValue":"later"}}]},"'), part(1), F.lit('":[{"'), part(2), F.lit('":['), record, F.lit("]}]}]}"))
    copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return a.select(kind.alias("kind"), F.when(F.col("event_id") % 11 == 0, "{}").otherwise(body).alias("body"), F.explode(copies).alias("copy")).drop("copy")


def telemetry_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Records of each kind and name after a stream of bodies was stored, and what the stream counted as it went."""
    folder, table, log = (fresh_path(spark, n) for n in ("bodies", "telemetry", "log"))
    bodies = telemetry_bodies(spark, d)
    bodies.write.parquet(folder)
    otlp.ingest(spark.readStream.schema(bodies.schema).parquet(folder), table, fresh_path(spark, "telemetry-checkpoint"), log)
    rows = spark.read.parquet(table).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("session_id").alias("sessions"), F.min("ts").alias("first_ts"))
    counts = spark.read.option("recursiveFileLookup", True).parquet(log)
    names = ("bodies", "empty", "records", "skipped", "inserted")
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.sum(n).alias("records")) for n in names))
    seen = counts.agg(each.alias("c")).select(F.explode("c").alias("c")).select(F.lit("counted").alias("kind"), "c.name", "c.records", F.lit(None).cast("long").alias("sessions"), F.lit(None).cast("long").alias("first_ts"))
    return rows.unionByName(seen)


QUERIES = {
    "telemetry_ingest": telemetry_ingest,
    "hook_events": hook_events, "hook_stream": hook_stream, "hook_counters": hook_counters, "spool_drain": spool_drain, "both_deliveries": both_deliveries, "recent_hooks": recent_hooks, "live_status": live_status, "correlated_hooks": correlated_hooks, "affected_sessions": affected_sessions, "stream_correlated": stream_correlated,
}

_NAME = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
_FIELD = lambda name, value, when: f"CASE WHEN {when} THEN ',\"{name}\":' || {value} ELSE '' END"
_TOOL = "kind IN ('read', 'edit')"


def _payload(mode: str) -> str:
    hidden = mode == "metadata-only"
    prompt = "'\"[metadata-only: ' || (20 + length(CAST(event_id AS VARCHAR))) || ' chars]\"'" if hidden else "'\"use [REDACTED:password] now\"'"
    tool = "'\"[metadata-only]\"'" if hidden else "'{\"file_path\":\"[HOME]/a\",\"z\":\"' || path_hash || '\"}'"
    return f"""CASE event_id % 8 WHEN 0 THEN '{{"_malformed":"oops ' || event_id || '","hook_event_name":"unknown"}}' WHEN 1 THEN '{{"_malformed":"[' || event_id || ']","hook_event_name":"unknown"}}'
    ELSE '{{"agent_id":"' || event_id || '","cwd":"[HOME]/p' || user_id % 5 || '"' || {_FIELD("hook_event_name", "'\"' || name || '\"'", "name IS NOT NULL")} || {_FIELD("prompt", prompt, "event_type = 'signup'")} || ',"session_id":"' || user_id || '"' || {_FIELD("tool_input", tool, _TOOL)} || {_FIELD("tool_name", "'\"Read\"'", _TOOL)} || '}}' END"""


_EVENTS = f"{base.ACTIVITY}, e AS (SELECT *, event_id % 8 > 1 AS object, CASE event_id % 8 WHEN 2 THEN NULL WHEN 3 THEN 'Custom' ELSE {_NAME} END AS name FROM activity)"
_STORED = lambda mode: f"""SELECT '{mode}' AS mode, event_id, CASE WHEN object THEN coalesce(name, 'unknown') ELSE 'unknown' END AS hook_event_name, object AND coalesce(name <> 'Custom', false) AS known,
  CASE event_id % 8 WHEN 0 THEN 'hook payload is not valid JSON' WHEN 1 THEN 'hook payload is not a JSON object' WHEN 2 THEN 'missing hook_event_name' WHEN 3 THEN 'unknown hook event "Custom"' END AS diagnostic, CASE WHEN object THEN CAST(user_id AS VARCHAR) END AS source_session_id, CASE WHEN object AND {_TOOL} THEN 'Read' END AS tool_name,
  CASE WHEN object THEN '[HOME]/p' || user_id % 5 END AS cwd_path, CASE WHEN object THEN sha256('path:/home/u/p' || user_id % 5) END AS cwd_hash, sha256({_payload(mode)}) AS payload_hash FROM e"""  # noqa: E731
_KEPT = f"{_EVENTS}, stored AS ({_STORED('redacted-content')})"

ORACLE_SQL = {
    "telemetry_ingest": f"""{base.ACTIVITY}, b AS (SELECT * REPLACE (['metric', 'log', 'trace'][event_id % 3 + 1] AS kind), CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS copies, event_id % 11 = 0 AS hollow FROM activity),
  r AS (SELECT *, CASE WHEN event_type <> 'view' THEN event_type WHEN kind = 'log' THEN 'log' END AS name FROM b WHERE NOT hollow)
  SELECT kind, name, count(*) AS records, count(DISTINCT user_id) AS sessions, min(ts) AS first_ts FROM r GROUP BY 1, 2 UNION ALL SELECT 'counted', 'bodies', sum(copies)::BIGINT, NULL, NULL FROM b UNION ALL SELECT 'counted', 'empty', sum(copies) FILTER (hollow)::BIGINT, NULL, NULL FROM b
  UNION ALL SELECT 'counted', 'records', sum(copies)::BIGINT, NULL, NULL FROM r UNION ALL SELECT 'counted', 'skipped', coalesce(sum(copies) FILTER (event_id % 13 = 0), 0)::BIGINT, NULL, NULL FROM r UNION ALL SELECT 'counted', 'inserted', count(*), NULL, NULL FROM r""",
    "hook_events": f"{_EVENTS} {_STORED('redacted-content')} UNION ALL {_STORED('metadata-only')}",
    "hook_stream": f"{_KEPT} SELECT hook_event_name, count(*) AS events FROM stored WHERE event_id % 8 > 1 GROUP BY 1",
    "hook_counters": "SELECT count(*) + count(*) FILTER (event_id % 10 = 0) AS received, count(*) FILTER (event_id % 8 > 1) AS inserted, count(*) FILTER (event_id % 8 > 1 AND event_id % 10 = 0) AS deduplicated, count(*) FILTER (event_id % 8 < 2) + count(*) FILTER (event_id % 8 < 2 AND event_id % 10 = 0) AS skipped FROM events",
    "spool_drain": f"""WITH l AS (SELECT event_id, unnest(CASE WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM events), good AS (SELECT *, event_id % 8 > 1 AS good FROM l)
  SELECT 'even events' AS run, 4::BIGINT AS files, count(*) AS lines, count(*) FILTER (good) AS events, count(*) FILTER (NOT good) AS broken, count(DISTINCT event_id) FILTER (good) AS inserted, count(*) FILTER (good) - count(DISTINCT event_id) FILTER (good) AS deduplicated, 0::BIGINT AS left, 4 AS archived FROM good WHERE event_id % 2 = 0
  UNION ALL SELECT 'all events', 4, count(*), count(*) FILTER (good), count(*) FILTER (NOT good), count(DISTINCT event_id) FILTER (good AND event_id % 2 = 1), count(*) FILTER (good) - count(DISTINCT event_id) FILTER (good AND event_id % 2 = 1), 0, 4 FROM good
  UNION ALL SELECT CASE event_id % 8 WHEN 0 THEN 'not JSON' ELSE 'another version' END, NULL, sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL FROM good WHERE NOT good GROUP BY 1""",
    "both_deliveries": f"{_KEPT} SELECT 'online' AS delivery, hook_event_name, count(*) AS events FROM stored WHERE event_id % 8 > 1 GROUP BY 2",
    "recent_hooks": f"{_KEPT} SELECT '2024-01-01T' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':00:00Z' AS received_at, hook_event_name, payload_hash FROM stored WHERE event_id % 8 > 1 ORDER BY received_at DESC, payload_hash LIMIT 20",
    "live_status": "SELECT (SELECT count(*) FROM events WHERE event_id % 8 > 1) AS hook_events, (SELECT count(*) FROM conversations) AS telemetry_events, 0::BIGINT AS pending",
    "correlated_hooks": base.ORACLE_SQL["correlated_events"].replace("FROM e JOIN sessions s", "FROM e JOIN begun s").replace("FROM sessions GROUP BY 1) s", "FROM begun GROUP BY 1) s").replace(", e AS (", ", begun AS (SELECT * FROM sessions WHERE prompts > 0), e AS (", 1).replace(
        "SELECT event_id, arg_min(session_id, (tier, started_at, session_id)) AS session_id, [1.0", ", b AS (SELECT event_id, arg_min(session_id, (tier, started_at, session_id)) AS correlated_session_id, [1.0"
    ).replace("AS confidence FROM c GROUP BY 1", "AS correlation_confidence FROM c GROUP BY 1) SELECT event_id, event_type, correlated_session_id, correlation_confidence FROM activity LEFT JOIN b USING (event_id)"),
    "stream_correlated": f"""{base.SESSIONS}, e AS (SELECT event_id, CASE WHEN event_id % 4 < 3 THEN project_id END AS project_id, CASE WHEN event_id % 4 = 0 THEN session_id END AS stated, ts FROM activity),
  l AS (SELECT event_id, 1 AS tier, started_at, s.session_id FROM e JOIN sessions s ON e.stated = s.session_id WHERE abs(started_at - ts) <= 604800000 UNION ALL SELECT event_id, 2, started_at, s.session_id FROM e JOIN sessions s ON e.project_id = s.project_id AND abs(started_at - ts) <= 3600000)
  SELECT event_id, arg_min(session_id, (tier, started_at, session_id)) AS session_id, CASE min(tier) WHEN 1 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM l GROUP BY 1""",
    "affected_sessions": f"{base.SESSIONS} SELECT project_id, count(*) AS sessions FROM sessions WHERE project_id IN (SELECT project_id FROM activity WHERE event_type = 'purchase' AND user_id = 7) GROUP BY 1",
}
