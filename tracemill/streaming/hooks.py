"""Hook events: envelopes parsed, stripped, redacted, and stored once for each payload, as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.functions import text

# The events that are known, the fields that hold content, and how much of a malformed payload is kept.
KNOWN_EVENTS = (
    "SessionStart UserPromptSubmit PreToolUse PermissionRequest PermissionDenied PostToolUse PostToolUseFailure PostToolBatch SubagentStart SubagentStop TaskCreated TaskCompleted Stop StopFailure"
    " TeammateIdle InstructionsLoaded ConfigChange CwdChanged FileChanged Notification MessageDisplay PreCompact PostCompact SessionEnd"
).split()
CONTENT_FIELDS = ("prompt", "tool_input", "tool_response", "message", "last_assistant_message")
MALFORMED_CHARS = 4096
FIELDS = {"source_session_id": "session_id", "prompt_id": "prompt_id", "transcript_path": "transcript_path", "cwd": "cwd", "permission_mode": "permission_mode", "tool_name": "tool_name", "prompt": "prompt", "agent_id": "agent_id", "agent_type": "agent_type"}
MODES = ("metadata-only", "redacted-content", "full-local")
HOME = "/home/u"
#: Stored rows lie in folders by the first digits of their payload hash, so that a batch reads only those of its own.
PREFIX = 2
#: So many rows touch nearly every folder (of 256, all but 0.1 on average): the table is then read whole, and the batch is not made a second time to tell which.
MANY = 2_048


def parse(events: DataFrame, body: str = "body", sent: str | None = None) -> DataFrame:
    """events with their payload parsed: payload (variant), hook_event_name, known, the columns of FIELDS, diagnostic.

    What isn't a JSON object becomes an event called unknown that holds the first
    MALFORMED_CHARS characters; an event of another name keeps it. Fields of
    another type than text count as absent. sent: the column that has the body
    as variant already, as spooled() gives it; it goes.
    """
    out = events.withColumn("_parsed", F.expr(f"try_parse_json({body})") if sent is None else F.col(sent))
    out = out.withColumn("_object", F.coalesce(F.schema_of_variant("_parsed").like("OBJECT%"), F.lit(False)))
    opaque = F.parse_json(F.to_json(F.struct(F.substring(body, 1, MALFORMED_CHARS).alias("_malformed"), F.lit("unknown").alias("hook_event_name"))))
    out = out.withColumn("payload", F.when(F.col("_object"), F.col("_parsed")).otherwise(opaque))
    said = lambda path: F.expr(f"case when schema_of_variant(try_variant_get(payload, '$.{path}', 'variant')) = 'STRING' then try_variant_get(payload, '$.{path}', 'string') end")
    broken = F.when(F.col("_parsed").isNull(), "hook payload is not valid JSON").when(~F.col("_object"), "hook payload is not a JSON object")
    out = out.withColumns({"_name": said("hook_event_name"), "diagnostic": broken} | {c: said(p) for c, p in FIELDS.items()})
    name, known = F.col("_name"), F.col("hook_event_name").isin(KNOWN_EVENTS)
    unnamed = F.when(name.isNull(), "missing hook_event_name").when(~known, F.concat(F.lit('unknown hook event "'), name, F.lit('"')))
    out = out.withColumn("hook_event_name", F.coalesce(name, F.lit("unknown")))
    return out.withColumns({"known": known, "diagnostic": F.coalesce("diagnostic", unnamed)}).drop("_parsed", "_object", "_name", *([sent] if sent else []))


def stable_json(payload: Column, mode: str = "redacted-content") -> Column:
    """A payload as JSON with keys in order; metadata-only states how long content is instead of it."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    length = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.concat(F.lit('"[metadata-only: '), F.length(F.try_variant_get(v, "$", "string")).cast("string"), F.lit(' chars]"'))).otherwise(F.lit('"[metadata-only]"'))
    shown = lambda fields, k: F.when(k.isin(*CONTENT_FIELDS) & F.lit(mode == "metadata-only"), length(fields[k])).otherwise(F.coalesce(F.to_json(fields[k]), F.lit("null")))
    key = lambda k: F.btrim(F.to_json(F.array(k)), F.lit("[]"))
    members = lambda fields: F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(key(k), F.lit(":"), shown(fields, k)))
    return F.concat(F.lit("{"), F.array_join(text.let(payload.cast("map<string, variant>"), members), ","), F.lit("}"))


def redact(parsed: DataFrame, mode: str = "redacted-content", home: str = HOME, emails: bool = False, body: str = "body") -> DataFrame:
    """parsed() events ready to be stored: payload_json without secrets and folders, payload_hash, cwd_path and cwd_hash; what holds content otherwise is dropped.

    The hash is over the redacted payload, so that when an event was received is
    no part of it. Text that is no JSON after redaction is kept within {redacted}.
    The body as it came goes too. What several expressions name is a column
    first, so that it is made once; the detectors are one function of a text,
    since as code of a whole stage they are a method too large to be compiled.
    """
    made = parsed.withColumn("_json", stable_json(F.col("payload"), mode)).withColumn("_full", text.clean_path(F.col("cwd")))
    clean = text.let(F.col("_json"), lambda t: text.let(F.lower(t), lambda lowered: text.redact(t, emails, home=home, lowered=lowered)))
    kept = made.withColumns({"redacted": clean, "cwd_path": text.shown_path(F.col("_full"), home), "cwd_hash": F.sha2(F.concat(F.lit("path:"), "_full"), 256)}).withColumn("payload_hash", F.sha2("redacted", 256))
    valid = F.when(~F.col("redacted").contains("[REDACTED:") | F.expr("try_parse_json(redacted)").isNotNull(), F.col("redacted")).otherwise(F.to_json(F.struct("redacted")))  # only what a detector replaces can break it
    return kept.withColumn("payload_json", valid).drop("payload", "_json", "_full", "redacted", "prompt", "transcript_path", "cwd", body)


def stored(spark: SparkSession, table_path: str, hashes: DataFrame | None = None) -> DataFrame | None:
    """The table, or what of it may hold the hashes; nothing if it isn't there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    table = spark.read.parquet(table_path)
    if hashes is not None:
        prefixes = [r[0] for r in hashes.select(_prefix()).limit(MANY).collect()]
        if len(prefixes) < MANY:
            table = table.where(F.col("prefix").isin(sorted(set(prefixes))))
    return table


def _prefix() -> Column:
    return F.concat(F.lit("h"), F.substring("payload_hash", 1, PREFIX))


def insert_new(batch: DataFrame, table_path: str) -> int:
    """Append the rows of batch whose payload_hash the table lacks, one for each; a batch that runs again adds nothing. How many went in, counted as they are written."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["payload_hash"])
    if (known := stored(spark, table_path, batch)) is not None:
        fresh = fresh.join(known.select("payload_hash"), "payload_hash", "left_anti")
    seen = Observation()
    dealt = fresh.withColumn("prefix", _prefix()).repartition("prefix")  # a file for each folder, not one from every task
    dealt.observe(seen, F.count(F.lit(1)).alias("inserted")).write.mode("append").partitionBy("prefix").parquet(table_path)
    return seen.get["inserted"]


def ingest(stream: DataFrame, table_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run stream (columns payload_hash, ...) into a Parquet table, once for each hash: what is there, or, with every ("2 seconds"), on and on.

    There is no state but the table: the anti join with it leaves out what was
    stored, a batch that runs again included, however late it or its copy is.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, _: insert_new(batch, table_path)).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def opened(lines: DataFrame) -> DataFrame:
    """lines (value, JSON) with what an envelope holds: body, the same as variant (sent), received_at, delivery and wrong, which is null for an envelope that can be read."""
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    v = text.once(text.once(lines, v=F.expr("try_parse_json(value)")), sent=get("payload", "variant"))
    wrong = F.when(F.col("v").isNull(), "not JSON").when(~F.coalesce(get("v", "int") == 1, F.lit(False)), "another version").when(F.col("sent").isNull() | F.is_variant_null("sent"), "no payload")
    return v.withColumns({"body": F.to_json("sent"), "received_at": get("receivedAt", "string"), "delivery": F.lit("spool"), "wrong": wrong}).drop("v")


def spooled(lines: DataFrame) -> DataFrame:
    """Events of spool envelopes (column value, JSON): body, sent, received_at and delivery. Envelopes of another version or without a payload, and what isn't JSON, give nothing: see opened()."""
    return opened(lines).where("wrong is null").drop("value", "wrong")


def online(bodies: DataFrame, body: str = "value") -> DataFrame:
    """Events of payloads as they are delivered (a stream of any source, say a topic): body, received_at (when Spark took it) and delivery. ingest() stores each once, however it came."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return bodies.select(F.col(body).cast("string").alias("body"), now.alias("received_at"), F.lit("online").alias("delivery"))


def read_spool(spark: SparkSession, path: str, stream: bool = False, glob: str = "[!.]*.json*") -> DataFrame:
    """Lines of the files below path whose name the pattern fits (by default *.json, but for those that begin with a dot), with their file."""
    reader = spark.readStream if stream else spark.read
    options = {"pathGlobFilter": glob, "recursiveFileLookup": "true"}
    return reader.format("text").options(**options).load(path).select("value", F.col("_metadata.file_path").alias("file"))


def backlog(spark: SparkSession, path: str, drained: DataFrame, glob: str = "[!.]*.json*") -> DataFrame:
    """Files of the spool that no drained event names: how many are pending."""
    files = read_spool(spark, path, glob=glob).select("file").distinct()
    return files.join(drained.select("file").distinct(), "file", "left_anti").agg(F.count(F.lit(1)).alias("pending"))


def drain(spark: SparkSession, path: str, table_path: str, checkpoint: str, mode: str = "redacted-content", every: str | None = None, log_path: str | None = None, dead_path: str | None = None, glob: str = "[!.]*.json*") -> StreamingQuery:
    """The spool into the table; the checkpoint tells which files are done, so that a failed batch is tried again.

    With log_path each batch leaves a row for each file: lines, events, broken;
    and with them what the batch inserted. With dead_path broken lines are kept,
    redacted, with what is wrong. Both are folders by batch, which a batch that
    is tried again replaces.
    """
    def run(batch: DataFrame, number: int) -> None:
        held = opened(batch)
        if dead_path or log_path:  # else it is read once
            held.persist()
        inserted = insert_new(redact(parse(held.where("wrong is null").drop("value", "wrong"), sent="sent"), mode), table_path)
        if dead_path:
            dead = held.where("wrong is not null").select("file", "wrong", text.redact(F.col("value")).alias("line"))
            dead.write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        if log_path:
            files = held.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("wrong").isNull()).alias("events"), F.count("wrong").alias("broken"))
            files.withColumns({"batch": F.lit(number).cast("long"), "inserted": F.lit(inserted).cast("long")}).write.mode("overwrite").parquet(f"{log_path}/batch-{number}")
        held.unpersist()

    writer = read_spool(spark, path, stream=True, glob=glob).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(log_path)


def drained_counts(log: DataFrame) -> DataFrame:
    """Files, lines, events, broken lines, and events inserted and deduplicated, of a log of drain(); no count of the table is made for it."""
    batches = log.groupBy("batch").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("events").alias("events"), F.sum("broken").alias("broken"), F.max("inserted").alias("inserted"))
    names = ("files", "lines", "events", "broken", "inserted")
    return batches.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).withColumn("deduplicated", F.col("events") - F.col("inserted"))


def sweep(spark: SparkSession, log: DataFrame, archive: str | None = None) -> int:
    """Remove the spool's files that a log of drain() names, into the folder archive if given; how many. Call it when the query has ended: its checkpoint then knows them."""
    jvm, gone = spark._jvm, 0
    for r in log.select("file").distinct().toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["file"]))
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if archive is None:
            gone += fs.delete(at, False)
        else:
            to = jvm.org.apache.hadoop.fs.Path(archive)
            fs.mkdirs(to)
            gone += fs.rename(at, jvm.org.apache.hadoop.fs.Path(to, at.getName()))
    return gone


def counters(received: DataFrame, table: DataFrame) -> DataFrame:
    """Deliveries received, inserted, deduplicated and skipped, of the lines of opened() and the table they went into: each is read once."""
    out = received.agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("wrong").isNull()).alias("valid")).join(table.agg(F.count(F.lit(1)).alias("inserted")))
    return out.select("received", "inserted", (F.col("valid") - F.col("inserted")).alias("deduplicated"), (F.col("received") - F.col("valid")).alias("skipped"))


def recent(table: DataFrame, most: int = 50) -> DataFrame:
    """The events received last, 200 at most (a top-k)."""
    return table.orderBy(F.desc("received_at"), "payload_hash").limit(min(200, max(1, most)))


def of_session(table: DataFrame, source_session_id: str) -> DataFrame:
    """A session's events in order of receipt."""
    return table.where(F.col("source_session_id") == source_session_id).orderBy("received_at", "payload_hash")


def by_kind(table: DataFrame) -> DataFrame:
    return table.groupBy("hook_event_name").agg(F.count(F.lit(1)).alias("events"))


def live_status(hooks: DataFrame, telemetry: DataFrame, pending: DataFrame) -> DataFrame:
    """Stored events and the spool's backlog, in one row."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("one", F.lit(1))
    return n(hooks, "hook_events").join(n(telemetry, "telemetry_events"), "one").join(pending.withColumn("one", F.lit(1)), "one").drop("one")


def analyse_affected(batch: DataFrame, sessions: DataFrame, keys: str = "project_id") -> DataFrame:
    """Sessions of the scopes that a batch of correlated events touches: what has to be analysed again."""
    touched = sessions.join(batch.select("session_id").distinct(), "session_id", "left_semi").select(keys).distinct()
    return sessions.join(touched, keys, "left_semi")
