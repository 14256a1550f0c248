"""OTLP/JSON bodies flattened to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.streaming import hooks

#: For each kind of body: its list of resources, of scopes, and of records.
LISTS = {"metric": ("resourceMetrics", "scopeMetrics", "metrics"), "log": ("resourceLogs", "scopeLogs", "logRecords"), "trace": ("resourceSpans", "scopeSpans", "spans")}
SESSION_KEYS = ("session.id", "session_id", "sessionId", "conversation.id")


def nanos_to_ms(text: Column) -> Column:
    """Milliseconds of a nanosecond count, floored; null for what is no positive number."""
    n = text.try_cast("decimal(38,0)")
    return F.when(n > 0, F.floor(n / F.lit(1_000_000)).cast("long"))


def _explode(df: DataFrame, col: str, path: str, out: str, *keep: str) -> DataFrame:
    items = F.expr(f"try_cast(try_variant_get({col}, '$.{path}', 'variant') as array<variant>)")
    return df.select(*keep, F.explode(items).alias(out))


def records(bodies: DataFrame, kind: str, *keep: str) -> DataFrame:
    """body_id, keep, session_id and record (variant) of everything in the lists of records, objects or not."""
    resources, scopes, found = LISTS[kind]
    r = _explode(bodies.withColumn("v", F.expr("try_parse_json(body)")), "v", resources, "resource", "body_id", *keep)
    attributes = F.expr("try_cast(try_variant_get(resource, '$.resource.attributes', 'variant') as array<variant>)")
    value = lambda a: F.coalesce(F.try_variant_get(a, "$.value.stringValue", "string"), F.try_variant_get(a, "$.value.intValue", "string"))
    named = F.filter(attributes, lambda a: F.coalesce(F.try_variant_get(a, "$.key", "string").isin(*SESSION_KEYS), F.lit(False)))
    r = r.withColumn("session_id", F.get(F.transform(named, value), F.lit(0)))
    s = _explode(r, "resource", scopes, "scope", "body_id", *keep, "session_id")
    return _explode(s, "scope", found, "record", "body_id", *keep, "session_id").withColumn("object", F.expr("coalesce(schema_of_variant(record) like 'OBJECT%', false)"))


def flatten(bodies: DataFrame, kind: str) -> DataFrame:
    """Records of bodies (body_id, body as JSON text): body_id, kind, name, ts, session_id, payload.

    Bodies that aren't JSON, and records that aren't objects, give no rows. A log
    without a name is called log. The session is the first of the resource's
    attributes with an accepted name, as text or number.
    """
    x = records(bodies, kind).where("object")
    name = F.coalesce(F.try_variant_get("record", "$.name", "string"), F.try_variant_get("record", "$.eventName", "string"), F.lit("log") if kind == "log" else F.lit(None).cast("string"))
    ts = nanos_to_ms(F.try_variant_get("record", "$.startTimeUnixNano" if kind == "trace" else "$.timeUnixNano", "string"))
    return x.select("body_id", F.lit(kind).alias("kind"), name.alias("name"), ts.alias("ts"), "session_id", F.to_json("record").alias("payload"))


def ingest(stream: DataFrame, table_path: str, checkpoint: str, log_path: str | None = None, every: str | None = None) -> StreamingQuery:
    """Store the records of a stream of bodies (kind, body) once each, as ingest() of hooks does with its events.

    A record is known again by its kind, session and payload. With log_path each
    batch leaves a row: bodies, empty (those without any record), records,
    skipped (no objects) and inserted.
    """
    def run(batch: DataFrame, number: int) -> None:
        held = batch.select(F.monotonically_increasing_id().alias("body_id"), "kind", F.col("body").cast("string").alias("body")).persist()
        each = [flatten(held.where(F.col("kind") == k), k) for k in LISTS]
        rows = each[0].unionByName(each[1]).unionByName(each[2]).drop("body_id")
        inserted = hooks.insert_new(rows.withColumn("payload_hash", F.sha2(F.concat_ws("|", "kind", F.coalesce("session_id", F.lit("")), "payload"), 256)), table_path)
        if log_path:
            seen = [records(held.where(F.col("kind") == k), k, "kind").select("body_id", "object") for k in LISTS]
            by_body = seen[0].unionByName(seen[1]).unionByName(seen[2]).groupBy("body_id").agg(F.count_if("object").alias("records"), F.count_if(~F.col("object")).alias("skipped"))
            counts = held.join(by_body, "body_id", "left").agg(F.count(F.lit(1)).alias("bodies"), F.count_if(F.col("records").isNull()).alias("empty"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
            counts.withColumn("inserted", F.lit(inserted).cast("long")).write.mode("overwrite").parquet(f"{log_path}/batch-{number}")
        held.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
