"""Session-analytics tables derived from the given star schema.

Times are milliseconds since 1970 as long, so that no result depends on a
session's time zone. DUCKDB states the same tables for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEEK_MS = 604_800_000
EPOCH_MS = 1_704_067_200_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(col: str) -> F.Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({col} as timestamp_ntz))")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users did: a session is a user's week, a project one of ten."""
    kind = F.create_map(*(F.lit(x) for kv in {"signup": "prompt", "view": "read", "click": "edit", "purchase": "verify", "error": "verify"}.items() for x in kv))
    e = _table(spark, sf_dir, "events").withColumn("ts", _ms("ts"))
    return e.select(
        F.concat_ws(":", "user_id", F.floor(F.col("ts") / WEEK_MS)).alias("session_id"), (F.col("user_id") % 10).alias("project_id"), "user_id", "event_id", "ts",
        kind[F.col("event_type")].alias("kind"), "event_type", (F.col("event_type") != "error").alias("success"), F.sha2(F.concat(F.lit("path:"), "props"), 256).alias("path_hash"),
        F.col("props").alias("path"), F.round(F.col("value") * 100).cast("long").alias("size"),
    )


def sessions(events: DataFrame) -> DataFrame:
    """A row for each session of activity(), with its counters and completion."""
    return events.groupBy("session_id", "project_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), (F.max("ts") - F.min("ts")).alias("duration_ms"),
        F.count_if(F.col("kind") == "prompt").alias("prompts"), F.count_if(F.col("kind") != "prompt").alias("tool_calls"),
        F.count_if(F.col("event_type") == "error").alias("compactions"),
        completion(F.max_by("event_type", F.struct("ts", "event_id"))).alias("completion"),
    )


def completion(last: F.Column) -> F.Column:
    """How a session ended, by the type of its last event."""
    return F.when(last == "error", "failed").when(last == "purchase", "completed").otherwise("interrupted")


def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model request for each line item: the session is the order."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 10).alias("project_id"), _ms("o_orderdate").alias("ts"))
    model = F.when(F.col("l_returnflag") == "A", "north-large").when(F.col("l_returnflag") == "R", "north-small-20240101").when(F.col("l_linestatus") == "O", "delta-mid").otherwise("unlisted-1")
    cached = F.col("l_discount") > 0
    return _table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("session_id"), "project_id", "ts", F.col("l_linenumber").alias("request_no"), model.alias("model_id"),
        (F.col("l_quantity").cast("long") * 100).alias("input_tokens"), (F.floor("l_extendedprice") % 5000).alias("output_tokens"),
        F.when(cached, F.round(F.col("l_discount") * 100).cast("long") * 500).alias("cache_read_tokens"), F.when(cached, F.round(F.col("l_tax") * 100).cast("long") * 40).alias("cache_write_tokens"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations, numbered within their session."""
    turns = _table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select(
        F.col("conv_id").alias("session_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("sequence"), F.col("text").alias("content"),
        (F.lit(EPOCH_MS) + F.col("conv_id") * 3_600_000 + F.col("turn") * 1000).alias("ts"),
    )


VERBS = ["npm run build", "npx vitest", "/usr/bin/git commit -m", "CI=1 pnpm lint .", "tsc --noEmit", "prettier --all", "npm audit", "yarn add", "node server start", "ls -la", "pytest test", "make compile"]
FOLDERS = ["/app/.env", "/home/u/.ssh", "/srv/.gnupg", "/app/src", "/home/u/.aws/credentials", "/app/server.pem", "/app/secrets.d", "/home/u/.npmrc"]


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell commands made up from the part table."""
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (F.col("p_partkey") % len(VERBS) + 1).cast("int"))
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("command_id"), F.concat_ws(" ", verb, F.translate("p_name", " ", "_")).alias("command"), (F.col("p_size") % 3 != 0).alias("success"), (F.col("p_partkey") % 97).alias("session_id"), (F.col("p_partkey") % 10).alias("project_id"), F.col("p_partkey").alias("ts"),
    )


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were worked on: pages' paths under folders, some of which hold secrets."""
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("page_id") % len(FOLDERS) + 1).cast("int"))
    inner = F.concat(folder, F.lit("/../"), F.regexp_extract(folder, "([^/]+)$", 1), F.lit("/./"), F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/$", ""))
    operation = F.element_at(F.array(F.lit("read"), F.lit("edit"), F.lit("write")), (F.col("page_id") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 10).alias("project_id"), (F.col("page_id") % 50).alias("session_id"), operation.alias("operation"), F.when(F.col("page_id") % 5 == 0, folder).otherwise(inner).alias("path"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What prompts and tool inputs hold: the documents."""
    return _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).alias("project_id"), (F.col("doc_id") % 200).alias("session_id"), "text")


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for each project, from its customers."""
    n = F.count(F.lit(1))
    of = _table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 10).alias("project_id")).agg(n.alias("n"), F.sum("c_nationkey").alias("k"))
    pick = lambda c, *values: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    names = F.transform(F.sequence(F.lit(1), (F.col("k") % 7 + 1).cast("int")), lambda i: F.when(i == 3, F.lit("*/tmp")).otherwise(F.concat(F.lit("/work/p"), i.cast("string"))))
    return of.select("project_id", pick(F.col("k"), "metadata-only", "redacted-content", "full-local").alias("mode"), (F.col("k") % 600).alias("retention_days"), names.alias("excluded"), pick(F.col("k"), "127.0.0.1", "localhost", "0.0.0.0", "10.0.0.7").alias("host"), (F.col("k") % 2 == 0).alias("analysis"), pick(F.col("k"), "none", "openai-compatible", "local-model").alias("provider"))


DUCKDB = {
    "activity": """activity AS (SELECT user_id || ':' || ((epoch_us(ts) // 1000) // 604800000) AS session_id, user_id % 10 AS project_id, user_id, event_id, (epoch_us(ts) // 1000) AS ts,
  CASE event_type WHEN 'signup' THEN 'prompt' WHEN 'view' THEN 'read' WHEN 'click' THEN 'edit' ELSE 'verify' END AS kind, event_type, event_type <> 'error' AS success,
  sha256('path:' || props) AS path_hash, props AS path, CAST(round(value * 100) AS BIGINT) AS size FROM events)""",
    "sessions": """sessions AS (SELECT session_id, project_id, min(ts) AS started_at, max(ts) AS ended_at, max(ts) - min(ts) AS duration_ms, count(*) FILTER (kind = 'prompt') AS prompts,
  count(*) FILTER (kind <> 'prompt') AS tool_calls, count(*) FILTER (event_type = 'error') AS compactions,
  CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'interrupted' END AS completion FROM activity GROUP BY 1, 2)""",
    "model_requests": """model_requests AS (SELECT l_orderkey AS session_id, o_custkey % 10 AS project_id, (epoch_us(o_orderdate) // 1000) AS ts, l_linenumber AS request_no,
  CASE WHEN l_returnflag = 'A' THEN 'north-large' WHEN l_returnflag = 'R' THEN 'north-small-20240101' WHEN l_linestatus = 'O' THEN 'delta-mid' ELSE 'unlisted-1' END AS model_id,
  CAST(l_quantity AS BIGINT) * 100 AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS output_tokens,
  CASE WHEN l_discount > 0 THEN CAST(round(l_discount * 100) AS BIGINT) * 500 END AS cache_read_tokens, CASE WHEN l_discount > 0 THEN CAST(round(l_tax * 100) AS BIGINT) * 40 END AS cache_write_tokens
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "prompts": """prompts AS (SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS sequence, text AS content,
  1704067200000 + conv_id * 3600000 + turn * 1000 AS ts FROM conversations WHERE role = 'user')""",
    "commands": f"""commands AS (SELECT p_partkey AS command_id, {VERBS}[p_partkey % 12 + 1] || ' ' || replace(p_name, ' ', '_') AS command, p_size % 3 <> 0 AS success, p_partkey % 97 AS session_id, p_partkey % 10 AS project_id, p_partkey AS ts FROM part)""",
    "touched": f"""folders AS (SELECT page_id, url, {FOLDERS}[page_id % 8 + 1] AS folder FROM pages), touched AS (SELECT page_id, page_id % 10 AS project_id, page_id % 50 AS session_id, ['read', 'edit', 'write'][page_id % 3 + 1] AS operation,
  CASE WHEN page_id % 5 = 0 THEN folder ELSE rtrim(folder || '/' || regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/$', ''), '/') END AS path FROM folders)""",
    "settings": """customers AS (SELECT c_custkey % 10 AS project_id, sum(c_nationkey)::BIGINT AS k FROM customer GROUP BY 1), settings AS (SELECT project_id, k % 3 = 2 AS full_local, k % 600 AS retention_days, CASE WHEN k % 7 + 1 >= 3 THEN 1 ELSE 0 END AS broad_exclusions, k % 7 + 1 AS exclusions, k % 4 >= 2 AS beyond_loopback,
  k % 2 = 0 AND k % 3 >= 1 AS external_provider FROM customers)""",
}


def with_tables(*names: str) -> str:
    """WITH clause of the named tables, for DuckDB; sessions needs activity before it."""
    return "WITH " + ",\n".join(DUCKDB[n] for n in names)
