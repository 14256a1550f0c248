"""Further registered queries: telemetry, coaching, audits, reports, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import coaching, metrics, retention
from tracemill.plans import queries as base
from tracemill.plans import report
from tracemill.sources import bindings, otlp, transcripts

TABLES = "customer documents events lineitem orders pages part".split()


def otlp_records(spark: SparkSession, d: str) -> DataFrame:
    """Each event as an OTLP log body, flattened again."""
    a = bindings.activity(spark, d)
    body = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"x"}},{"key":"session.id","value":{"stringValue":"'), F.col("session_id"), F.lit('"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"'),
        F.col("ts").cast("string"), F.lit('000000"'), F.when(F.col("event_type") != "view", F.concat(F.lit(',"eventName":"'), F.col("event_type"), F.lit('"'))).otherwise(""), F.lit("},7]}]}]}"),
    )
    return otlp.flatten(a.select(F.col("event_id").alias("body_id"), body.alias("body")), "log").select("body_id", "kind", "name", "ts", "session_id")


def outcome_evidence(spark: SparkSession, d: str) -> DataFrame:
    return coaching.outcome_evidence(base.prompt_rows(spark, d)).withColumn("sequence", F.col("sequence").cast("long"))


def prompt_advice(spark: SparkSession, d: str) -> DataFrame:
    p = base.prompt_rows(spark, d)
    return p.select("session_id", F.col("sequence").cast("long").alias("sequence"), F.array_join(coaching.missing_components(), ",").alias("missing"), F.array_join(coaching.strengths(), ",").alias("strengths"), text.task_class().alias("task"), text.task_confidence(text.task_class()).alias("task_confidence"))


def recent_quality(spark: SparkSession, d: str) -> DataFrame:
    return coaching.mean_recent_quality(base.prompt_rows(spark, d).withColumns(text.prompt_quality()))


def findings_by_category(spark: SparkSession, d: str) -> DataFrame:
    return coaching.by_category(base.rule_candidates(spark, d))


def retention_summary(spark: SparkSession, d: str) -> DataFrame:
    a = bindings.activity(spark, d)
    tables = {"activity": a, "sessions": bindings.sessions(a)}
    gone = retention.expired(tables["sessions"], bindings.EPOCH_MS + 30 * metrics.DAY_MS, 20)
    return retention.summary(tables, retention.without(tables, gone))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.status({t: spark.read.parquet(f"{d}/{t}.parquet") for t in TABLES})


def transcript_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcript lines, read back through the parser."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    at = F.concat(F.lit("2024-01-01T00:"), F.lpad(F.pmod(F.col("conv_id"), F.lit(60)).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(F.col("turn"), F.lit(60)).cast("string"), 2, "0"), F.lit("Z"))
    record = F.struct(F.col("role").alias("type"), F.when(F.col("turn") % 3 != 1, at).alias("timestamp"), F.struct(F.col("text").alias("content")).alias("message"))
    lines = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), F.to_json(record).alias("value"))
    return transcripts.prompts(transcripts.place(transcripts.parse(lines))).select("session_id", F.col("sequence").cast("long").alias("sequence"), "ts", "content_hash", F.col("character_count").cast("long").alias("character_count"), "approximate_tokens")


QUERIES = {
    "otlp_records": otlp_records,
    "outcome_evidence": outcome_evidence,
    "prompt_advice": prompt_advice,
    "recent_quality": recent_quality,
    "findings_by_category": findings_by_category,
    "retention_summary": retention_summary,
    "status_counts": status_counts,
    "transcript_prompts": transcript_prompts,
}

_LISTED = lambda pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL), ',')"
_MISSING = [("objective", "imperatives = 0 AND length > 0"), ("target", "file_refs = 0 AND length > 0"), ("acceptanceCriteria", "NOT criteria"), ("verificationRequest", "NOT asks_verification"), ("scopeBoundary", "NOT scoped"), ("taskSplit", "multi_task")]
_STRENGTHS = [("begins with what to do", "imperatives > 0"), ("names its target", "file_refs > 0"), ("says when it is done", "criteria"), ("asks for a check", "asks_verification"), ("bounds its scope", "scoped"), ("has one aim", "length > 0 AND NOT multi_task")]
_TASK = f"CASE WHEN corrective OR reversal THEN 'debug' WHEN regexp_matches(content, '{text.REVIEW}') THEN 'review' WHEN regexp_matches(content, '{text.REFACTOR}') THEN 'refactor' WHEN imperatives > 0 THEN 'implementation' ELSE 'other' END"

ORACLE_SQL = {
    "otlp_records": f"{base.ACTIVITY} SELECT event_id AS body_id, 'log' AS kind, CASE WHEN event_type = 'view' THEN 'log' ELSE event_type END AS name, ts, session_id FROM activity",
    "outcome_evidence": f"{base.FEATURES} SELECT session_id, CAST(sequence AS BIGINT) AS sequence, coalesce(count(*) FILTER (corrective) OVER w, 0) AS later_corrections, coalesce(count(*) FILTER (reversal) OVER w, 0) AS later_reversals FROM f WINDOW w AS (PARTITION BY session_id ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)",
    "prompt_advice": f"{base.FEATURES} SELECT session_id, CAST(sequence AS BIGINT) AS sequence, {_LISTED(_MISSING)} AS missing, {_LISTED(_STRENGTHS)} AS strengths, {_TASK} AS task, CASE WHEN {_TASK} = 'other' THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END AS task_confidence FROM f",
    "recent_quality": f"""{base.QUALITY}, o AS (SELECT q.*, {base._R2("(clarity + specificity + verifiability + scope_boundedness + focus) / 5")} AS overall, ts FROM q JOIN (SELECT session_id AS s, CAST(sequence AS BIGINT) AS n, ts FROM prompts) ON s = session_id AND n = sequence ORDER BY ts DESC, session_id, sequence LIMIT 100)
  SELECT round(CAST(sum(CAST(round(overall * 100) AS BIGINT)) AS BIGINT) / count(*) / 100, 6) AS mean_overall, count(*) AS prompts FROM o""",
    "findings_by_category": f"{base.CANDIDATES} SELECT category, severity, count(*) AS findings FROM candidates GROUP BY 1, 2",
    "retention_summary": f"""{base.SESSIONS}, k AS (SELECT session_id FROM sessions WHERE NOT ended_at < 1704067200000 + 10 * 86400000::BIGINT), t AS (SELECT 'activity' AS "table", count(*) AS before, count(*) FILTER (session_id IN (SELECT session_id FROM k)) AS after FROM activity UNION ALL SELECT 'sessions', count(*), count(*) FILTER (session_id IN (SELECT session_id FROM k)) FROM sessions) SELECT *, before - after AS gone FROM t""",
    "status_counts": " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS rows FROM {t}""" for t in TABLES),
    "transcript_prompts": """WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 3 <> 1 THEN 1704067200000 + (conv_id % 60) * 60000 + (turn % 60) * 1000 END AS got FROM conversations),
  p AS (SELECT *, coalesce(got, last_value(got IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS ts FROM t)
  SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence, ts, sha256(text) AS content_hash, length(text) AS character_count, CAST(ceil(length(text) / 4) AS BIGINT) AS approximate_tokens FROM p WHERE role = 'user' AND ts IS NOT NULL""",
}
