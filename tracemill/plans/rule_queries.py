"""Rules at both sides of their thresholds, at two grains, and when some of them fail; with SQL that doesn't come from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import rules
from tracemill.plans import queries as base
from tracemill.plans import snapshot
from tracemill.sources import bindings, scratch
from tracemill.streaming import analysis

#: What a project has where nothing is found.
QUIET = {
    "sessions": 10, "median_ms": 60_000, "prompts_per_session": 1.0, "tools_per_session": 10.0, "compactions": 0, "files_per_session": 1.0, "read_write_ratio": 1.0, "changed_unverified": 0, "narrow_only": 0, "ended_failed": 0, "changed_after_verification": 0,
    "corrective_prompts": 0, "repeated_read_top": 0, "repeated_command_top": 0, "repeated_failed_top": 0, "repeated_search_top": 0, "sum_repeated_reads": 0, "sum_repeated_searches": 0, "max_output": 0, "failure_rate": 0.0, "tests": 0, "builds": 0, "broad_tests": 0,
    "worst_tool_failures": 0, "worst_tool_rate": 0.0, "input_tokens": 40, "cache_read_tokens": 0, "prompt_count": 0, "criteria_prompts": 0, "verify_prompts": 0, "multi_prompts": 0, "vague_refs": 0, "correction_prompts": 0, "requests": 0, "dominant_cost_tier": 3,
    "dominant_capability": 3, "sensitive_ops": 0, "secret_findings": 0, "retention_days": 90, "broad_exclusions": 0, "exclusions": 0, "full_local": False, "beyond_loopback": False, "external_provider": False,
}
# Of each rule the metric that crosses its threshold (just short of it, at it, beyond), what else has to hold, and the confidence at the threshold.
SIDES = [
    ("TOOLS-001", "repeated_read_top", (2, 3, 4), {}, 0.74), ("TOOLS-002", "repeated_command_top", (2, 3, 4), {}, 0.63), ("TOOLS-003", "repeated_failed_top", (1, 2, 3), {}, 0.8), ("TOOLS-004", "broad_tests", (2, 3, 4), {}, 0.35),
    ("TOOLS-005", "max_output", (199_999, 200_000, 400_000), {}, 0.5), ("TOOLS-006", "read_write_ratio", (7.9, 8.0, 16.0), {"files_per_session": 2.0}, 0.4), ("TOOLS-007", "repeated_search_top", (2, 3, 4), {}, 0.66),
    ("TOOLS-008", "worst_tool_rate", (0.49, 0.5, 0.9), {"worst_tool_failures": 2}, 0.575), ("VERIFY-001", "changed_unverified", (0, 1, 2), {}, 0.58), ("VERIFY-002", "changed_after_verification", (0, 1, 2), {}, 0.65), ("VERIFY-003", "ended_failed", (0, 1, 2), {}, 0.7),
    ("VERIFY-004", "narrow_only", (0, 1, 2), {}, 0.4), ("VERIFY-005", "changed_unverified", (0, 1, 2), {}, 0.53), ("VERIFY-006", "files_per_session", (2.9, 3.0, 8.0), {"changed_unverified": 1}, 0.425), ("WORKFLOW-001", "corrective_prompts", (2, 3, 4), {}, 0.74),
    ("WORKFLOW-002", "median_ms", (3_599_999, 3_600_000, 7_200_000), {"prompts_per_session": 6.0}, 0.45), ("WORKFLOW-003", "files_per_session", (4.9, 5.0, 10.0), {"changed_unverified": 2}, 0.46), ("WORKFLOW-004", "tests", (4, 5, 8), {"builds": 3}, 0.5),
    ("CONTEXT-001", "compactions", (1, 2, 3), {}, 0.51), ("CONTEXT-002", "max_output", (99_999, 100_000, 400_000), {"repeated_command_top": 1}, 0.5125), ("CONTEXT-003", "cache_read_tokens", (59, 60, 360), {"compactions": 1}, 0.58),
    ("CONTEXT-004", "sum_repeated_reads", (11, 12, 18), {"files_per_session": 2.0}, 0.55), ("PROMPT-001", "criteria_prompts", (3, 2, 0), {"prompt_count": 10}, 0.7), ("PROMPT-002", "verify_prompts", (3, 2, 0), {"prompt_count": 10}, 0.65),
    ("PROMPT-003", "multi_prompts", (2, 3, 9), {"prompt_count": 10}, 0.65), ("PROMPT-004", "vague_refs", (4, 5, 10), {"prompt_count": 10}, 0.6), ("PROMPT-005", "correction_prompts", (2, 3, 6), {"prompt_count": 10}, 0.7),
    ("MODEL-001", "dominant_cost_tier", (3, 4, 5), {"requests": 3, "tools_per_session": 6.0}, 0.6), ("MODEL-002", "failure_rate", (0.29, 0.3, 0.9), {"dominant_capability": 2}, 0.39), ("MODEL-003", "dominant_capability", (3, 4, 5), {"requests": 3, "cache_read_tokens": 60}, 0.48),
    ("SECURITY-001", "sensitive_ops", (0, 1, 2), {}, 0.68), ("SECURITY-002", "secret_findings", (0, 1, 2), {}, 0.72), ("CONFIG-001", "retention_days", (365, 366, 900), {}, 0.6), ("CONFIG-002", "external_provider", (False, True, True), {}, 0.7),
]


def sided(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot for each customer: its number says which rule it is about (rule_no), and on which side of the threshold (side) it is."""
    key = F.col("c_custkey").cast("long")
    rows = spark.read.parquet(f"{d}/customer.parquet").select(key.alias("project_id"), F.pmod(key, F.lit(len(SIDES))).cast("int").alias("rule_no"), F.pmod(F.floor(key / len(SIDES)), F.lit(3)).cast("int").alias("side"))
    columns = {}
    for name, quiet in QUIET.items():
        value = F.lit(quiet)
        for i, (_, edge, values, others, _) in enumerate(SIDES):
            if edge == name:
                value = F.when(F.col("rule_no") == i, F.element_at(F.array(*map(F.lit, values)), F.col("side") + 1)).otherwise(value)
            elif name in others:
                value = F.when(F.col("rule_no") == i, F.lit(others[name])).otherwise(value)
        columns[name] = value
    return rows.withColumns(columns)


def _own(s: DataFrame) -> DataFrame:
    """project_id, side and rule_id of the rule that each snapshot is about."""
    return s.select("project_id", "side", F.element_at(F.array(*(F.lit(r[0]) for r in SIDES)), F.col("rule_no") + 1).alias("rule_id"))


def rule_sides(spark: SparkSession, d: str) -> DataFrame:
    """Of each rule and side of its threshold: projects, those in which the rule fired, and its confidence at the threshold."""
    s = sided(spark, d)
    found = rules.evaluate(s, min_confidence=0.0).select("project_id", "rule_id", "confidence")
    own = _own(s).join(found, ["project_id", "rule_id"], "left")
    return own.groupBy("rule_id", "side").agg(F.count(F.lit(1)).alias("projects"), F.count("confidence").alias("fired"), F.max(F.when(F.col("side") == 1, F.col("confidence"))).alias("confidence"))


def rules_isolated(spark: SparkSession, d: str) -> DataFrame:
    """All rules and four that can't be run: one is disabled, one names no metric, one divides by zero, one reads text as a number. What is skipped and why, and in how many of the projects that it is about each of the others fires."""
    broken = [
        rules.Rule("TOOLS-900", "low", "no_such_metric > 1", "0.5", "sessions", "x"), rules.Rule("TOOLS-901", "low", "sessions / (tests - tests) > 1", "0.5", "sessions", "x"),
        rules.Rule("TOOLS-902", "low", "sessions > 1", "cast(concat('n', sessions) as int)", "sessions", "x"), rules.Rule("TOOLS-903", "low", "sessions > 1", "0.9", "sessions", "x"),
    ]
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")  # else such expressions are null, and nothing fails
    try:
        found, skipped = rules.isolated(s := sided(spark, d), [*rules.RULES, *broken], {"TOOLS-903": {"enabled": False}}, min_confidence=0.0)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
    fired = found.join(_own(s), ["project_id", "rule_id"], "left_semi").groupBy("rule_id").agg(F.count(F.lit(1)).alias("projects")).withColumn("why", F.lit(None).cast("string"))
    return fired.unionByName(skipped.withColumn("projects", F.lit(None).cast("long")))


def scope_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What the rules that activity has metrics for find in projects and in single sessions, with fingerprints by scope."""
    found = rules.evaluate(snapshot.by_scope(bindings.activity(spark, d)), scope=("project_id", "session_id"))
    return found.withColumn("evidence", rules.evidence_text()).select("project_id", "session_id", "rule_id", "severity", "confidence", "evidence", "fingerprint")


def session_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations of one session, oldest first: the session of project 3 with most of them."""
    stored = rules.evaluate(snapshot.by_scope(bindings.activity(spark, d)), scope=("project_id", "session_id")).withColumn("created_at", F.length("rule_id") + F.pmod("project_id", F.lit(7)))
    of = stored.where("project_id = 3 and session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "session_id").limit(1).select("session_id")
    return stored.join(of, "session_id", "left_semi").orderBy("created_at", "fingerprint").select("session_id", "rule_id", "confidence", "created_at")


def consolidated(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of two runs, one of all and one of the sure ones, as one for each fingerprint, and how many there were."""
    found = rules.evaluate(snapshot.shared(spark, d), min_confidence=0.0)
    return rules.consolidate(found.unionByName(found.where(F.col("confidence") >= rules.MIN_CONFIDENCE))).select("project_id", "rule_id", "confidence", "fingerprint", "copies")


def explained_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations with what a reader is shown of them, and the first five sessions of their project."""
    found = rules.evaluate(snapshot.shared(spark, d), min_confidence=0.0)
    sessions = bindings.activity(spark, d).select("project_id", F.col("session_id").alias("reference"))
    out = rules.explained(found, sessions, 5)
    rests = F.array_join(F.transform("evidence", lambda m: m["provenance"]), ",")
    return out.select("project_id", "rule_id", "kind", "description", rests.alias("provenance"), F.array_join("references", ",").alias("references"), F.col("remediation.type").alias("remediation"), F.col("remediation.automatic").alias("automatic"))


QUERIES = {"explained_recommendations": explained_recommendations, "consolidated": consolidated, "rule_sides": rule_sides, "rules_isolated": rules_isolated, "scope_candidates": scope_candidates, "session_recommendations": session_recommendations}

_N = len(SIDES)
_LISTED = "listed(rule_no, rule_id, at_threshold) AS (VALUES " + ", ".join(f"({i}, '{r[0]}', {r[4]}::DOUBLE)" for i, r in enumerate(SIDES)) + ")"
_SIDED = f"{_LISTED}, sided AS (SELECT c_custkey AS project_id, c_custkey % {_N} AS rule_no, (c_custkey // {_N}) % 3 AS side FROM customer)"
_PATHS = "things AS (SELECT project_id, session_id, kind, path_hash, count(*) AS n, count(*) FILTER (NOT success) AS failed, max(size) AS largest, count(*) FILTER (event_type = 'error') AS errors FROM both_grains GROUP BY ALL)"
_REST = f"""{_PATHS},
kinds AS (SELECT project_id, session_id, kind, sum(n) AS calls, sum(failed) AS failures, max(largest) AS largest, sum(errors) AS errors, max(n) AS top FROM things GROUP BY ALL),
snap AS (SELECT project_id, session_id, sum(errors) AS compactions, max(largest) AS max_output, max(failures) AS worst_failures, round((arg_max(failures / calls, (failures, failures / calls))), 6) AS worst_rate, coalesce(max(top) FILTER (kind = 'read'), 0) AS reads, coalesce(max(top) FILTER (kind = 'prompt'), 0) AS searches FROM kinds GROUP BY ALL),
n AS (SELECT project_id, count(DISTINCT session_id) AS of_project FROM activity GROUP BY 1), s AS (SELECT snap.*, CASE WHEN session_id IS NULL THEN of_project ELSE 1 END AS sessions FROM snap JOIN n USING (project_id)),
hits AS (SELECT project_id, session_id, 'TOOLS-001' AS rule_id, 'medium' AS severity, least(0.9, 0.5 + 0.08 * reads)::DOUBLE AS confidence, 'occurrences=' || CAST(reads * 100 AS BIGINT) AS evidence FROM s WHERE reads >= 3
  UNION ALL SELECT project_id, session_id, 'TOOLS-005', 'medium', least(0.85, 0.5 + 0.3 * least(1, max_output / 200000 - 1))::DOUBLE, 'max_output=' || CAST(max_output * 100 AS BIGINT) FROM s WHERE max_output >= 200000
  UNION ALL SELECT project_id, session_id, 'TOOLS-007', 'low', least(0.8, 0.45 + 0.07 * searches)::DOUBLE, 'occurrences=' || CAST(searches * 100 AS BIGINT) FROM s WHERE searches >= 3
  UNION ALL SELECT project_id, session_id, 'TOOLS-008', 'medium', least(0.8, 0.4 + 0.35 * least(1, worst_failures / 4))::DOUBLE, 'worst_tool_failures=' || CAST(worst_failures * 100 AS BIGINT) || ',worst_tool_rate=' || CAST(round(round(worst_rate, 2) * 100) AS BIGINT) FROM s WHERE worst_rate >= 0.5 AND worst_failures >= 2
  UNION ALL SELECT project_id, session_id, 'CONTEXT-001', 'medium', least(0.8, 0.45 + 0.3 * least(1, compactions / sessions))::DOUBLE, 'compactions=' || CAST(compactions * 100 AS BIGINT) || ',sessions=' || sessions * 100 FROM s WHERE compactions >= 2),
found AS (SELECT project_id, session_id, rule_id, severity, round(confidence, 6) AS confidence, evidence, sha256(rule_id || '|1|' || project_id || coalesce('/' || session_id, '') || '|' || CASE rule_id WHEN 'TOOLS-001' THEN 'repeated-read' WHEN 'TOOLS-005' THEN 'oversized-output' WHEN 'TOOLS-007' THEN 'repeated-search' WHEN 'TOOLS-008' THEN 'failing-tool' ELSE 'frequent-compaction' END || '|' || evidence) AS fingerprint FROM hits WHERE round(confidence, 6) >= 0.65)"""
_SCOPED = f"""WITH {bindings.DUCKDB["activity"]}, both_grains AS (SELECT project_id, session_id, kind, path_hash, success, size, event_type FROM activity UNION ALL SELECT project_id, NULL, kind, path_hash, success, size, event_type FROM activity), {_REST}"""
_RESTS = ", ".join(f"('{r.id}', '{','.join(rules.provenance_of(x) for x in r.evidence)}')" for r in rules.RULES)
ORACLE_SQL = {
    "explained_recommendations": f"""{base.CANDIDATES}, rests(rule_id, provenance) AS (VALUES {_RESTS}), named AS (SELECT project_id, session_id, row_number() OVER (PARTITION BY project_id ORDER BY session_id) AS place FROM (SELECT DISTINCT project_id, session_id FROM activity)),
  refs AS (SELECT project_id, string_agg(session_id, ',' ORDER BY session_id) AS refs FROM named WHERE place <= 5 GROUP BY 1)
  SELECT project_id, rule_id, kind, replace(kind, '-', ' ') || ': ' || array_to_string(list_transform(string_split(evidence, ','), lambda x: split_part(x, '=', 1) || ' ' || regexp_replace(CAST(CAST(CAST(split_part(x, '=', 2) AS BIGINT) AS DECIMAL(30, 2)) / 100 AS DECIMAL(30, 2))::VARCHAR, '\\.?0+$', '')), ', ') AS description,
    provenance, coalesce(refs, '') AS "references", 'instruction' AS remediation, false AS automatic FROM candidates JOIN rests USING (rule_id) LEFT JOIN refs USING (project_id)""",
    "consolidated": f"{base.CANDIDATES} SELECT project_id, rule_id, confidence, fingerprint, CASE WHEN confidence >= {rules.MIN_CONFIDENCE} THEN 2 ELSE 1 END::BIGINT AS copies FROM candidates",
    "rule_sides": f"WITH {_SIDED} SELECT rule_id, CAST(side AS INTEGER) AS side, count(*) AS projects, count(*) FILTER (side >= 1) AS fired, max(CASE WHEN side = 1 THEN at_threshold END) AS confidence FROM sided JOIN listed USING (rule_no) GROUP BY 1, 2",
    "rules_isolated": f"WITH {_SIDED} SELECT rule_id, count(*) AS projects, NULL AS why FROM sided JOIN listed USING (rule_no) WHERE side >= 1 GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('TOOLS-900', NULL, 'UNRESOLVED_COLUMN.WITH_SUGGESTION'), ('TOOLS-901', NULL, 'DIVIDE_BY_ZERO'), ('TOOLS-902', NULL, 'CAST_INVALID_INPUT'), ('TOOLS-903', NULL, 'disabled'))",
    "scope_candidates": f"{_SCOPED} SELECT * FROM found",
    "session_recommendations": f"""{_SCOPED}, one AS (SELECT session_id FROM found WHERE project_id = 3 AND session_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT session_id, rule_id, confidence, CAST(length(rule_id) + project_id % 7 AS BIGINT) AS created_at FROM found WHERE session_id IN (SELECT session_id FROM one)""",
}


#: Of live_analysis: how long a project of the events table has to be quiet.
QUIET_MINUTES = 90


def live_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Each burst of a project's events that is over, with its events and the rules that fire in the day up to its end, from a stream of files in order of time."""
    stored = scratch.written(bindings.activity(spark, d), "live-activity")
    folder, out, checkpoint = (scratch.fresh_path(spark, f"live-{n}") for n in ("stream", "runs", "checkpoint"))
    days = stored.repartitionByRange(4, "ts").sortWithinPartitions("ts").select("project_id", "ts")
    days.write.parquet(folder)
    stream = spark.readStream.schema(days.schema).parquet(folder)
    analysis.observe(stream, lambda _: stored, out, checkpoint, quiet=f"{QUIET_MINUTES} minutes")
    if not scratch.exists(spark, out):
        return spark.createDataFrame([], "project_id long, first_ts long, last_ts long, events long, found string, recommendations int")
    found = spark.read.option("recursiveFileLookup", True).parquet(out)
    return found.select("project_id", "first_ts", "last_ts", "events", F.array_join("found", ",").alias("found"), "recommendations")


QUERIES["live_analysis"] = live_analysis
_LIVE = f"""WITH {bindings.DUCKDB["activity"].replace("activity AS", "stored AS", 1)}, gaps AS (SELECT project_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY project_id ORDER BY ts) > {QUIET_MINUTES * 60_000} AS begins FROM stored),
numbered AS (SELECT project_id, ts, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY ts) AS nth FROM gaps),
closed AS (SELECT project_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM numbered GROUP BY project_id, nth HAVING max(ts) + {QUIET_MINUTES * 60_000} <= (SELECT max(ts) FROM stored)),
activity AS (SELECT s.* REPLACE (CAST(c.first_ts AS VARCHAR) AS session_id) FROM stored s JOIN closed c ON s.project_id = c.project_id AND s.ts <= c.last_ts AND s.ts > c.last_ts - 86400000),
both_grains AS (SELECT project_id, session_id, kind, path_hash, success, size, event_type FROM activity), {_REST}"""
ORACLE_SQL["live_analysis"] = f"""{_LIVE}, r AS (SELECT project_id, CAST(session_id AS BIGINT) AS first_ts, string_agg(rule_id, ',' ORDER BY rule_id) AS found, count(*) AS n FROM found GROUP BY 1, 2)
  SELECT project_id, first_ts, last_ts, events, coalesce(found, '') AS found, CAST(coalesce(n, 0) AS INTEGER) AS recommendations FROM closed LEFT JOIN r USING (project_id, first_ts)"""
