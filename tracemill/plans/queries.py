"""Registered queries over the bound tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import baselines, coaching, correlation, costs, metrics, rules
from tracemill.operators.medians import attach
from tracemill.plans import snapshot
from tracemill.sources import bindings
from tracemill.sources.bindings import with_tables
from tracemill.sources.scratch import written

REQUESTS = with_tables("model_requests")
ACTIVITY = with_tables("activity")
SESSIONS = with_tables("activity", "sessions")
PROMPTS = with_tables("prompts")
PRICES = "prices(family, p_in, p_out, p_cr, p_cw) AS (VALUES " + ", ".join(f"('{f}', {a}::DECIMAL(10,4), {b}::DECIMAL(10,4), {c}::DECIMAL(10,4), {d}::DECIMAL(10,4))" for f, a, b, c, d in costs.DEFAULT_PRICES) + ")"
COSTED = f"""{REQUESTS}, {PRICES},
best AS (SELECT model_id, arg_max(family, (model_id = family, length(family))) AS family FROM (SELECT DISTINCT model_id FROM model_requests) JOIN prices ON starts_with(model_id, family) GROUP BY 1),
costed AS (SELECT r.*, coalesce(input_tokens, 0)::DECIMAL(18,0) * p_in + coalesce(output_tokens, 0)::DECIMAL(18,0) * p_out + coalesce(cache_read_tokens, 0)::DECIMAL(18,0) * p_cr + coalesce(cache_write_tokens, 0)::DECIMAL(18,0) * p_cw AS micro
  FROM model_requests r LEFT JOIN best USING (model_id) LEFT JOIN prices USING (family))"""
BY_MODEL = f"{COSTED}, by_model AS (SELECT model_id, count(*) AS requests, count(micro) AS costed, CAST(CAST(sum(micro) AS DECIMAL(38,4)) / 1000000 AS DECIMAL(30,6)) AS usd, CASE WHEN count(micro) < count(*) THEN 'unknown' ELSE 'registry' END AS provenance FROM costed GROUP BY 1)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return bindings.model_requests(spark, d)


def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    out = costs.cost_by_model(_requests(spark, d), costs.price_list(spark))
    return out.withColumn("usd", F.round(F.col("usd").cast("double"), 4))


def cost_total(spark: SparkSession, d: str) -> DataFrame:
    return costs.cost_total(_requests(spark, d), costs.price_list(spark)).withColumn("usd", F.round(F.col("usd").cast("double"), 4))


def repeated_reads(spark: SparkSession, d: str) -> DataFrame:
    return metrics.repeated(bindings.activity(spark, d).where("kind = 'read'"), "path_hash")


def repeated_failures(spark: SparkSession, d: str) -> DataFrame:
    return metrics.repeated(bindings.activity(spark, d).where("kind = 'verify' and not success"), "path_hash")


def paired_calls(spark: SparkSession, d: str) -> DataFrame:
    a = bindings.activity(spark, d)
    rows = a.select("session_id", F.col("user_id").alias("call_id"), F.col("kind").isin("read", "edit").alias("is_use"), "ts", "event_id")
    return metrics.pair_calls(rows)


def timeline(spark: SparkSession, d: str) -> DataFrame:
    a = bindings.activity(spark, d).withColumn("id", F.col("event_id"))
    kinds = {"prompt": 0, "edit": 3, "read": 2, "verify": 5}
    return metrics.timeline({k: (r, a.where(F.col("kind") == k)) for k, r in kinds.items()})


def carried(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, "soon").otherwise(F.col("ts").cast("string"))
    return metrics.carry_forward(bindings.activity(spark, d).select("session_id", F.col("event_id").alias("line"), raw.alias("raw_ts")))


def prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    return bindings.prompts(spark, d).withColumns(text.prompt_features(F.col("content"), F.col("sequence")))


def prompt_features(spark: SparkSession, d: str) -> DataFrame:
    p = prompt_rows(spark, d).drop("content", "ts")
    return p.withColumn("complexity", F.round("complexity", 6)).withColumns({c: F.col(c).cast("long") for c in ("imperatives", "file_refs", "vague", "length", "sequence")})


def prompt_quality(spark: SparkSession, d: str) -> DataFrame:
    return prompt_rows(spark, d).withColumns(text.prompt_quality()).select("session_id", F.col("sequence").cast("long").alias("sequence"), "clarity", "specificity", "verifiability", "scope_boundedness", "focus", "overall")


def prompt_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = prompt_rows(spark, d).withColumn("project_id", F.col("session_id") % 10)
    out = p.rollup("project_id").agg(
        F.count(F.lit(1)).alias("prompts"), F.count_if("criteria").alias("criteria"), F.count_if("asks_verification").alias("asks_verification"),
        F.count_if("multi_task").alias("multi_task"), F.count_if("corrective").alias("corrective"), F.sum("vague").cast("long").alias("vague"), F.count_if(F.col("file_refs") == 0).alias("without_refs"),
    )
    return attach(out, p.withColumn("said", F.when(F.col("length") > 0, F.col("length"))), "project_id", median_length="said")


def prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates of all prompts, cut to their first words so that some come again."""
    p = bindings.prompts(spark, d)
    return coaching.templates(p.withColumn("content", F.concat_ws(" ", F.slice(F.split(F.trim("content"), " "), 1, 1))))


def redaction(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = text.redact(F.col("text"), emails=True)
    return docs.select("doc_id", F.sha2(clean, 256).alias("redacted_sha256"), F.size(text.markers(clean)).cast("long").alias("findings"))


def secret_findings(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = docs.select("doc_id", F.explode(text.markers(text.redact(F.col("text"), emails=True))).alias("label"))
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("documents"))


def _touched(spark: SparkSession, d: str) -> DataFrame:
    t = bindings.touched(spark, d)
    shown, hashed = text.redact_path(F.col("path"), "/home/u", "/app")
    return t.withColumns({"path": shown, "path_hash": hashed})


def sensitive_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every file that was worked on, as it is shown, and the kind of secret it would hold."""
    return _touched(spark, d).select("page_id", "path", "path_hash", text.sensitive_kind(F.col("path")).alias("sensitive"))


def sensitive_access(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sensitive_access(_touched(spark, d)).withColumn("operations_seen", F.array_join("operations_seen", ","))


def secret_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers in documents (as tool inputs) and conversations (as prompts), after redaction."""
    clean = lambda df, s: df.select(s.alias("session_id"), text.redact(F.col("text"), emails=True).alias("text"))
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return metrics.secret_markers([clean(bindings.texts(spark, d), F.col("session_id")), clean(c, F.col("conv_id"))])


def command_classes(spark: SparkSession, d: str) -> DataFrame:
    return bindings.commands(spark, d).select("command_id", *(c.alias(n) for n, c in text.command_columns(F.col("command")).items()))


def correlated(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a hook that states its session one time in four."""
    a = bindings.activity(spark, d)
    stated = F.when(F.col("event_id") % 4 == 0, F.col("session_id"))
    project = F.when(F.col("event_id") % 4 < 3, F.col("project_id"))
    return correlation.correlate(a.select("event_id", project.alias("project_id"), stated.alias("source_session_id"), "ts"), written(bindings.sessions(a), "sessions"))


def session_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the bound activity: events as tool calls, files, commands and checks; a session's models by the kinds of what it did."""
    a = written(bindings.activity(spark, d), "activity")
    of = lambda *kinds: a.where(F.col("kind").isin(*kinds))
    kind = F.when(F.col("event_type") == "purchase", "unit-test").otherwise("lint")
    return baselines.session_points(
        bindings.sessions(a), of("read", "edit").select("session_id", F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model_id")), of("read", "edit", "verify"), of("read", "edit").select("session_id", F.col("kind").alias("operation")),
        of("verify").select("session_id", F.when(F.col("event_type") == "error", F.col("size")).alias("output_bytes")), of("verify").select("session_id", kind.alias("kind"), "ts", "success"), of("prompt"),
    )


def baseline_points(spark: SparkSession, d: str) -> DataFrame:
    return session_points(spark, d).withColumn("read_write_ratio", F.round("read_write_ratio", 6))


def session_baselines(spark: SparkSession, d: str) -> DataFrame:
    b = baselines.baselines(session_points(spark, d))
    return b.withColumns({"median": F.round("median", 6), "mad": F.round("mad", 6)})


def session_comparison(spark: SparkSession, d: str) -> DataFrame:
    points = written(session_points(spark, d), "points")
    out = baselines.compare(points, baselines.baselines(points))
    return out.withColumns({c: F.round(c, 6) for c in ("value", "median", "mad")})


def baseline_models(spark: SparkSession, d: str) -> DataFrame:
    a = bindings.activity(spark, d)
    requests = a.where("kind in ('read', 'edit')").select("session_id", F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model_id"))
    return baselines.model_distribution(requests, bindings.sessions(a))


def relative_durations(spark: SparkSession, d: str) -> DataFrame:
    return baselines.relative_durations(bindings.sessions(bindings.activity(spark, d)))


def _candidates(spark: SparkSession, d: str, min_confidence: float = rules.MIN_CONFIDENCE) -> DataFrame:
    return rules.evaluate(snapshot.shared(spark, d), min_confidence=min_confidence)


def rule_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What all rules find, at any confidence."""
    found = _candidates(spark, d, 0.0)
    return found.withColumn("evidence", rules.evidence_text()).select("project_id", "rule_id", "category", "severity", "confidence", "evidence", "fingerprint")


NOW_MS = bindings.EPOCH_MS + 40 * metrics.DAY_MS


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty of all projects, with ages, impacts, sessions and dismissed rules made up from the project and severity."""
    found = _candidates(spark, d)
    aged = found.withColumns({
        "updated_at": F.lit(NOW_MS) - (F.col("project_id") % 4) * metrics.DAY_MS, "impact_confidence": F.when(F.col("severity") == "high", 0.5), "references": F.transform(F.sequence(F.lit(0), (F.col("project_id") % 3).cast("int")), lambda i: i.cast("string")), "automatic": F.col("project_id") % 5 == 0,
    })
    dismissed = found.where("rule_id like '%-003'").select("rule_id")
    return rules.rank(aged, NOW_MS, dismissed)


def recommendations_by_project(spark: SparkSession, d: str) -> DataFrame:
    """The best three of each project."""
    return rules.rank(_candidates(spark, d), NOW_MS, most=3, by_project=True)


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A run of all rules onto what a run with other numbers left, a third of it dismissed; and the run's candidates."""
    have = snapshot.shared(spark, d)
    old = rules.evaluate(have.withColumn("ended_failed", F.col("ended_failed") + F.col("project_id") % 2))
    stored = old.select("fingerprint", "rule_id", "project_id", F.when(F.col("project_id") % 3 == 0, "dismissed").otherwise("active").alias("status"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"))
    found = rules.evaluate(have)
    return rules.merge(stored, found, 2), found


def recommendation_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)[0].groupBy("action", "status").agg(F.count(F.lit(1)).alias("rows"))


def recommendation_outcome(spark: SparkSession, d: str) -> DataFrame:
    return rules.outcome(_merged(spark, d)[0])


def reported_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a run that are shown: those whose row is active."""
    merged, found = _merged(spark, d)
    return rules.reported(merged, found).select("project_id", "rule_id", "fingerprint")


def recommendation_status(spark: SparkSession, d: str) -> DataFrame:
    """Rows by status after users changed some: dismissed, resolved, and some put back."""
    merged = written(_merged(spark, d)[0], "merged")
    change = lambda name, at, where: merged.where(where).select("fingerprint", F.lit(name).alias("change"), F.lit(at).cast("long").alias("at"))
    changes = change("dismiss", 3, "project_id % 4 = 1").unionByName(change("resolve", 3, "project_id % 4 = 2")).unionByName(change("restore", 4, "project_id % 4 = 3")).unionByName(change("reopen", 5, "project_id = 0"))
    after = rules.change_status(merged.drop("action", "found"), changes)
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.max("updated_at").alias("latest"))


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    """The ten active candidates of most confidence."""
    found = _candidates(spark, d).withColumn("status", F.when(F.col("project_id") % 3 == 0, "dismissed").otherwise("active"))
    return rules.opportunities(found).select("project_id", "rule_id", "confidence")


def avoidable_usage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and USD that active recommendations would save at least, with ranges made up for rules on tools."""
    found = _candidates(spark, d).withColumns({"status": F.when(F.col("project_id") % 3 == 0, "dismissed").otherwise("active"), "impact_tokens_min": F.when(F.col("category") == "tools", 100 * F.col("project_id")), "impact_usd_min": F.when(F.col("category") == "tools", F.col("project_id") * 0.25)})
    return rules.avoidable(found)


def rule_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Every rule, and in how many projects it found something."""
    hits = _candidates(spark, d, 0.0).groupBy("rule_id").agg(F.count(F.lit(1)).alias("projects"))
    listed = rules.catalogue(spark, overrides={"TOOLS-002": {"enabled": False}}).join(hits, "rule_id", "left").na.fill(0, ["projects"])
    return listed.select("rule_id", "category", "enabled", "projects")


def new_sessions_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Sessions begun on each day between the first and last, zero where none."""
    s = bindings.sessions(bindings.activity(spark, d)).groupBy(F.floor(F.col("started_at") / metrics.DAY_MS).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = s.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(s, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("sessions"))


def session_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of fifty of the failed sessions, newest first."""
    s = bindings.sessions(bindings.activity(spark, d)).where("completion = 'failed'")
    return s.orderBy(F.desc("started_at"), "session_id").offset(50).limit(50).select("session_id", "started_at", "completion")


def expired_sessions(spark: SparkSession, d: str) -> DataFrame:
    """What retention keeps of a year's first ten days: rows left by table and project."""
    a = bindings.activity(spark, d)
    cutoff = bindings.EPOCH_MS + 10 * metrics.DAY_MS
    kept = bindings.sessions(a).where(F.col("ended_at") >= cutoff)
    left = a.join(kept.select("session_id"), "session_id", "left_semi")
    return kept.groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions")).join(left.groupBy("project_id").agg(F.count(F.lit(1)).alias("events")), "project_id")


QUERIES = {
    "cost_by_model": cost_by_model, "cost_total": cost_total, "model_usage": lambda s, d: costs.model_usage(_requests(s, d)), "model_distribution": lambda s, d: costs.model_distribution(_requests(s, d)), "token_totals": lambda s, d: metrics.token_totals(_requests(s, d)),
    "usage": lambda s, d: metrics.usage(written(bindings.sessions(bindings.activity(s, d)), "sessions")), "tool_usage": lambda s, d: metrics.tool_usage(bindings.activity(s, d)), "repeated_reads": repeated_reads, "repeated_failures": repeated_failures, "workflow": lambda s, d: metrics.workflow(bindings.activity(s, d)),
    "touched_between_reads": lambda s, d: metrics.touched_between_reads(bindings.activity(s, d)), "code_changed_after": lambda s, d: metrics.code_changed_after(bindings.activity(s, d)), "carried_timestamps": carried, "paired_calls": paired_calls, "timeline": timeline,
    "prompt_features": prompt_features, "prompt_quality": prompt_quality, "prompt_metrics": prompt_metrics, "prompt_templates": prompt_templates, "redaction": redaction, "secret_findings": secret_findings, "sensitive_paths": sensitive_paths, "sensitive_access": sensitive_access, "secret_markers": secret_markers,
    "command_classes": command_classes, "correlated_events": correlated, "baseline_points": baseline_points, "session_baselines": session_baselines, "session_comparison": session_comparison, "baseline_models": baseline_models, "relative_durations": relative_durations,
    "rule_candidates": rule_candidates, "recommendations": recommendations, "recommendations_by_project": recommendations_by_project, "recommendation_merge": recommendation_merge, "recommendation_outcome": recommendation_outcome, "reported_recommendations": reported_recommendations,
    "recommendation_status": recommendation_status, "opportunities": opportunities, "avoidable_usage": avoidable_usage, "rule_catalogue": rule_catalogue, "sessions_per_day": new_sessions_per_day, "session_page": session_page, "retention": expired_sessions,
}

TOKENS = {k: f"coalesce(sum({k}_tokens), 0)" for k in costs.RATES}
FLOW = f"""{ACTIVITY}, b AS (SELECT session_id, project_id, min(ts) AS started_at, count(DISTINCT path_hash) FILTER (kind = 'edit') AS written, count(*) FILTER (kind = 'read') AS reads, count(*) FILTER (kind = 'edit') AS writes,
  min(ts) FILTER (kind = 'edit') AS first_write, max(ts) FILTER (kind = 'edit') AS last_write, count(*) FILTER (kind = 'verify') AS verifications, max(ts) FILTER (kind = 'verify') AS last_verify,
  arg_max(success, (ts, event_id)) FILTER (kind = 'verify') AS last_success, min(ts) FILTER (kind = 'verify' AND NOT success) AS first_failure, count(DISTINCT event_type) FILTER (kind = 'verify') AS verify_kinds, arg_max(event_type, (ts, event_id)) AS last_event
  FROM activity GROUP BY 1, 2),
n AS (SELECT a.session_id, min(a.ts) FILTER (kind = 'verify' AND a.ts > last_write) AS next_verify, count(*) FILTER (kind = 'prompt' AND a.ts > first_failure) AS corrective FROM activity a JOIN b USING (session_id) GROUP BY 1),
f AS (SELECT * FROM b JOIN n USING (session_id))"""
# Fixed values of the text functions as DuckDB's patterns; RE2 has no difference for these.
_Q = lambda p: "'" + p.replace("'", "''") + "'"
_HAS = lambda p: f"regexp_matches(content, {_Q(p)})"
_VERBS = ", ".join(f"'{v}'" for v in text.IMPERATIVES)
_LINES = "string_split(content, chr(10))"


def features_sql(columns: str, source: str) -> str:
    """CTEs f0 and f: the prompt features of source, with its columns."""
    return f"""f0 AS (SELECT {columns}, length(content) AS length,
  len(list_filter({_LINES}, lambda x: regexp_replace(lower(regexp_split_to_array(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s+')[1]), '[^a-z]', '', 'g') IN ({_VERBS}))) AS imperatives,
  len(list_filter({_LINES}, lambda x: regexp_matches(x, '^\\s*([-*]|\\d+[.)])\\s+\\S'))) AS items, len(list_filter(regexp_extract_all(content, '`[^`\\n]+`'), lambda x: regexp_matches(x, '[./]'))) AS file_refs,
  len(regexp_extract_all(content, {_Q(text.VAGUE)})) AS vague, len(regexp_extract_all(content, {_Q(text.CLAUSE)})) AS clauses,
  sequence > 1 AND {_HAS(text.CORRECTION)} AS corrective, {_HAS(text.ACCEPTANCE)} AS criteria, {_HAS(text.VERIFICATION)} AS asks_verification, {_HAS(text.SCOPE)} AS scoped, {_HAS(text.REVERSAL)} AS reversal FROM {source}),
f AS (SELECT *, items >= 2 OR imperatives >= 2 AS multi_task, least(1.0, (imperatives + items + least(clauses, 4)) / 6.0) AS complexity, sequence = 1 AS new_task FROM f0)"""


def redacted_sql(column: str, emails: bool = False) -> str:
    """column after all detectors."""
    for _, label, pattern in [*text.DETECTORS, *([text.EMAIL] if emails else [])]:
        column = f"regexp_replace({column}, {_Q(pattern)}, '[REDACTED:{label}]', 'g')"
    return column


FEATURES = f"{PROMPTS}, {features_sql('session_id, sequence, content', 'prompts')}"
_R2 = lambda x: f"floor(({x})::DOUBLE * 100::DOUBLE + 0.5::DOUBLE) / 100"
_D = lambda c, a, b: f"(CASE WHEN {c} THEN {a}::DOUBLE ELSE {b}::DOUBLE END)"
_U = lambda x: f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))"
_V = _U("vague / 6::DOUBLE")
_L = f"(CASE WHEN length = 0 THEN 0.2::DOUBLE ELSE {_U('least(length, 240) / 60::DOUBLE')} END)"
QUALITY = f"""{FEATURES}, q AS (SELECT session_id, CAST(sequence AS BIGINT) AS sequence, {_R2(_U(f"{_D('imperatives > 0', 1.0, 0.4)} * 0.5::DOUBLE + {_L} * 0.3::DOUBLE + (1 - {_V}) * 0.2::DOUBLE"))} AS clarity,
  {_R2(_U(f"{_U('file_refs / 2::DOUBLE')} * 0.6::DOUBLE + (1 - {_V}) * 0.4::DOUBLE"))} AS specificity, {_R2(_U(f"{_D('criteria', 0.55, 0)} + {_D('asks_verification', 0.45, 0)}"))} AS verifiability,
  {_R2(_U(f"{_D('scoped', 0.6, 0.3)} - {_D('multi_task', 0.35, 0)} + 0.1::DOUBLE"))} AS scope_boundedness, {_R2(_U(f"{_D('corrective', 0, 0.4)} + {_D('reversal', 0, 0.3)} + {_D('multi_task', 0, 0.3)}"))} AS focus FROM f)"""
_REDACTED = redacted_sql("text", emails=True)
_MARKS = "regexp_extract_all(redacted, '\\[REDACTED:([a-z0-9-]+)\\]', 1)"
_POINTS = f"""{SESSIONS}, parts AS (SELECT session_id, count(*) FILTER (kind <> 'prompt') AS calls, count(*) FILTER (event_type = 'purchase') AS tests, count(*) FILTER (kind = 'read') / nullif(count(*) FILTER (kind = 'edit'), 0) AS ratio, nullif(max(size) FILTER (event_type = 'error'), 0) AS largest,
  count(DISTINCT event_id % 4) FILTER (kind IN ('read', 'edit')) AS models, min(ts) FILTER (kind = 'verify' AND NOT success) AS first_failure FROM activity GROUP BY 1),
turns AS (SELECT session_id, count(*) FILTER (kind = 'prompt' AND ts > first_failure) AS corrective FROM activity JOIN parts USING (session_id) GROUP BY 1),
points AS (SELECT project_id, session_id, started_at, duration_ms::DOUBLE AS duration_ms, calls::DOUBLE AS tool_calls, tests::DOUBLE AS tests, ratio::DOUBLE AS read_write_ratio, largest::DOUBLE AS largest_output, compactions::DOUBLE AS compactions, models::DOUBLE AS models, corrective::DOUBLE AS corrective_turns, prompts::DOUBLE AS prompts
  FROM sessions JOIN parts USING (session_id) JOIN turns USING (session_id)),
recent AS (SELECT * FROM points ORDER BY started_at DESC, session_id DESC LIMIT {baselines.RECENT_SESSIONS}),
scoped AS (SELECT 'personal' AS scope, NULL::BIGINT AS scope_key, * FROM points UNION ALL SELECT 'project', project_id, * FROM points UNION ALL SELECT 'recent', NULL, * FROM recent)"""
_LONG = lambda table, keys: " UNION ALL ".join(f"SELECT {keys}, '{c}' AS dimension, {c} AS value FROM {table}" for c in baselines.DIMENSIONS)
_BASE = f"""{_POINTS}, long AS ({_LONG('scoped', 'scope, scope_key, session_id')}), m AS (SELECT scope, scope_key, dimension, median(value) AS median, count(value) AS n FROM long GROUP BY 1, 2, 3 HAVING count(value) > 0),
base AS (SELECT m.scope, m.scope_key, m.dimension, m.median, m.n, median(abs(value - m.median)) AS mad, CASE WHEN n = 1 THEN 'reported' ELSE 'inferred' END AS provenance FROM long p JOIN m ON p.scope = m.scope AND p.scope_key IS NOT DISTINCT FROM m.scope_key AND p.dimension = m.dimension GROUP BY ALL)"""
_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(path, {_Q(p)}) THEN '{n}'" for n, p in text.SENSITIVE_PATHS) + " END"
SHOWN = f"""{with_tables("touched")}, shown AS (SELECT * REPLACE (CASE WHEN path = '/app' OR starts_with(path, '/app/') THEN '[REPO]' || substr(path, 5) WHEN path = '/home/u' OR starts_with(path, '/home/u/') THEN '[HOME]' || substr(path, 8) ELSE path END AS path), sha256('path:' || path) AS path_hash FROM touched),
kinds AS (SELECT *, {_KINDS} AS kind FROM shown)"""
_WORDS = "string_split_regex(lower(command), '\\s+')"
_CLASSES = " ".join(f"WHEN list_has_any({_WORDS}, {verbs.split()}) THEN '{name}'" for name, verbs in text.COMMAND_CLASSES)
CLASSIFIED = f"""t AS (SELECT *, regexp_replace(list_filter(string_split_regex(trim(command), '\\s+'), lambda x: x <> '' AND NOT regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*='))[1], '^.*/', '') AS executable FROM commands),
  ran0 AS (SELECT *, CASE executable WHEN 'npx' THEN 'npm' WHEN 'pnpx' THEN 'pnpm' ELSE executable END AS family FROM t),
  ran AS (SELECT *, CASE WHEN family = 'git' THEN 'git' {_CLASSES} ELSE 'other' END AS classification, CASE WHEN regexp_matches(lower(command), {_Q(text.BROAD)}) THEN 'broad' ELSE 'narrow' END AS scope, sha256('cmd:' || lower(regexp_replace(trim({redacted_sql('command')}), '\\s+', ' ', 'g'))) AS command_hash FROM ran0)"""
_SNAPSHOT = f"""{with_tables("activity", "sessions", "model_requests", "commands", "touched", "settings")}, {CLASSIFIED}, {FLOW.split("FROM events),", 1)[-1]}, {FEATURES.removeprefix("WITH ").replace("f0 AS", "g0 AS").replace("FROM f0", "FROM g0").replace("f AS (SELECT *, items", "g AS (SELECT *, items")},
u AS (SELECT project_id, count(*) AS sessions, median(duration_ms) AS median_ms, round(sum(prompts) / count(*), 6) AS prompts_per_session, round(sum(tool_calls) / count(*), 6) AS tools_per_session, sum(compactions) AS compactions, count(*) FILTER (completion = 'completed') AS completed, count(*) FILTER (completion = 'failed') AS failed, count(*) FILTER (completion = 'interrupted') AS interrupted FROM sessions GROUP BY 1),
w AS (SELECT project_id, round(sum(written) / count(*), 6) AS files_per_session, round(sum(reads) / nullif(sum(writes), 0), 6) AS read_write_ratio, count(*) FILTER (writes > 0 AND verifications = 0) AS changed_unverified, count(*) FILTER (written >= 3 AND verify_kinds <= 1) AS narrow_only,
  count(*) FILTER (verifications > 0 AND last_success AND last_event = 'purchase') AS ended_verified, count(*) FILTER (verifications > 0 AND (NOT last_success OR last_event = 'error')) AS ended_failed, count(*) FILTER (verifications > 0 AND last_write > last_verify) AS changed_after_verification, sum(corrective) AS corrective_prompts FROM f GROUP BY 1),
pp AS (SELECT project_id, kind, path_hash, count(*) AS n FROM activity WHERE kind IN ('read', 'prompt') GROUP BY 1, 2, 3),
r AS (SELECT project_id, coalesce(max(n) FILTER (kind = 'read'), 0) AS repeated_read_top, coalesce(max(n) FILTER (kind = 'prompt'), 0) AS repeated_search_top, coalesce(sum(n) FILTER (kind = 'read' AND n >= 3), 0) AS sum_repeated_reads, coalesce(sum(n) FILTER (kind = 'prompt' AND n >= 3), 0) AS sum_repeated_searches FROM pp GROUP BY 1),
cc AS (SELECT project_id, command_hash, count(*) AS n, count(*) FILTER (NOT success) AS failed FROM ran GROUP BY 1, 2), c AS (SELECT project_id, max(n) AS repeated_command_top, max(failed) AS repeated_failed_top FROM cc GROUP BY 1),
t0 AS (SELECT project_id, kind, count(*) AS calls, count(*) FILTER (NOT success) AS failures, max(size) AS largest FROM activity GROUP BY 1, 2),
t1 AS (SELECT project_id, max(largest) AS max_output, round(sum(failures) / sum(calls), 6) AS failure_rate, max(failures) AS worst_tool_failures, round(max(failures / calls) FILTER (kind = 'verify'), 6) AS worst_tool_rate FROM t0 GROUP BY 1),
e AS (SELECT project_id, count(*) FILTER (classification = 'test') AS tests, count(*) FILTER (classification = 'build') AS builds, count(*) FILTER (classification = 'test' AND scope = 'broad') AS broad_tests FROM ran GROUP BY 1),
k AS (SELECT project_id, coalesce(sum(input_tokens), 0) AS input_tokens, coalesce(sum(cache_read_tokens), 0) AS cache_read_tokens FROM model_requests GROUP BY 1),
h AS (SELECT session_id % 10 AS project_id, count(*) AS prompt_count, count(*) FILTER (criteria) AS criteria_prompts, count(*) FILTER (asks_verification) AS verify_prompts, count(*) FILTER (multi_task) AS multi_prompts, sum(vague) AS vague_refs, count(*) FILTER (corrective) AS correction_prompts FROM g GROUP BY 1),
dn AS (SELECT project_id, model_id, count(*) AS n FROM model_requests GROUP BY 1, 2), dm AS (SELECT project_id, arg_min(model_id, (-n, model_id)) AS model_id, sum(n) AS requests FROM dn GROUP BY 1),
d AS (SELECT project_id, requests, CASE WHEN starts_with(model_id, 'north-large') THEN 5 WHEN starts_with(model_id, 'north-small') THEN 1 WHEN starts_with(model_id, 'delta-mid') THEN 3 ELSE 0 END AS dominant_cost_tier, CASE WHEN starts_with(model_id, 'north-large') THEN 5 WHEN starts_with(model_id, 'north-small') THEN 2 WHEN starts_with(model_id, 'delta-mid') THEN 3 ELSE 0 END AS dominant_capability FROM dm),
so AS (SELECT project_id, path, count(*) AS n FROM touched WHERE {_KINDS} IS NOT NULL GROUP BY 1, 2), s2 AS (SELECT project_id, max(n) AS sensitive_ops FROM so GROUP BY 1),
sf AS (SELECT doc_id % 10 AS project_id, sum(len(regexp_extract_all({_REDACTED}, '\\[REDACTED:([a-z0-9-]+)\\]', 1)))::BIGINT AS secret_findings FROM documents GROUP BY 1),
snap AS (SELECT u.*, w.* EXCLUDE (project_id), r.* EXCLUDE (project_id), c.* EXCLUDE (project_id), t1.* EXCLUDE (project_id), e.* EXCLUDE (project_id), k.* EXCLUDE (project_id), h.* EXCLUDE (project_id), d.* EXCLUDE (project_id), s2.* EXCLUDE (project_id), sf.* EXCLUDE (project_id), settings.* EXCLUDE (project_id)
  FROM u LEFT JOIN w USING (project_id) LEFT JOIN r USING (project_id) LEFT JOIN c USING (project_id) LEFT JOIN t1 USING (project_id) LEFT JOIN e USING (project_id) LEFT JOIN k USING (project_id) LEFT JOIN h USING (project_id) LEFT JOIN d USING (project_id) LEFT JOIN s2 USING (project_id) LEFT JOIN sf USING (project_id) LEFT JOIN settings USING (project_id))"""
NUMBERS = (
    "sessions median_ms prompts_per_session tools_per_session compactions completed failed interrupted files_per_session read_write_ratio changed_unverified narrow_only ended_verified ended_failed changed_after_verification corrective_prompts repeated_read_top repeated_command_top"
    " repeated_failed_top repeated_search_top sum_repeated_reads sum_repeated_searches max_output failure_rate tests builds broad_tests worst_tool_failures worst_tool_rate input_tokens cache_read_tokens prompt_count criteria_prompts verify_prompts multi_prompts vague_refs"
    " correction_prompts requests dominant_cost_tier dominant_capability sensitive_ops secret_findings retention_days broad_exclusions exclusions"
).split()
_ZEROED = "z AS (SELECT project_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in NUMBERS) + ", " + ", ".join(f"coalesce({c}, false) AS {c}" for c in snapshot.FLAGS) + " FROM snap)"
_METRIC = lambda label, sql: f"'{label}=' || coalesce(CAST(CAST(round(round(CAST({sql} AS DOUBLE), 2) * 100) AS BIGINT) AS VARCHAR), '-')"


def candidates_sql(name: str, source: str) -> str:
    """CTE of what all rules find in source, with evidence and fingerprint."""
    found = " UNION ALL ".join(
        f"SELECT project_id, '{r.id}' AS rule_id, '{r.category}' AS category, {r.severity_sql} AS severity, round(CAST({r.filled(r.confidence)} AS DOUBLE), 6) AS confidence, '{r.kind}' AS kind, {' || chr(44) || '.join(_METRIC(label, sql) for label, sql in r.evidence.items())} AS evidence, {r.filled(r.evidence['occurrences']) if 'occurrences' in r.evidence else 0} AS occurrences FROM {source} WHERE {r.filled(r.trigger)}"
        for r in rules.RULES
    )
    return f"{name} AS (SELECT *, sha256(rule_id || '|1|' || project_id || '|' || kind || '|' || evidence) AS fingerprint FROM ({found}))"


CANDIDATES = f"{_SNAPSHOT}, {_ZEROED}, {candidates_sql('candidates', 'z')}"
_SURE = f"confidence >= {rules.MIN_CONFIDENCE}"
_MERGED = f"""{CANDIDATES}, z2 AS (SELECT * REPLACE (ended_failed + project_id % 2 AS ended_failed) FROM z), {candidates_sql('earlier', 'z2')}, stored AS (SELECT fingerprint, rule_id, project_id, CASE WHEN project_id % 3 = 0 THEN 'dismissed' ELSE 'active' END AS status FROM earlier WHERE {_SURE}),
  found AS (SELECT fingerprint, rule_id, project_id FROM candidates WHERE {_SURE}), fresh AS (SELECT DISTINCT rule_id, project_id FROM found WHERE fingerprint NOT IN (SELECT fingerprint FROM stored)),
  merged AS (SELECT fingerprint, rule_id, project_id, CASE WHEN fingerprint IN (SELECT fingerprint FROM found) THEN CASE status WHEN 'active' THEN 'touched' ELSE 'retained' END WHEN status = 'active' AND (rule_id, project_id) IN (SELECT (rule_id, project_id) FROM fresh) THEN 'superseded' ELSE 'retained' END AS action,
    CASE WHEN status = 'active' AND fingerprint NOT IN (SELECT fingerprint FROM found) AND (rule_id, project_id) IN (SELECT (rule_id, project_id) FROM fresh) THEN 'superseded' ELSE status END AS status, fingerprint IN (SELECT fingerprint FROM found) AS known FROM stored
    UNION ALL SELECT fingerprint, rule_id, project_id, 'inserted', 'active', true FROM found WHERE fingerprint NOT IN (SELECT fingerprint FROM stored))"""
_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.SEVERITY_WEIGHT.items()) + " END"

ORACLE_SQL = {
    "command_classes": f"{with_tables('commands')}, {CLASSIFIED} SELECT command_id, executable, family, classification, scope, command_hash FROM ran",
    "cost_by_model": f"{BY_MODEL} SELECT * REPLACE (round(usd::DOUBLE, 4) AS usd) FROM by_model",
    "cost_total": f"{BY_MODEL} SELECT round(sum(usd)::DOUBLE, 4) AS usd, CASE WHEN count(usd) > 0 THEN 'registry' ELSE 'unknown' END AS methodology, round(count(usd) / sum(requests), 9) AS confidence FROM by_model",
    "model_usage": f"{REQUESTS} SELECT model_id, count(DISTINCT session_id) AS sessions, count(*) AS requests, {', '.join(f'CAST({v} AS BIGINT) AS {k}_tokens' for k, v in TOKENS.items())} FROM model_requests GROUP BY 1",
    "model_distribution": f"{REQUESTS}, n AS (SELECT project_id, model_id, count(*) AS requests FROM model_requests GROUP BY 1, 2) SELECT *, round(requests / sum(requests) OVER (PARTITION BY project_id), 4) AS share FROM n",
    "token_totals": f"{REQUESTS} SELECT project_id, {', '.join(f'CAST({v} AS BIGINT) AS {k}_tokens' for k, v in TOKENS.items())}, CAST({' + '.join(TOKENS.values())} AS BIGINT) AS total_tokens, count(*) FILTER (cache_read_tokens IS NULL) AS without_cache_tokens FROM model_requests GROUP BY ROLLUP (project_id)",
    "usage": f"""{SESSIONS}, d AS (SELECT project_id, count(*) AS sessions, greatest(count(DISTINCT started_at // 86400000), 1) AS active_days, median(duration_ms) AS median_ms, CAST(sum(duration_ms) AS BIGINT) AS total_ms, round(sum(duration_ms) / count(duration_ms), 6) AS mean_ms, CASE WHEN count(duration_ms) = 0 THEN 'unknown' WHEN count(duration_ms) < count(*) THEN 'inferred' ELSE 'exact' END AS duration_provenance, round(sum(prompts) / count(*), 6) AS prompts_per_session,
  round(sum(tool_calls) / count(*), 6) AS tools_per_session, CAST(sum(compactions) AS BIGINT) AS compactions, count(*) FILTER (completion = 'completed') AS completed, count(*) FILTER (completion = 'failed') AS failed, count(*) FILTER (completion = 'interrupted') AS interrupted, count(*) FILTER (completion NOT IN ('completed', 'failed', 'interrupted')) AS unknown FROM sessions GROUP BY ROLLUP (project_id))
  SELECT *, round(sessions / active_days, 6) AS per_day, round(sessions / greatest(active_days / 7, 1 / 7), 6) AS per_week, round(sessions / greatest(active_days / 30, 1 / 30), 6) AS per_month FROM d""",
    "tool_usage": f"{ACTIVITY} SELECT event_type, count(*) AS calls, count(*) FILTER (NOT success) AS failures, round(count(*) FILTER (NOT success) / count(*), 6) AS failure_rate, round(sum(size) / count(*), 4) AS mean_size, max(size) AS largest_size FROM activity GROUP BY 1",
    "repeated_reads": f"{ACTIVITY} SELECT project_id, path_hash, count(*) AS occurrences, count(DISTINCT session_id) AS sessions, min(path) AS label FROM activity WHERE kind = 'read' GROUP BY 1, 2 HAVING count(*) >= 3",
    "repeated_failures": f"{ACTIVITY} SELECT project_id, path_hash, count(*) AS occurrences, count(DISTINCT session_id) AS sessions, min(path) AS label FROM activity WHERE kind = 'verify' AND NOT success GROUP BY 1, 2 HAVING count(*) >= 3",
    "workflow": f"""{FLOW} SELECT project_id, round(sum(written) / count(*), 6) AS files_per_session, round(sum(reads) / nullif(sum(writes), 0), 6) AS read_write_ratio, CAST(sum(verifications) AS BIGINT) AS verification_runs, count(*) FILTER (writes > 0 AND verifications = 0) AS changed_unverified,
  count(*) FILTER (written >= 3 AND verify_kinds <= 1) AS narrow_only, count(*) FILTER (verifications > 0 AND last_success AND last_event = 'purchase') AS ended_verified, count(*) FILTER (verifications > 0 AND (NOT last_success OR last_event = 'error')) AS ended_failed,
  count(*) FILTER (verifications > 0 AND last_write > last_verify) AS changed_after_verification, median(first_write - started_at) AS median_to_first_edit, median(CASE WHEN verifications > 0 THEN next_verify - last_write END) AS median_edit_to_verification, CAST(sum(corrective) AS BIGINT) AS corrective_prompts FROM f GROUP BY ROLLUP (project_id)""",
    "touched_between_reads": f"""{ACTIVITY}, e AS (SELECT *, sum(CASE WHEN kind = 'edit' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, path_hash ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS edits FROM activity WHERE kind IN ('read', 'edit'))
  SELECT event_id, session_id, path_hash, edits > lag(edits) OVER (PARTITION BY session_id, path_hash ORDER BY ts, event_id) AS intervening FROM e WHERE kind = 'read'""",
    "code_changed_after": f"{ACTIVITY}, e AS (SELECT *, max(ts) FILTER (kind = 'edit') OVER (PARTITION BY session_id) AS last_edit FROM activity) SELECT event_id, session_id, success, coalesce(last_edit > ts, false) AS code_changed_after FROM e WHERE kind = 'verify'",
    "carried_timestamps": f"""{ACTIVITY}, r AS (SELECT session_id, event_id AS line, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'soon' ELSE CAST(ts AS VARCHAR) END AS raw FROM activity),
  p AS (SELECT *, try_cast(raw AS BIGINT) AS got, last_value(try_cast(raw AS BIGINT) IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
  o AS (SELECT session_id, line, CASE WHEN raw IS NULL THEN before ELSE got END AS ts FROM p) SELECT * FROM o WHERE ts IS NOT NULL""",
    "paired_calls": f"""{ACTIVITY}, r AS (SELECT session_id, user_id AS call_id, event_id, ts, kind IN ('read', 'edit') AS is_use FROM activity), w AS (SELECT *, lead(is_use) OVER o AS after, lag(is_use) OVER o AS before, lead(ts) OVER o AS next_ts FROM r WINDOW o AS (PARTITION BY session_id, call_id ORDER BY ts, event_id)),
  s AS (SELECT session_id, call_id, event_id, CASE WHEN is_use AND after IS NULL THEN 'partial' WHEN is_use AND after THEN 'overwritten' WHEN is_use THEN 'matched' WHEN NOT coalesce(before, false) THEN 'orphan' END AS state, CASE WHEN is_use AND NOT after THEN next_ts - ts END AS duration_ms FROM w) SELECT * FROM s WHERE state IS NOT NULL""",
    "timeline": f"""{ACTIVITY}, t AS (SELECT session_id, ts, kind, CASE kind WHEN 'prompt' THEN 0 WHEN 'edit' THEN 3 WHEN 'read' THEN 2 ELSE 5 END AS rank, CAST(event_id AS VARCHAR) AS id FROM activity) SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, rank, id) AS position FROM t""",
    "prompt_features": f"{FEATURES} SELECT session_id, CAST(sequence AS BIGINT) AS sequence, imperatives, file_refs, vague, multi_task, corrective, criteria, asks_verification, scoped, reversal, round(complexity, 6)::DOUBLE AS complexity, new_task, length FROM f",
    "prompt_quality": f"{QUALITY} SELECT *, {_R2('(clarity + specificity + verifiability + scope_boundedness + focus) / 5')} AS overall FROM q",
    "prompt_metrics": f"{FEATURES} SELECT session_id % 10 AS project_id, count(*) AS prompts, median(CASE WHEN length > 0 THEN length END) AS median_length, count(*) FILTER (criteria) AS criteria, count(*) FILTER (asks_verification) AS asks_verification, count(*) FILTER (multi_task) AS multi_task, count(*) FILTER (corrective) AS corrective, CAST(sum(vague) AS BIGINT) AS vague, count(*) FILTER (file_refs = 0) AS without_refs FROM f GROUP BY ROLLUP (1)",
    "prompt_templates": f"""{PROMPTS}, k AS (SELECT session_id, sequence, ts, string_split(trim(content), ' ')[1] AS content FROM prompts), t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(content)), '^\\s*([-*]|\\d+[.)])\\s+', ''), '`[^`\\n]+`', '<ref>', 'g'), '\\s+', ' ', 'g'), '[.!?,;:]+$', '')[1:60] AS template FROM k WHERE trim(content) <> '')
  SELECT template, count(*) AS occurrences, count(DISTINCT session_id) AS sessions, arg_min(trim(content)[1:80], (ts, session_id, sequence)) AS example FROM t WHERE template <> '' GROUP BY 1 HAVING count(*) >= 2""",
    "redaction": f"WITH r AS (SELECT doc_id, {_REDACTED} AS redacted FROM documents) SELECT doc_id, sha256(redacted) AS redacted_sha256, CAST(len({_MARKS}) AS BIGINT) AS findings FROM r",
    "secret_findings": f"WITH r AS (SELECT doc_id, {_REDACTED} AS redacted FROM documents), m AS (SELECT doc_id, unnest({_MARKS}) AS label FROM r) SELECT label, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM m GROUP BY 1",
    "sensitive_paths": f"{SHOWN} SELECT page_id, path, path_hash, kind AS sensitive FROM kinds",
    "sensitive_access": f"{SHOWN} SELECT project_id, path_hash, min(path) AS path, count(*) AS operations, count(DISTINCT session_id) AS sessions, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations_seen, min(kind) AS kind FROM kinds WHERE kind IS NOT NULL GROUP BY 1, 2",
    "secret_markers": f"WITH r AS (SELECT doc_id % 200 AS session_id, {_REDACTED} AS redacted FROM documents UNION ALL SELECT conv_id, {_REDACTED} FROM conversations), m AS (SELECT session_id, unnest({_MARKS}) AS label FROM r) SELECT label, CASE label "
    + " ".join(f"WHEN '{label}' THEN '{c}'" for label, c in text.CATEGORIES.items())
    + " ELSE 'secret' END AS category, count(*) AS findings, count(DISTINCT session_id) AS sessions FROM m GROUP BY 1",
    "baseline_points": f"{_POINTS} SELECT * REPLACE (round(read_write_ratio, 6) AS read_write_ratio) FROM points",
    "session_baselines": f"{_BASE} SELECT scope, scope_key, dimension, round(median, 6) AS median, round(mad, 6) AS mad, n, provenance FROM base",
    "session_comparison": f"""{_BASE}, rows AS ({_LONG('points', 'project_id, session_id')}), c AS (SELECT session_id, scope, r.dimension, value, median, mad, CASE WHEN median <> 0 THEN round(value / median, 3) WHEN value > 0 THEN 'infinity'::DOUBLE WHEN value IS NOT NULL THEN 0.0 END AS ratio,
    CASE WHEN value IS NULL THEN 0.0 WHEN mad > 0 THEN abs(value - median) / mad WHEN value = median THEN 0.0 ELSE 1.0 END AS score FROM rows r JOIN base b ON r.dimension = b.dimension AND (scope <> 'project' OR scope_key = project_id))
  SELECT session_id, scope, dimension, round(value, 6) AS value, round(median, 6) AS median, round(mad, 6) AS mad, ratio, round(score, 3) AS score, CASE WHEN value IS NULL THEN 'unknown' WHEN score < 1.5 THEN 'typical' WHEN value > median THEN 'higher' ELSE 'lower' END AS direction FROM c""",
    "baseline_models": f"""{_POINTS}, q AS (SELECT session_id, 'm' || event_id % 4 AS model_id FROM activity WHERE kind IN ('read', 'edit')), n AS (SELECT scope, scope_key, model_id, count(*) AS requests FROM q JOIN scoped USING (session_id) GROUP BY 1, 2, 3)
  SELECT *, round(requests / sum(requests) OVER (PARTITION BY scope, scope_key), 4) AS share FROM n""",
    "relative_durations": f"""{SESSIONS}, d AS (SELECT list_sort(list(duration_ms) FILTER (duration_ms > 0)) AS l FROM sessions), m AS (SELECT l[len(l) // 2 + 1]::DOUBLE AS personal_median FROM d)
  SELECT session_id, duration_ms, personal_median, CASE WHEN duration_ms > 0 THEN printf('%.2f', duration_ms / personal_median) || '× personal median' END AS relative FROM sessions, m""",
    "correlated_events": f"""{SESSIONS}, e AS (SELECT event_id, CASE WHEN event_id % 4 < 3 THEN project_id END AS project_id, CASE WHEN event_id % 4 = 0 THEN session_id END AS stated, ts FROM activity),
  c AS (SELECT event_id, 1 AS tier, started_at, session_id FROM e JOIN sessions s ON stated = session_id
  UNION ALL SELECT event_id, 2, started_at, session_id FROM e JOIN sessions s ON e.project_id = s.project_id AND started_at BETWEEN ts - 3600000 AND ts + 3600000
  UNION ALL SELECT event_id, 3, started_at, session_id FROM e JOIN (SELECT project_id, max((started_at, session_id)) AS m, arg_max(started_at, (started_at, session_id)) AS started_at, arg_max(session_id, (started_at, session_id)) AS session_id FROM sessions GROUP BY 1) s ON e.project_id = s.project_id
  UNION ALL SELECT event_id, 4, started_at, session_id FROM e JOIN sessions s ON started_at BETWEEN ts - 3600000 AND ts + 3600000)
  SELECT event_id, arg_min(session_id, (tier, started_at, session_id)) AS session_id, [1.0, 0.7, 0.4, 0.25][min(tier)]::DOUBLE AS confidence FROM c GROUP BY 1""",
    "rule_candidates": f"{CANDIDATES} SELECT project_id, rule_id, category, severity, confidence, evidence, fingerprint FROM candidates",
    "recommendations": f"""{CANDIDATES}, s AS (SELECT *, {_WEIGHT} AS weight FROM candidates WHERE {_SURE})
  SELECT project_id, rule_id, severity, confidence, round(weight + 25 * confidence + CASE WHEN severity = 'high' THEN 7.5 ELSE 0 END + greatest(0, 10 - 1.5 * (project_id % 4)) + least(10, occurrences) + CASE WHEN project_id % 3 > 0 THEN least(10, 3 * (project_id % 3 + 1)) ELSE 0 END
    + CASE WHEN project_id % 5 = 0 THEN 7 ELSE 2 END - CASE WHEN rule_id LIKE '%-003' THEN 6 ELSE 0 END, 4) AS score FROM s ORDER BY score DESC, weight DESC, rule_id, project_id LIMIT 20""",
    "recommendations_by_project": f"""{CANDIDATES}, s AS (SELECT *, {_WEIGHT} AS weight, round({_WEIGHT} + 25 * confidence + least(10, occurrences) + 2, 4) AS score FROM candidates WHERE {_SURE}), placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, weight DESC, rule_id) AS place FROM s)
  SELECT project_id, rule_id, severity, confidence, score FROM placed WHERE place <= 3""",
    "recommendation_merge": f"{_MERGED} SELECT action, status, count(*) AS rows FROM merged GROUP BY 1, 2",
    "recommendation_outcome": f"{_MERGED} SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'superseded') AS superseded, count(*) FILTER (action = 'touched') AS unchanged, count(*) FILTER (action = 'retained' AND known) AS retained FROM merged",
    "reported_recommendations": f"{_MERGED} SELECT project_id, rule_id, fingerprint FROM merged WHERE status = 'active' AND fingerprint IN (SELECT fingerprint FROM found)",
    "recommendation_status": f"""{_MERGED}, changed AS (SELECT *, CASE WHEN project_id = 0 THEN CASE WHEN status = 'resolved' THEN 'active' END WHEN project_id % 4 = 1 AND status = 'active' THEN 'dismissed' WHEN project_id % 4 = 2 AND status = 'active' THEN 'resolved' WHEN project_id % 4 = 3 AND status = 'dismissed' THEN 'active' END AS becomes FROM merged),
  later AS (SELECT coalesce(becomes, status) AS status, CASE WHEN becomes IS NOT NULL THEN CASE WHEN project_id % 4 = 3 THEN 4 ELSE 3 END WHEN action IN ('inserted', 'touched', 'superseded') THEN 2 ELSE 1 END AS updated_at FROM changed) SELECT status, count(*) AS rows, max(updated_at)::BIGINT AS latest FROM later GROUP BY 1""",
    "opportunities": f"{CANDIDATES} SELECT project_id, rule_id, confidence FROM candidates WHERE {_SURE} AND project_id % 3 <> 0 ORDER BY confidence DESC, rule_id, project_id LIMIT 10",
    "avoidable_usage": f"{CANDIDATES} SELECT CAST(sum(CASE WHEN category = 'tools' THEN 100 * project_id END) AS BIGINT) AS tokens, sum(CASE WHEN category = 'tools' THEN project_id * 0.25::DOUBLE END) AS usd FROM candidates WHERE {_SURE} AND project_id % 3 <> 0",
    "rule_catalogue": f"{CANDIDATES}, listed(rule_id, category) AS (VALUES {', '.join(f"('{r.id}', '{r.category}')" for r in rules.RULES)}) SELECT rule_id, l.category, rule_id <> 'TOOLS-002' AS enabled, count(c.rule_id) AS projects FROM listed l LEFT JOIN candidates c USING (rule_id) GROUP BY 1, 2",
    "sessions_per_day": f"{SESSIONS}, s AS (SELECT started_at // 86400000 AS day, count(*) AS n FROM sessions GROUP BY 1), d AS (SELECT unnest(generate_series((SELECT min(day) FROM s), (SELECT max(day) FROM s))) AS day) SELECT day, coalesce(n, 0) AS sessions FROM d LEFT JOIN s USING (day)",
    "session_page": f"{SESSIONS} SELECT session_id, started_at, completion FROM sessions WHERE completion = 'failed' ORDER BY started_at DESC, session_id LIMIT 50 OFFSET 50",
    "retention": f"{SESSIONS}, k AS (SELECT * FROM sessions WHERE ended_at >= 1704067200000 + 10 * 86400000::BIGINT) SELECT project_id, count(DISTINCT k.session_id) AS sessions, count(*) AS events FROM k JOIN activity a USING (session_id, project_id) GROUP BY 1",
}
