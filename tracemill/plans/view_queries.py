"""Queries of listings, periods, pages, reports, formats and maintenance; with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import formats, provenance, text
from tracemill.operators import coaching, costs, metrics, retention, rules, summaries
from tracemill.plans import hook_queries, report, snapshot
from tracemill.plans import queries as base
from tracemill.sources import bindings
from tracemill.sources.bindings import with_tables
from tracemill.sources.scratch import fresh_path, written
from tracemill.streaming import hooks

NOW_MS = bindings.EPOCH_MS + 25 * metrics.DAY_MS


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return bindings.sessions(bindings.activity(spark, d))


def _projects(spark: SparkSession, d: str) -> DataFrame:
    """Nations as projects: most have no sessions."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_name").alias("display_name"), F.lit("s").alias("source_id"), F.sha2(F.concat(F.lit("path:/"), "n_name"), 256).alias("path_hash"), ((F.col("n_nationkey") * 7) % 25).cast("long").alias("last_seen_at"))


def project_list(spark: SparkSession, d: str) -> DataFrame:
    return summaries.project_list(_projects(spark, d), _sessions(spark, d)).select("project_id", "display_name", "sessions")


def project_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The project of each session's folder, by source and hash of the path."""
    n = _projects(spark, d)
    wanted = n.select(F.sha2(F.concat(F.lit("path:/"), "display_name"), 256).alias("wanted"), F.col("display_name").alias("folder"))
    hashes = [r["wanted"] for r in wanted.orderBy("folder").limit(1).collect()]
    return summaries.project_by_path(n, "s", hashes[0]).select("project_id", "display_name")


def session_search(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of half a year's first weeks that completed and hold "a" in their project's name or "9:" in their id, and used a model."""
    a = bindings.activity(spark, d)
    models = a.select("session_id", F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model_id"))
    names = _projects(spark, d).withColumn("display_name", F.when(F.col("project_id") % 2 == 0, F.concat(F.lit("zq "), "display_name")).otherwise(F.col("display_name")))
    found = summaries.session_list(bindings.sessions(a), names, status="completed", since_ms=bindings.EPOCH_MS, until_ms=NOW_MS, search="zq", requests=models, model_id="m2")
    return found.select("session_id", "started_at")


def report_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions in each period before a time, of a project since a time, and of one id."""
    s, out = written(_sessions(spark, d), "sessions"), None
    some = s.agg(F.min("session_id")).first()[0]
    picks = {p: summaries.period(s, NOW_MS, p) for p in ("day", "week", "month", "all")} | {"project": summaries.period(s, NOW_MS, "all", since_ms=NOW_MS - 9 * metrics.DAY_MS, project_id=3), "until": summaries.period(s, NOW_MS, "week", until_ms=NOW_MS - 9 * metrics.DAY_MS), "session": summaries.period(s, NOW_MS, "day", session_id=some)}
    for name, rows in picks.items():
        row = rows.agg(F.lit(name).alias("period"), F.count(F.lit(1)).alias("sessions"))
        out = row if out is None else out.unionByName(row)
    return out


def session_pages(spark: SparkSession, d: str) -> DataFrame:
    """What is said of a first page of too many, a middle one, and the one after the last."""
    s, out = _sessions(spark, d), None
    for page, limit in ((0, 900), (3, 50), (10**6, 50)):
        about = summaries.page(s, ["session_id"], page, limit)[1]
        out = about if out is None else out.unionByName(about)
    return out.withColumns({"page": F.col("page").cast("long"), "limit": F.col("limit").cast("long")})


def model_list(spark: SparkSession, d: str) -> DataFrame:
    return summaries.models(bindings.model_requests(spark, d))


def completion(spark: SparkSession, d: str) -> DataFrame:
    return summaries.completion(_sessions(spark, d))


def verified_rate(spark: SparkSession, d: str) -> DataFrame:
    a = written(bindings.activity(spark, d), "activity")
    return summaries.verified_rate(metrics.workflow(a), metrics.usage(bindings.sessions(a)))


def _reported(spark: SparkSession, d: str) -> DataFrame:
    return bindings.model_requests(spark, d).withColumn("reported_usd", F.when(F.col("session_id") % 5 == 0, F.col("request_no").cast("double") / 4).when(F.col("session_id") % 5 == 1, float("nan")))


def reported_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs where some requests state their own."""
    out = costs.cost_by_model(_reported(spark, d), costs.price_list(spark))
    return out.withColumn("usd", F.round(F.col("usd").cast("double"), 4))


def reported_total(spark: SparkSession, d: str) -> DataFrame:
    """Totals of sessions whose costs are reported, whose reports are no numbers, of the rest, of the rest under a name without a price, and of all."""
    r, out = _reported(spark, d), None
    for name, rows in {"reported": r.where("session_id % 5 = 0"), "not a number": r.where("session_id % 5 = 1"), "from the list": r.where("session_id % 5 > 1"), "all": r, "without a price": r.where("session_id % 5 > 1").withColumn("model_id", F.lit("nameless"))}.items():
        one = costs.cost_total(rows, costs.price_list(spark)).select(F.lit(name).alias("part"), F.round(F.col("usd").cast("double"), 4).alias("usd"), "methodology", "confidence")
        out = one if out is None else out.unionByName(one)
    return out


def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    """Redactions of each category over all documents, counted as they are made, with a custom pattern and one that doesn't compile."""
    docs = text.redaction_counts(bindings.texts(spark, d), "text", emails=True, custom=[("marker", r"\blorem[0-9]+\b"), ("broken", "(")])
    return docs.select(F.explode_outer("redactions").alias("category", "n")).where("category is not null").groupBy("category").agg(F.sum("n").alias("redactions"))


def prompt_list(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten of all prompts, newest first, with their score."""
    p = base.prompt_rows(spark, d).withColumns(text.prompt_quality())
    rows, _ = summaries.page(p, [F.desc("ts"), "session_id", "sequence"], 2, 10)
    return rows.select("session_id", F.col("sequence").cast("long").alias("sequence"), "ts", "overall")


def recommendations_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations of the last fourteen days, made on days that are made up."""
    found = rules.evaluate(snapshot.shared(spark, d))
    made = found.withColumn("created_at", F.lit(NOW_MS) - (F.col("project_id") * 2) * metrics.DAY_MS)
    return coaching.per_day(made, NOW_MS)


def formatted_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of every order as a report shows them."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    some = lambda c, n: F.when(k % n > 0, c)
    at = F.lit(NOW_MS) - k * 977_000
    return o.select(
        k.alias("order_id"), formats.number(some(F.floor("o_totalprice"), 7)).alias("number"), formats.number(k / 4).alias("quarters"), formats.duration(some(k * 37, 5)).alias("duration"), formats.usd(some(k / 8, 3)).alias("usd"), formats.percent((k % 16) / 16).alias("percent"), formats.tokens(k * k).alias("tokens"),
        formats.relative(at, NOW_MS).alias("relative"), formats.period_label(F.element_at(F.array(*map(F.lit, ("day", "week", "all", "year"))), (k % 4 + 1).cast("int")), F.when(k % 3 == 0, k), F.when(k % 5 == 0, k)).alias("period"), text.confidence_band((k % 10) / 10).alias("band"),
        text.threshold(F.when(k % 3 == 0, "2.5").when(k % 3 == 1, "much"), 4).alias("threshold"), text.secret_hash(k.cast("string")).alias("secret"), text.path_of_folder(text.folder_of(F.concat(F.lit("/a-b/"), k.cast("string")))).alias("folder"),
    )


def _store(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    a = bindings.activity(spark, d)
    s = bindings.sessions(a)
    live = a.where("event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("session_id")).alias("correlated_session_id"), "ts")
    recs = s.where("compactions > 0").select("session_id", "project_id")
    return {"projects": _projects(spark, d), "sessions": s, "activity": a.select("session_id", "event_id"), "hook_events": live, "recommendations": recs}


def pruned(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table before and after retention of ten days."""
    t = _store(spark, d)
    return retention.summary(t, retention.prune(t, NOW_MS, 10))


def purged_project(spark: SparkSession, d: str) -> DataFrame:
    t = _store(spark, d)
    return retention.summary(t, retention.purge_project(t, 3))


def purged_all(spark: SparkSession, d: str) -> DataFrame:
    t = _store(spark, d)
    return retention.summary(t, retention.purge_all(t))


def exported(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table of an export, counted in its files."""
    t = _store(spark, d)
    return report.export({k: t[k] for k in ("sessions", "projects", "recommendations")}, fresh_path(spark, "export"))


def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    have = snapshot.shared(spark, d)
    return report.markdown(have, rules.rank(rules.evaluate(have), base.NOW_MS, by_project=True))


def json_report(spark: SparkSession, d: str) -> DataFrame:
    return report.as_json(snapshot.shared(spark, d))


def provenanced_usage(spark: SparkSession, d: str) -> DataFrame:
    """Durations and tokens of each project with what they rest on; every tenth session has no duration."""
    s = _sessions(spark, d).withColumn("duration_ms", F.when(F.col("started_at") % 10 > 0, F.col("duration_ms")))
    n = s.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count("duration_ms").alias("timed"), F.sum("duration_ms").alias("total"))
    r = bindings.model_requests(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("requests"), F.count("cache_read_tokens").alias("cached"), F.sum("cache_read_tokens").alias("cache_tokens"), F.sum("input_tokens").alias("input_tokens"))
    figures = {"sessions": provenance.figure(F.col("n"), "exact"), "total_ms": provenance.by_coverage(F.col("total"), F.col("timed"), F.col("n"), "sessions"), "cache_read_tokens": provenance.by_coverage(F.col("cache_tokens"), F.col("cached"), F.col("requests"), "requests"), "input_tokens": provenance.figure(F.col("input_tokens"), "reported", confidence=0.9)}
    each = F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("f")) for k, v in figures.items()))
    return n.join(r, "project_id", "left").select("project_id", F.explode(each).alias("m")).select("project_id", "m.metric", "m.f.value", "m.f.provenance", "m.f.note", "m.f.confidence")


def active_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Active rows after a run, newest first."""
    return rules.active(base._merged(spark, d)[0]).select("fingerprint", "rule_id", "project_id", "created_at")


def session_hooks(spark: SparkSession, d: str) -> DataFrame:
    """Stored hook events of user 7, in order of receipt."""
    return hooks.of_session(spark.read.parquet(hook_queries.drained(spark, d)[1]), "7").select("received_at", "hook_event_name", "payload_hash")


def empty_scopes(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot row for every nation as a project: zeros where there is nothing."""
    out = snapshot.scoped(snapshot.shared(spark, d), _projects(spark, d))
    return out.select("project_id", *(F.col(c).cast("long").alias(c) for c in ("sessions", "tests", "prompt_count", "retention_days")), "full_local")


QUERIES = {
    "project_list": project_list, "project_lookup": project_lookup, "session_search": session_search, "report_windows": report_windows, "session_pages": session_pages, "model_list": model_list, "completion": completion, "verified_rate": verified_rate, "reported_costs": reported_costs, "reported_total": reported_total,
    "redaction_counts": redaction_counts, "prompt_list": prompt_list, "recommendations_per_day": recommendations_per_day, "formatted_figures": formatted_figures, "pruned": pruned, "purged_project": purged_project, "purged_all": purged_all, "exported": exported, "markdown_report": markdown_report,
    "json_report": json_report, "empty_scopes": empty_scopes, "provenanced_usage": provenanced_usage, "active_recommendations": active_recommendations, "session_hooks": session_hooks,
}

_P = "projects AS (SELECT n_nationkey::BIGINT AS project_id, n_name AS display_name, (n_nationkey * 7) % 25 AS last_seen_at FROM nation)"
_TABLES = ("activity", "hook_events", "projects", "recommendations", "sessions")
_STORE = f"{base.SESSIONS}, {_P}, live AS (SELECT CASE WHEN event_id % 2 = 0 THEN session_id END AS session_id, ts FROM activity WHERE event_id % 3 = 0), recs AS (SELECT session_id, project_id FROM sessions WHERE compactions > 0)"


def _purge(gone: str, more: dict[str, str]) -> str:
    """Rows before and after: gone lists the session_ids that go; more adds, by table, what else goes."""
    source = {"activity": "activity", "hook_events": "live", "projects": "projects", "recommendations": "recs", "sessions": "sessions"}
    parts = []
    for t in _TABLES:
        where = " OR ".join(x for x in (f"coalesce(session_id IN ({gone}), false)" if t != "projects" else "", more.get(t, "")) if x) or "false"
        parts.append(f"""SELECT '{t}' AS "table", count(*) AS before, count(*) FILTER (NOT ({where})) AS after, count(*) FILTER ({where}) AS gone FROM {source[t]}""")
    return " UNION ALL ".join(parts)


_CUT = f"{NOW_MS - 10 * metrics.DAY_MS}"
_NUMBER = lambda x: f"coalesce(regexp_replace(format('{{:,.2f}}', CAST({x} AS DOUBLE)), '\\.?0+$', ''), '—')"
_DURATION = lambda x: f"coalesce(CASE WHEN {x} < 1000 THEN CAST(round({x}) AS BIGINT) || ' ms' WHEN {x} / 1000 < 60 THEN printf('%.1f', {x} / 1000) || ' s' ELSE CAST(floor({x} / 60000) AS BIGINT) || 'm ' || CAST(round({x} / 1000 - floor({x} / 60000) * 60) AS BIGINT) || 's' END, '—')"
_PERCENT = lambda x: f"coalesce(printf('%.1f', round(({x})::DOUBLE * 100, 1)) || '%', '—')"
_SHOW = {"number": _NUMBER, "duration": _DURATION, "percent": _PERCENT}
_HEAD = lambda title: f"chr(10) || chr(10) || '## {title}' || chr(10) || chr(10)"
_FIGURES = lambda title: " || chr(10) || ".join(f"'| {c} | ' || {_SHOW[how](c)} || ' |'" for c, how in report.SECTIONS[title])
_LISTED = lambda n: f"coalesce((SELECT string_agg(line, chr(10) ORDER BY score DESC, rule_id) FROM placed WHERE placed.project_id = z.project_id AND place <= {n}), '{report.NOTHING}')"
_REPORT = " || ".join(
    ["'# Project ' || project_id", _HEAD("Summary"), f"'- Sessions: ' || {_NUMBER('sessions')}", f"chr(10) || '- {report.DISCLAIMER}'"]
    + [x for title in ("Usage", "Most important findings", "Verification quality", "Tool efficiency", "Data completeness", "Top recommendations") for x in (_HEAD(title), _FIGURES(title) if title in report.SECTIONS else _LISTED(5 if title.startswith("Most") else 20))]
    + [_HEAD("Privacy mode"), "'`redacted-content`'", _HEAD("Scan provenance"), f"'| events | ' || {_NUMBER('sessions')} || ' |'"]
)
_JSON = " || ',' || ".join("'\"" + title.lower().replace(" ", "_") + "\":{' || " + " || ',' || ".join(f"'\"{c}\":' || coalesce(regexp_replace(CAST(CAST({c} AS DECIMAL(30, 6)) AS VARCHAR), '\\.?0+$', ''), 'null')" for c, _ in names) + " || '}'" for title, names in report.SECTIONS.items())

ORACLE_SQL = {
    "project_list": f"{base.SESSIONS}, {_P} SELECT p.project_id, display_name, count(session_id) AS sessions FROM projects p LEFT JOIN sessions s USING (project_id) GROUP BY 1, 2",
    "project_lookup": "SELECT n_nationkey::BIGINT AS project_id, n_name AS display_name FROM nation ORDER BY n_name LIMIT 1",
    "session_search": f"{base.SESSIONS} SELECT session_id, started_at FROM sessions WHERE completion = 'completed' AND started_at BETWEEN {bindings.EPOCH_MS} AND {NOW_MS} AND (contains(session_id, 'zq') OR project_id % 2 = 0) AND session_id IN (SELECT session_id FROM activity WHERE event_id % 4 = 2)",
    "report_windows": f"{base.SESSIONS} SELECT 'day' AS period, count(*) FILTER (started_at BETWEEN {NOW_MS} - 86400000 AND {NOW_MS}) AS sessions FROM sessions UNION ALL SELECT 'week', count(*) FILTER (started_at BETWEEN {NOW_MS} - 7 * 86400000 AND {NOW_MS}) FROM sessions UNION ALL SELECT 'month', count(*) FILTER (started_at BETWEEN {NOW_MS} - 30 * 86400000::BIGINT AND {NOW_MS}) FROM sessions"
    f" UNION ALL SELECT 'all', count(*) FROM sessions UNION ALL SELECT 'project', count(*) FILTER (project_id = 3 AND started_at BETWEEN {NOW_MS} - 9 * 86400000 AND {NOW_MS}) FROM sessions UNION ALL SELECT 'until', count(*) FILTER (started_at BETWEEN {NOW_MS} - 16 * 86400000 AND {NOW_MS} - 9 * 86400000) FROM sessions UNION ALL SELECT 'session', 1",
    "session_pages": f'{base.SESSIONS}, n AS (SELECT count(*) AS total FROM sessions) SELECT 1 AS page, 200 AS "limit", total, total > 200 AS has_more FROM n UNION ALL SELECT 3, 50, total, total > 150 FROM n UNION ALL SELECT 1000000, 50, total, total > 50000000 FROM n',
    "model_list": f"{base.REQUESTS} SELECT DISTINCT model_id FROM model_requests",
    "completion": f"{base.SESSIONS} SELECT count(*) FILTER (completion = 'completed') AS completed, count(*) FILTER (completion = 'interrupted') AS interrupted, count(*) FILTER (completion = 'failed') AS failed, 0::BIGINT AS unknown FROM sessions",
    "verified_rate": f"{base.FLOW} SELECT project_id, round(count(*) FILTER (verifications > 0 AND last_success AND last_event = 'purchase') / count(*), 6) AS verified_rate FROM f GROUP BY ROLLUP (project_id)",
    "reported_total": f"""{base.COSTED}, own AS (SELECT *, CASE WHEN session_id % 5 = 0 THEN request_no * 250000::DECIMAL(18,0) END AS said FROM costed),
  p AS (SELECT 'all' AS part, session_id, model_id, said, micro FROM own UNION ALL SELECT CASE session_id % 5 WHEN 0 THEN 'reported' WHEN 1 THEN 'not a number' ELSE 'from the list' END, session_id, model_id, said, micro FROM own UNION ALL SELECT 'without a price', session_id, 'nameless', said, NULL FROM own WHERE session_id % 5 > 1),
  m AS (SELECT part, model_id, count(*) AS requests, CAST(CAST(sum(coalesce(said, micro)) AS DECIMAL(38,4)) / 1000000 AS DECIMAL(30,6)) AS usd, count(said) AS said, count(micro) AS priced FROM p GROUP BY 1, 2)
  SELECT part, round(sum(usd)::DOUBLE, 4) AS usd, CASE WHEN sum(said) > 0 THEN 'reported' WHEN sum(priced) > 0 THEN 'registry' ELSE 'unknown' END AS methodology, round(count(usd) / sum(requests), 9) AS confidence FROM m GROUP BY 1""",
    "reported_costs": f"""{base.COSTED}, own AS (SELECT *, CASE WHEN session_id % 5 = 0 THEN request_no * 250000::DECIMAL(18,0) END AS said FROM costed)
  SELECT model_id, count(*) AS requests, count(coalesce(said, micro)) AS costed, round(CAST(CAST(sum(coalesce(said, micro)) AS DECIMAL(38,4)) / 1000000 AS DECIMAL(30,6))::DOUBLE, 4) AS usd, CASE WHEN count(said) > 0 THEN 'reported' WHEN count(micro) > 0 THEN 'registry' ELSE 'unknown' END AS provenance FROM own GROUP BY 1""",
    "redaction_counts": f"WITH r AS (SELECT {base.redacted_sql('text', True)} AS redacted FROM documents), m AS (SELECT unnest(regexp_extract_all(redacted, '\\[REDACTED:([a-z0-9-]+)\\]', 1)) AS label FROM r) SELECT CASE label " + " ".join(f"WHEN '{label}' THEN '{c}'" for label, c in text.CATEGORIES.items()) + " ELSE 'secret' END AS category, count(*) AS redactions FROM m GROUP BY 1",
    "prompt_list": f"{base.QUALITY} SELECT q.session_id, q.sequence, ts, {base._R2('(clarity + specificity + verifiability + scope_boundedness + focus) / 5')} AS overall FROM q JOIN prompts p ON q.session_id = p.session_id AND q.sequence = p.sequence ORDER BY ts DESC, q.session_id, q.sequence LIMIT 10 OFFSET 10",
    "recommendations_per_day": f"{base.CANDIDATES}, made AS (SELECT ({NOW_MS} - project_id * 2 * 86400000::BIGINT) // 86400000 AS day FROM candidates WHERE confidence >= {rules.MIN_CONFIDENCE}), days AS (SELECT unnest(range({NOW_MS // metrics.DAY_MS - 13}, {NOW_MS // metrics.DAY_MS + 1})) AS day) SELECT days.day, count(made.day) AS recommendations FROM days LEFT JOIN made USING (day) GROUP BY 1",
    "formatted_figures": f"""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p, round((o_orderkey * 977000) / 60000)::BIGINT AS m FROM orders), h AS (SELECT *, round(m / 60)::BIGINT AS hours FROM o), y AS (SELECT *, round(hours / 24)::BIGINT AS days FROM h)
  SELECT k AS order_id, {_NUMBER('CASE WHEN k % 7 > 0 THEN floor(p) END')} AS number, {_NUMBER('k / 4')} AS quarters, {_DURATION('(CASE WHEN k % 5 > 0 THEN k * 37 END)')} AS duration, coalesce('$' || printf('%.4f', (CASE WHEN k % 3 > 0 THEN k / 8 END)::DOUBLE), '—') AS usd, {_PERCENT('(k % 16) / 16')} AS percent,
  CASE WHEN k * k >= 1000000 THEN printf('%.2f', k * k / 1e6::DOUBLE) || 'M' WHEN k * k >= 1000 THEN printf('%.1f', k * k / 1e3::DOUBLE) || 'k' ELSE CAST(k * k AS VARCHAR) END AS tokens,
  CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN hours < 24 THEN hours || 'h ago' WHEN days < 30 THEN days || 'd ago' ELSE strftime(DATE '1970-01-01' + CAST(({NOW_MS} - k * 977000) // 86400000 AS INTEGER), '%Y-%m-%d') END AS relative,
  CASE WHEN k % 5 = 0 THEN 'session ' || k ELSE ['last 24 hours', 'last 7 days', 'all time', 'year'][k % 4 + 1] || CASE WHEN k % 3 = 0 THEN ' · project ' || k ELSE '' END END AS period, CASE WHEN k % 10 >= 8 THEN 'high' WHEN k % 10 >= 5 THEN 'moderate' ELSE 'low' END AS band, CASE WHEN k % 3 = 0 THEN 2.5 ELSE 4.0 END::DOUBLE AS threshold,
  sha256('secret:' || k) AS secret, '/a/b/' || k AS folder FROM y""",
    "pruned": f"{_STORE} {_purge(f'SELECT session_id FROM sessions WHERE ended_at < {_CUT}', {'hook_events': f'ts < {_CUT}'})}",
    "purged_project": f"{_STORE} {_purge('SELECT session_id FROM sessions WHERE project_id = 3', {'projects': 'project_id = 3'})}",
    "purged_all": f"{_STORE} {_purge('SELECT session_id FROM sessions', {t: 'true' for t in _TABLES})}",
    "exported": f"""{_STORE} SELECT 'sessions' AS "table", count(*) AS rows FROM sessions UNION ALL SELECT 'projects', count(*) FROM projects UNION ALL SELECT 'recommendations', count(*) FROM recs""",
    "markdown_report": f"""{base.CANDIDATES}, scored AS (SELECT *, {base._WEIGHT} AS weight, round({base._WEIGHT} + 25 * confidence + least(10, occurrences) + 2, 4) AS score, '- ' || rule_id || ' (' || severity || ', ' || {_PERCENT('confidence')} || ')' AS line FROM candidates WHERE confidence >= {rules.MIN_CONFIDENCE}),
  placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, rule_id) AS place FROM scored) SELECT project_id, {_REPORT} AS report FROM z""",
    "json_report": f"""{base._SNAPSHOT}, {base._ZEROED} SELECT project_id, '{{' || {_JSON} || ',"privacy_mode":"redacted-content","cost_disclaimer":"{report.DISCLAIMER}"}}' AS report FROM z""",
    "empty_scopes": f"{base._SNAPSHOT}, {base._ZEROED}, {_P} SELECT project_id, coalesce(sessions, 0) AS sessions, coalesce(tests, 0) AS tests, coalesce(prompt_count, 0) AS prompt_count, coalesce(retention_days, 0) AS retention_days, coalesce(full_local, false) AS full_local FROM projects LEFT JOIN z USING (project_id)",
    "provenanced_usage": f"""{with_tables("activity", "sessions", "model_requests")}, n AS (SELECT project_id, count(*) AS n, count(*) FILTER (started_at % 10 > 0) AS timed, sum(duration_ms) FILTER (started_at % 10 > 0) AS total FROM sessions GROUP BY 1),
  r AS (SELECT project_id, count(*) AS requests, count(cache_read_tokens) AS cached, sum(cache_read_tokens) AS cache_tokens, sum(input_tokens) AS input_tokens FROM model_requests GROUP BY 1), j AS (SELECT * FROM n LEFT JOIN r USING (project_id))
  SELECT project_id, 'sessions' AS metric, n::DOUBLE AS value, 'exact' AS provenance, NULL::VARCHAR AS note, NULL::DOUBLE AS confidence FROM j UNION ALL SELECT project_id, 'input_tokens', input_tokens::DOUBLE, CASE WHEN input_tokens IS NULL THEN 'unknown' ELSE 'reported' END, NULL, 0.9::DOUBLE FROM j
  UNION ALL SELECT project_id, 'total_ms', total::DOUBLE, CASE WHEN timed = 0 THEN 'unknown' WHEN timed < n THEN 'inferred' ELSE 'exact' END, CASE WHEN timed > 0 AND timed < n THEN timed || ' of ' || n || ' sessions' END, NULL FROM j
  UNION ALL SELECT project_id, 'cache_read_tokens', cache_tokens::DOUBLE, CASE WHEN coalesce(cached, 0) = 0 THEN 'unknown' WHEN cached < requests THEN 'inferred' ELSE 'exact' END, CASE WHEN cached > 0 AND cached < requests THEN cached || ' of ' || requests || ' requests' END, NULL FROM j""",
    "active_recommendations": f"{base._MERGED} SELECT fingerprint, rule_id, project_id, CASE action WHEN 'inserted' THEN 2 ELSE 1 END::BIGINT AS created_at FROM merged WHERE status = 'active'",
    "session_hooks": f"{hook_queries._KEPT} SELECT '2024-01-01T' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':00:00Z' AS received_at, hook_event_name, payload_hash FROM stored WHERE event_id % 8 > 1 AND source_session_id = '7'",
}
