"""Small summaries: completeness, provenance, listings and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, LARGEST_PAGE = 50, 200
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30}


def completeness(sessions: DataFrame) -> DataFrame:
    """Sessions that are complete, and that have each flag."""
    has = lambda flag: F.count_if(F.array_contains("completeness", flag))
    return sessions.agg(has("complete").alias("complete"), has("tail-missing").alias("tail_missing"), has("metrics-missing").alias("metrics_missing"), has("prompts-missing").alias("prompts_missing"))


def completion(sessions: DataFrame) -> DataFrame:
    """Sessions by how they ended; what isn't known is unknown."""
    known = ("completed", "interrupted", "failed")
    return sessions.agg(*(F.count_if(F.col("completion") == k).alias(k) for k in known), F.count_if(~F.coalesce(F.col("completion").isin(*known), F.lit(False))).alias("unknown"))


def scan_provenance(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """Where sessions come from: the least source_id and its adapter's version, the parser's version, and how many were imported."""
    parser = F.nullif(F.regexp_extract(F.max("import_provenance"), r"v(\d+)", 1), F.lit(""))
    of = sessions.agg(F.min("source_id").alias("source_id"), parser.cast("int").alias("parser_version"), F.count(F.lit(1)).alias("imported"))
    return of.join(sources, "source_id", "left").select("source_id", "adapter_version", "parser_version", "imported")


def period(df: DataFrame, now_ms: int, period: str = "all", since_ms: int | None = None, until_ms: int | None = None, session_id: str | None = None, project_id: int | None = None, at: str = "started_at") -> DataFrame:
    """Sessions of a report: of one id, whatever the period; else of a project if given, that began since a time, or in the last day, week or month before until (or now), ends included."""
    if session_id is not None:
        return df.where(F.col("session_id") == session_id)
    end = now_ms if until_ms is None else until_ms
    start = since_ms if since_ms is not None else end - PERIOD_DAYS[period] * 86_400_000 if period in PERIOD_DAYS else None
    rows = df if project_id is None else df.where(F.col("project_id") == project_id)
    rows = rows if start is None else rows.where(F.col(at) >= start)
    return rows if until_ms is None and start is None else rows.where(F.col(at) <= end)


def page(rows: DataFrame, order: list[Column | str], page: int = 1, limit: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and (page, limit, total, has_more); page is 1 at least, limit 1 to LARGEST_PAGE."""
    page, limit = max(1, page), min(LARGEST_PAGE, max(1, limit))
    about = rows.agg(F.lit(page).alias("page"), F.lit(limit).alias("limit"), F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) > page * limit).alias("has_more"))
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit), about


def session_list(sessions: DataFrame, projects: DataFrame, project_id: int | None = None, status: str | None = None, since_ms: int | None = None, until_ms: int | None = None, search: str | None = None, requests: DataFrame | None = None, model_id: str | None = None) -> DataFrame:
    """Sessions that fit every filter given; search is text in the id or the project's name; model_id one of the session's models."""
    rows = sessions
    for given, condition in ((project_id, F.col("project_id") == project_id), (status, F.col("completion") == status), (since_ms, F.col("started_at") >= since_ms), (until_ms, F.col("started_at") <= until_ms)):
        if given is not None:
            rows = rows.where(condition)
    if search is not None:
        named = projects.where(F.contains(F.lower("display_name"), F.lit(search.lower()))).select("project_id").distinct().withColumn("named", F.lit(True))
        rows = rows.join(named, "project_id", "left").where(F.contains(F.lower("session_id"), F.lit(search.lower())) | F.col("named")).drop("named")
    if model_id is not None and requests is not None:
        rows = rows.join(requests.where(F.col("model_id") == model_id).select("session_id").distinct(), "session_id", "left_semi")
    return rows


def project_list(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every project with its number of sessions, the one seen last first."""
    n = sessions.groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions"))
    return projects.join(n, "project_id", "left").na.fill(0, ["sessions"]).orderBy(F.desc("last_seen_at"), "project_id")


def project_by_path(projects: DataFrame, source_id: str, path_hash: str) -> DataFrame:
    return projects.where((F.col("source_id") == source_id) & (F.col("path_hash") == path_hash))


def models(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("model_id").isNotNull()).select("model_id").distinct().orderBy("model_id")


def verified_rate(workflow: DataFrame, usage: DataFrame, key: str = "project_id") -> DataFrame:
    """Share of sessions that ended after a check that passed."""
    u = usage.select(F.col(key).alias("_key"), "sessions")
    return workflow.join(u, F.col(key).eqNullSafe(F.col("_key"))).select(key, F.round(F.col("ended_verified") / F.nullif("sessions", F.lit(0)), 6).alias("verified_rate"))
