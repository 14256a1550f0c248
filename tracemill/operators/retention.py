"""Purges of sessions and all that hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Tables that only point at sessions: their rows go with a correlated session, or by their own time.
LIVE = ("hook_events", "telemetry_events")


def expired(sessions: DataFrame, now_ms: int, days: int) -> DataFrame:
    """session_id of what ended before the cutoff, or never ended and began before it; days of 0 or less expire nothing."""
    if days <= 0:
        return sessions.select("session_id").limit(0)
    cutoff = now_ms - days * DAY_MS
    return sessions.where(F.coalesce("ended_at", "started_at") < cutoff).select("session_id")


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of those sessions: by session_id, in LIVE by correlated_session_id; rows of no session stay."""
    ids = gone.select("session_id").distinct()
    key = lambda name: "correlated_session_id" if name in LIVE else "session_id"
    return {name: df.join(ids.withColumnRenamed("session_id", key(name)), key(name), "left_anti") if key(name) in df.columns else df for name, df in tables.items()}


def prune(tables: dict[str, DataFrame], now_ms: int, days: int) -> dict[str, DataFrame]:
    """Tables after retention: expired sessions with all that hangs on them, and live events older than the cutoff."""
    if days <= 0:
        return tables
    out = without(tables, expired(tables["sessions"], now_ms, days))
    return {name: df.where(F.col("ts").isNull() | (F.col("ts") >= now_ms - days * DAY_MS)) if name in LIVE else df for name, df in out.items()}


def of_project(sessions: DataFrame, project_id: int) -> DataFrame:
    return sessions.where(F.col("project_id") == project_id).select("session_id")


def purge_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """Tables without a project: its row, its sessions and all that hangs on them, its recommendations."""
    out = without(tables, of_project(tables["sessions"], project_id))
    return {name: df.where(~F.col("project_id").eqNullSafe(F.lit(project_id))) if name in ("projects", "sessions", "recommendations") else df for name, df in out.items()}


def purge_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, empty."""
    return {name: df.limit(0) for name, df in tables.items()}


def summary(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table before and after, and how many went."""
    count = lambda ts: _stack({k: df.agg(F.count(F.lit(1)).alias("n")) for k, df in ts.items()})
    old, new = count(before).withColumnRenamed("n", "before"), count(after).withColumnRenamed("n", "after")
    return old.join(new, "table").withColumn("gone", F.col("before") - F.col("after"))


def _stack(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out
