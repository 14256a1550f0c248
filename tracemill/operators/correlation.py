"""Events that come without a session find one, by tiers of confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


#: Cells of time in a window; a cell's rows are put in order in one task.
CELLS = 360


def earliest_within(events: DataFrame, sessions: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """event_id and the earliest session (started_at, session_id) with its keys that starts within window_ms of it.

    That is the first start at or after the window's begin, if it is within. Time
    is cut into stretches as long as window_ms, and those into cells: the first
    start is in the begin's own cell, found by one pass over the cell in order of
    time, or it is the least of a later cell of the stretch, or of one of the next
    two stretches. Rows are met in order or by equal keys, never in pairs, and
    only the least start of a cell is carried on.
    """
    long, short = window_ms, max(1, window_ms // CELLS)
    start = F.struct("started_at", "session_id")
    at = lambda c: [F.floor(c / long).alias("stretch"), F.floor(c / short).alias("cell"), c.alias("at")]
    starts = sessions.select(*keys, *at(F.col("started_at")), start.alias("start"), F.lit(None).cast("long").alias("event_id"))
    begins = events.select(*keys, *at(F.col("ts") - long), F.lit(None).cast(starts.schema["start"].dataType).alias("start"), "event_id")
    both = starts.unionByName(begins)
    # from the cell's end backwards, the last start seen is the next one; starts come before begins at the same time
    later = Window.partitionBy(*keys, "stretch", "cell").orderBy(F.desc("at"), F.col("start").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("next", F.last("start", ignorenulls=True).over(later)).where("event_id is not null").select(*keys, "stretch", "cell", "at", "event_id", "next")
    cells = both.groupBy(*keys, "stretch", "cell").agg(F.min("start").alias("least"))
    after = Window.partitionBy(*keys, "stretch").orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    ahead = cells.withColumn("ahead", F.min("least").over(after)).select(*keys, "stretch", "cell", "ahead")
    found = own.join(ahead, [*keys, "stretch", "cell"], "left")
    stretches = cells.groupBy(*keys, "stretch").agg(F.min("least").alias("least"))
    for step in (1, 2):
        moved = stretches.select(*keys, (F.col("stretch") - step).alias("stretch"), F.col("least").alias(f"least_{step}"))
        found = found.join(moved, [*keys, "stretch"], "left")
    found = found.withColumn("first", F.coalesce("next", "ahead", "least_1", "least_2"))
    return found.where(F.col("first.started_at") <= F.col("at") + 2 * long).select("event_id", "first.started_at", "first.session_id")


def correlate(events: DataFrame, sessions: DataFrame, window_ms: int = HOUR_MS) -> DataFrame:
    """event_id, session_id and confidence of each event that any tier fits.

    Tiers: the stated session (1.0); the earliest session of the project that
    starts within window_ms (0.7); the project's latest-started session (0.4); the
    earliest session of any project within window_ms (0.25), which only events
    that no other tier fits are looked up for.
    """
    s = sessions.select("session_id", "project_id", "started_at")
    e = events.select("event_id", "project_id", "source_session_id", "ts")
    stated = s.select(F.col("session_id").alias("source_session_id"), "session_id", "started_at")
    exact = e.join(stated, "source_session_id").select("event_id", F.lit(1).alias("tier"), "started_at", "session_id")
    placed = e.where("project_id is not null")
    near = earliest_within(placed, s.where("project_id is not null"), ["project_id"], window_ms).select("event_id", F.lit(2).alias("tier"), "started_at", "session_id")
    latest = s.groupBy("project_id").agg(F.max(F.struct("started_at", "session_id")).alias("l"))
    last = placed.join(latest, "project_id").select("event_id", F.lit(3).alias("tier"), "l.started_at", "l.session_id")
    rest = e.join(exact.select("event_id"), "event_id", "left_anti").join(last.select("event_id"), "event_id", "left_anti")
    anywhere = earliest_within(rest, s, [], window_ms).select("event_id", F.lit(4).alias("tier"), "started_at", "session_id")
    found = exact.unionByName(near).unionByName(last).unionByName(anywhere)
    best = found.groupBy("event_id").agg(F.min(F.struct("tier", "started_at", "session_id")).alias("b"))
    confidence = F.element_at(F.array(*map(F.lit, (1.0, 0.7, 0.4, 0.25))), F.col("b.tier"))
    return best.select("event_id", F.col("b.session_id").alias("session_id"), confidence.alias("confidence"))


def write_back(events: DataFrame, found: DataFrame) -> DataFrame:
    """events with correlated_session_id and correlation_confidence of what correlate() found; null where it found nothing."""
    return events.join(found.select("event_id", F.col("session_id").alias("correlated_session_id"), F.col("confidence").alias("correlation_confidence")), "event_id", "left")
