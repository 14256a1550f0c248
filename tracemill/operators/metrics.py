"""Usage, tool, workflow and prompt metrics, by project and over all (project_id null)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators.medians import attach
from tracemill.sources.scratch import written

REPEAT_THRESHOLD = 3
DAY_MS = 86_400_000


def usage(sessions: DataFrame, window_days: float | None = None) -> DataFrame:
    """Sessions, active days, rates, durations, and how much of the durations is known, by project and over all.

    Rates are over window_days, or the active days (one at least). Days are
    summed up first, so that distinct days are counted over few rows.
    """
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    when = lambda state: F.count_if(F.col("completion") == state).alias(state)
    daily = sessions.groupBy("project_id", F.floor(F.col("started_at") / DAY_MS).alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count("duration_ms").alias("timed"), *map(total, ("duration_ms", "prompts", "tool_calls", "compactions")), when("completed"), when("failed"), when("interrupted"),
    )
    n, days = F.sum("sessions"), F.greatest(F.count_distinct("day"), F.lit(1))
    span = F.lit(float(window_days)) if window_days else days
    out = daily.rollup("project_id").agg(
        n.alias("sessions"), days.alias("active_days"), F.round(n / span, 6).alias("per_day"), F.round(n / F.greatest(span / 7, F.lit(1 / 7)), 6).alias("per_week"), F.round(n / F.greatest(span / 30, F.lit(1 / 30)), 6).alias("per_month"),
        F.sum("duration_ms").alias("total_ms"), F.round(F.sum("duration_ms") / F.sum("timed"), 6).alias("mean_ms"), _coverage(F.sum("timed"), n).alias("duration_provenance"), F.round(F.sum("prompts") / n, 6).alias("prompts_per_session"), F.round(F.sum("tool_calls") / n, 6).alias("tools_per_session"),
        F.sum("compactions").alias("compactions"), F.sum("completed").alias("completed"), F.sum("failed").alias("failed"), F.sum("interrupted").alias("interrupted"), (n - F.sum("completed") - F.sum("failed") - F.sum("interrupted")).alias("unknown"),
    )
    return attach(out, sessions, "project_id", median_ms="duration_ms")


def _coverage(known: F.Column, all_of: F.Column) -> F.Column:
    """What a figure rests on: exact if all rows have a value, inferred if some, unknown if none."""
    return F.when(known == 0, "unknown").when(known < all_of, "inferred").otherwise("exact")


def token_totals(requests: DataFrame) -> DataFrame:
    sums = {r: F.sum(F.coalesce(F.col(f"{r}_tokens"), F.lit(0))) for r in ("input", "output", "cache_read", "cache_write")}
    return requests.rollup("project_id").agg(*(c.alias(f"{r}_tokens") for r, c in sums.items()), sum(list(sums.values())[1:], sums["input"]).alias("total_tokens"), F.count_if(F.col("cache_read_tokens").isNull()).alias("without_cache_tokens"))


def tool_usage(activity: DataFrame) -> DataFrame:
    failures = F.count_if(~F.col("success"))
    return activity.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"), failures.alias("failures"), F.round(failures / F.count(F.lit(1)), 6).alias("failure_rate"), F.round(F.sum("size") / F.count(F.lit(1)), 4).alias("mean_size"), F.max("size").alias("largest_size")
    ).orderBy(F.desc("calls"), "event_type")


def repeated(rows: DataFrame, key: str, threshold: int = REPEAT_THRESHOLD) -> DataFrame:
    """Keys that occur threshold times or more within a project: occurrences, distinct sessions, label of the first."""
    found = rows.groupBy("project_id", key).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("session_id").alias("sessions"), F.min_by("path", F.struct("ts", "event_id")).alias("label"))
    return found.where(F.col("occurrences") >= threshold).orderBy(F.desc("occurrences"), key)


def session_workflow(activity: DataFrame) -> DataFrame:
    """What the usage and workflow metrics need of each session, over one shuffle of activity by session.

    Two windows tell new paths among a session's edits, and put its last edit and
    first failure beside its rows; they share one order, in which the aggregation
    runs as well. verify_kinds is 0, 1, or 2 for more.
    """
    write, verify = F.col("kind") == "edit", F.col("kind") == "verify"
    session = Window.partitionBy("session_id", "project_id")
    rows = activity.select("session_id", "project_id", "ts", "event_id", "kind", "event_type", "success", F.when(write, F.col("path_hash")).alias("edited"))
    rows = rows.withColumn("new_path", F.col("edited").isNotNull() & ~F.col("edited").eqNullSafe(F.lag("edited").over(session.orderBy("edited")))).drop("edited")
    rows = rows.withColumns({"last_write": F.max(F.when(write, F.col("ts"))).over(session), "first_failure": F.min(F.when(verify & ~F.col("success"), F.col("ts"))).over(session)})
    checked = F.when(verify, F.col("event_type"))
    return rows.groupBy("session_id", "project_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count_if("new_path").alias("written"), F.count_if(F.col("kind") == "read").alias("reads"), F.count_if(write).alias("writes"),
        F.min(F.when(write, F.col("ts"))).alias("first_write"), F.max("last_write").alias("last_write"), F.count_if(verify).alias("verifications"), F.max(F.when(verify, F.col("ts"))).alias("last_verify"),
        F.max_by(F.when(verify, F.col("success")), F.when(verify, F.struct("ts", "event_id"))).alias("last_success"), F.min("first_failure").alias("first_failure"),
        F.when(F.min(checked).isNull(), 0).when(F.min(checked) == F.max(checked), 1).otherwise(2).alias("verify_kinds"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"),
        F.min(F.when(verify & (F.col("ts") > F.col("last_write")), F.col("ts"))).alias("next_verify"), F.count_if((F.col("kind") == "prompt") & (F.col("ts") > F.col("first_failure"))).alias("corrective_prompts"),
        F.count_if(F.col("kind") == "prompt").alias("prompts"), F.count_if(F.col("kind") != "prompt").alias("tool_calls"), F.count_if(F.col("event_type") == "error").alias("compactions"),
    )


def workflow_totals(sessions: DataFrame) -> DataFrame:
    """Verification and edit metrics of session_workflow(), by project and over all."""
    verified, wrote = F.col("verifications") > 0, F.col("writes") > 0
    return sessions.where("session_id is not null").rollup("project_id").agg(
        F.round(F.sum("written") / F.count(F.lit(1)), 6).alias("files_per_session"), F.round(F.sum("reads") / F.nullif(F.sum("writes"), F.lit(0)), 6).alias("read_write_ratio"), F.sum("verifications").alias("verification_runs"),
        F.count_if(wrote & ~verified).alias("changed_unverified"), F.count_if((F.col("written") >= 3) & (F.col("verify_kinds") <= 1)).alias("narrow_only"),
        F.count_if(verified & F.col("last_success") & (F.col("last_event") == "purchase")).alias("ended_verified"), F.count_if(verified & (~F.col("last_success") | (F.col("last_event") == "error"))).alias("ended_failed"),
        F.count_if(verified & (F.col("last_write") > F.col("last_verify"))).alias("changed_after_verification"), F.sum("corrective_prompts").alias("corrective_prompts"),
    )


def workflow(activity: DataFrame) -> DataFrame:
    """Verification and edit metrics with medians, by project and over all; what they need of each session is made once."""
    s = written(session_workflow(activity).where("session_id is not null"), "session-workflow")
    gaps = s.select("project_id", (F.col("first_write") - F.col("started_at")).alias("to_edit"), F.when(F.col("verifications") > 0, F.col("next_verify") - F.col("last_write")).alias("to_verify"))
    return attach(workflow_totals(s), gaps, "project_id", median_to_first_edit="to_edit", median_edit_to_verification="to_verify")


def touched_between_reads(activity: DataFrame) -> DataFrame:
    """Reads of a path, with whether it was edited since the read before it in the session."""
    path = Window.partitionBy("session_id", "path_hash").orderBy("ts", "event_id")
    edits = F.sum((F.col("kind") == "edit").cast("int")).over(path.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reads = activity.where(F.col("kind").isin("read", "edit")).withColumn("edits", edits).where("kind = 'read'")
    return reads.withColumn("intervening", F.col("edits") > F.lag("edits").over(path)).select("event_id", "session_id", "path_hash", "intervening")


def code_changed_after(activity: DataFrame) -> DataFrame:
    """Verification runs, with whether the session edits a file later."""
    last = F.max(F.when(F.col("kind") == "edit", F.col("ts"))).over(Window.partitionBy("session_id"))
    return activity.withColumn("last_edit", last).where("kind = 'verify'").select("event_id", "session_id", "success", F.coalesce(F.col("last_edit") > F.col("ts"), F.lit(False)).alias("code_changed_after"))


def carry_forward(rows: DataFrame) -> DataFrame:
    """Place rows (session_id, line, raw_ts as text) in time: a missing one takes the last valid one, an invalid one drops the row."""
    got = F.expr("try_cast(raw_ts as bigint)")
    before = F.last(got, ignorenulls=True).over(Window.partitionBy("session_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    missing = F.col("raw_ts").isNull() | (F.col("raw_ts") == "")
    return rows.withColumn("ts", F.when(missing, before).otherwise(got)).where("ts is not null").select("session_id", "line", "ts")


def pair_calls(rows: DataFrame) -> DataFrame:
    """Match tool uses with results (session_id, call_id, is_use, ts, event_id).

    A use whose next row of that id is a result is matched; one followed by a use
    is overwritten; one followed by nothing is partial. A result that doesn't
    follow a use is an orphan.
    """
    w = Window.partitionBy("session_id", "call_id").orderBy("ts", "event_id")
    after, before = F.lead("is_use").over(w), F.lag("is_use").over(w)
    state = F.when(F.col("is_use"), F.when(after.isNull(), "partial").when(after, "overwritten").otherwise("matched")).when(F.coalesce(before, F.lit(False)), None).otherwise("orphan")
    done = F.when(F.col("is_use") & ~after, F.lead("ts").over(w) - F.col("ts"))
    return rows.select("session_id", "call_id", "event_id", state.alias("state"), done.alias("duration_ms")).where("state is not null")


def timeline(sources: dict[str, tuple[int, DataFrame]]) -> DataFrame:
    """Event tables (session_id, ts, id) in one, by time, then the rank of the table."""
    parts = [df.select("session_id", "ts", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.col("id").cast("string").alias("id")) for kind, (rank, df) in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "rank", "id")).cast("long"))


#: Order of event tables at one time; prompts lie ten apart by their number.
RANKS = {"prompt": 0, "model": 1, "tool": 2, "file": 3, "command": 4, "verification": 5, "compaction": 6}


def session_timeline(prompts: DataFrame, requests: DataFrame, calls: DataFrame, files: DataFrame, commands: DataFrame, verifications: DataFrame, compactions: DataFrame) -> DataFrame:
    """The seven tables of events in one: session_id, ts, kind, label, position; by time, then by table, prompts by their number."""
    part = lambda df, kind, label, rank=None: df.select("session_id", "ts", F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label"), (F.lit(RANKS[kind]) if rank is None else rank).cast("long").alias("rank"))
    parts = [
        part(prompts, "prompt", "content_hash", F.col("sequence") * 10), part(requests, "model", "message_id"), part(calls, "tool", "call_id"), part(files, "file", "id"), part(commands, "command", "id"), part(verifications, "verification", "id"), part(compactions, "compaction", "trigger"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("session_id").orderBy("ts", "rank", "kind", "label")
    return out.withColumn("position", F.row_number().over(order).cast("long")).drop("rank")


def sensitive_access(files: DataFrame) -> DataFrame:
    """Paths that hold secrets and were worked on (project_id, session_id, path, path_hash, operation): kind, operations, sessions, operations seen, by path."""
    rows = files.withColumn("kind", text.sensitive_kind(F.col("path"))).where("kind is not null")
    found = rows.groupBy("project_id", "path_hash").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("operations"), F.count_distinct("session_id").alias("sessions"), F.array_sort(F.collect_set("operation")).alias("operations_seen"))
    return found.withColumn("kind", text.sensitive_kind(F.col("path"))).orderBy(F.desc("operations"), "path_hash")


def secret_markers(texts: list[DataFrame]) -> DataFrame:
    """Markers that redaction left in texts (session_id, text), all tables together: label, category, how many, in how many sessions."""
    rows = texts[0].select("session_id", "text")
    for t in texts[1:]:
        rows = rows.unionByName(t.select("session_id", "text"))
    found = rows.select("session_id", F.explode(text.markers(F.col("text"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("session_id").alias("sessions"))
    return found.select("label", text.category(F.col("label")).alias("category"), "findings", "sessions").orderBy(F.desc("findings"), "label")


#: Tools whose calls are searches.
SEARCHES = ("Grep", "Glob", "WebSearch", "WebFetch")


def tool_behaviour(calls: DataFrame) -> DataFrame:
    """Calls, failures, mean duration and largest input and output of each tool, and of all (tool null), from tool calls as they are loaded; most calls first."""
    failed = F.count_if(~F.col("success"))
    out = calls.rollup("tool").agg(
        F.count(F.lit(1)).alias("calls"), failed.alias("failures"), F.round(failed / F.count(F.lit(1)), 6).alias("failure_rate"), F.round(F.avg("duration_ms"), 4).alias("mean_duration_ms"),
        F.max("input_bytes").alias("largest_input"), F.max("output_bytes").alias("largest_output"), F.count("attribution").alias("subagent_calls"),
    )
    return out.orderBy(F.desc("calls"), "tool")


def repeated_searches(calls: DataFrame, key: str, threshold: int = REPEAT_THRESHOLD) -> DataFrame:
    """Searches with the same tool and input that a scope (key) makes threshold times or more, and in how many sessions."""
    found = calls.where(F.col("tool").isin(*SEARCHES)).groupBy(key, "tool", "input_hash").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("session_id").alias("sessions"))
    return found.where(F.col("occurrences") >= threshold)


def top(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The most frequent values of a column, ties by name: place, name, n (a top-k)."""
    best = rows.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "name"))).select("place", "name", "n")  # over most rows
