"""One row of metrics for each project: what rules and reports read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import audit, costs, metrics
from tracemill.sources import bindings
from tracemill.sources.scratch import exists, state_of, written

#: Columns that are flags; the others are numbers.
FLAGS = ("full_local", "beyond_loopback", "external_provider")


def tools(activity: DataFrame) -> DataFrame:
    """By project: largest output, failure rate, the tool with most failures, and how often things are read or searched for again; what was done to each thing is counted in one pass."""
    things = activity.groupBy("project_id", "kind", "path_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failed"), F.max("size").alias("largest"))
    often = F.when(F.col("n") >= metrics.REPEAT_THRESHOLD, F.col("n")).otherwise(0)
    each = things.groupBy("project_id", "kind").agg(F.sum("n").alias("calls"), F.sum("failed").alias("failures"), F.max("largest").alias("largest"), F.max("n").alias("top"), F.sum(often).alias("repeated"))
    worst = F.max(F.struct("failures", (F.col("failures") / F.col("calls")).alias("rate")))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return each.groupBy("project_id").agg(
        F.max("largest").alias("max_output"), F.round(F.sum("failures") / F.sum("calls"), 6).alias("failure_rate"), worst["failures"].alias("worst_tool_failures"), F.round(worst["rate"], 6).alias("worst_tool_rate"),
        of("read", "top").alias("repeated_read_top"), of("read", "repeated").alias("sum_repeated_reads"), of("prompt", "top").alias("repeated_search_top"), of("prompt", "repeated").alias("sum_repeated_searches"),
    )


def commands(ran: DataFrame) -> DataFrame:
    """By project: tests, builds and broad tests, how often the most repeated command ran, and the most failed one failed.

    Commands (project_id, command, success) are counted before they are looked
    into, so that each is classified and hashed once, whichever task read it.
    """
    counted = ran.groupBy("project_id", "command").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failed"))
    kinds = text.command_columns(F.col("command"))
    counted = text.once(counted, **{c: kinds[c] for c in ("classification", "scope", "command_hash")})
    test, of = F.col("classification") == "test", lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    each = counted.groupBy("project_id", "command_hash").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), of(test).alias("tests"), of(F.col("classification") == "build").alias("builds"), of(test & (F.col("scope") == "broad")).alias("broad_tests"))
    return each.groupBy("project_id").agg(*(F.sum(c).alias(c) for c in ("tests", "builds", "broad_tests")), F.max("n").alias("repeated_command_top"), F.max("failed").alias("repeated_failed_top"))


def models(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """By project: requests, tiers of the model with most of them, and tokens; requests are summed by project and model once."""
    sums = written(requests.groupBy("project_id", "model_id").agg(F.count(F.lit(1)).alias("requests"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "cache_read_tokens"))), "requests")
    dominant = costs.dominant_of(sums)
    tiers = dominant.join(costs.tiers(sums, costs.catalogue(spark)), "model_id").select("project_id", "requests", F.col("cost_tier").alias("dominant_cost_tier"), F.col("capability").alias("dominant_capability"))
    return in_one([sums.groupBy("project_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens")), tiers])


def in_one(parts: list[DataFrame]) -> DataFrame:
    """parts, each with at most a row for a project, side by side: one aggregation, however many they are."""
    rows = reduce(lambda above, below: above.unionByName(below, allowMissingColumns=True), parts)
    return rows.groupBy("project_id").agg(*(F.max(c).alias(c) for c in rows.columns if c != "project_id"))


def project_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of the bound tables, by project; a project without rows in a table has zeros there.

    Each table is read once or twice: what several metrics need is summed up
    first, and paths, which are only told apart here, aren't hashed.
    """
    a = bindings.activity(spark, sf_dir).withColumn("path_hash", F.col("path"))
    s = written(metrics.session_workflow(a), "session-workflow")
    sessions = s.select("project_id", "started_at", (F.col("ended_at") - F.col("started_at")).alias("duration_ms"), "prompts", "tool_calls", "compactions", bindings.completion(F.col("last_event")).alias("completion"))
    usage = metrics.usage(sessions).select("project_id", "sessions", "median_ms", "prompts_per_session", "tools_per_session", "compactions", "completed", "failed", "interrupted")
    flow = metrics.workflow_totals(s).drop("verification_runs")
    p = bindings.prompts(spark, sf_dir).withColumn("project_id", F.col("session_id") % 10)
    p = p.withColumns(text.prompt_features(F.col("content"), F.col("sequence")))
    said = p.groupBy("project_id").agg(F.count(F.lit(1)).alias("prompt_count"), F.count_if("criteria").alias("criteria_prompts"), F.count_if("asks_verification").alias("verify_prompts"), F.count_if("multi_task").alias("multi_prompts"), F.sum("vague").cast("long").alias("vague_refs"), F.count_if("corrective").alias("correction_prompts"))
    paths = metrics.sensitive_access(text.once(bindings.touched(spark, sf_dir).drop("path_hash"), clean=text.clean_path(F.col("path"))).withColumns({"path": F.col("clean"), "path_hash": F.col("clean")}))
    paths = paths.groupBy("project_id").agg(F.max("operations").alias("sensitive_ops"))
    found = bindings.texts(spark, sf_dir).groupBy("project_id").agg(F.sum(F.size(text.markers(text.redact(F.col("text"), emails=True)))).cast("long").alias("secret_findings"))
    parts = [usage, flow, tools(a), commands(bindings.commands(spark, sf_dir)), models(spark, bindings.model_requests(spark, sf_dir)), said, paths, found, audit.configuration(bindings.settings(spark, sf_dir))]
    return in_one([x.where("project_id is not null") for x in parts]).where("sessions is not null").na.fill(0).na.fill(False)


_made: dict[tuple[str, str], tuple[str, DataFrame]] = {}
TABLES = "events lineitem orders conversations part pages documents customer".split()


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_snapshots(), written once: rules, reports and lists all read it, for as long as the files of the tables it is made of, and its own, stay as they are."""
    key = (spark.sparkContext.applicationId, sf_dir)
    state = "|".join(state_of(spark, f"{sf_dir}/{t}.parquet") for t in TABLES)
    if key not in _made or _made[key][0] != state or not all(exists(spark, f) for f in _made[key][1].inputFiles()):
        _made[key] = (state, written(project_snapshots(spark, sf_dir), "snapshots"))
    return _made[key][1]


def scoped(snapshots: DataFrame, scopes: DataFrame) -> DataFrame:
    """A row for each of scopes (project_id), with zeros where the snapshots have none: an empty window is a row of zeros."""
    return scopes.select("project_id").distinct().join(snapshots, "project_id", "left").na.fill(0).na.fill(False)


def by_scope(activity: DataFrame) -> DataFrame:
    """Snapshots at two grains in one pass over activity: of each project (session_id null), and of each of its sessions.

    Grouping sets count what was done to each thing at both grains at once; the
    second aggregation is over those counts alone. Metrics that activity doesn't
    have are left out, and so are the rules that need them.
    """
    things = activity.groupingSets([["project_id", "session_id", "kind", "path_hash"], ["project_id", "kind", "path_hash"]], "project_id", "session_id", "kind", "path_hash").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failed"), F.max("size").alias("largest"), F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    often = F.when(F.col("n") >= metrics.REPEAT_THRESHOLD, F.col("n"))
    kind = lambda k: F.col("kind") == k
    tools = things.groupBy("project_id", "session_id", "kind").agg(
        F.sum("n").alias("calls"), F.sum("failed").alias("failures"), F.max("largest").alias("largest"), F.sum("errors").alias("errors"), F.max("n").alias("top"), F.sum(often).alias("repeated"),
    )
    worst = F.max(F.struct("failures", (F.col("failures") / F.col("calls")).alias("rate")))
    out = tools.groupBy("project_id", "session_id").agg(
        F.sum("errors").alias("compactions"), F.max("largest").alias("max_output"), F.round(F.sum("failures") / F.sum("calls"), 6).alias("failure_rate"), worst["failures"].alias("worst_tool_failures"), F.round(worst["rate"], 6).alias("worst_tool_rate"),
        F.max(F.when(kind("read"), F.col("top"))).alias("repeated_read_top"), F.max(F.when(kind("read"), F.col("repeated"))).alias("sum_repeated_reads"), F.max(F.when(kind("prompt"), F.col("top"))).alias("repeated_search_top"),
        F.max(F.when(kind("prompt"), F.col("repeated"))).alias("sum_repeated_searches"),
    )
    sessions = activity.groupBy("project_id").agg(F.count_distinct("session_id").alias("of_project"))
    return out.join(sessions, "project_id").withColumn("sessions", F.when(F.col("session_id").isNull(), F.col("of_project")).otherwise(1)).drop("of_project").na.fill(0)
