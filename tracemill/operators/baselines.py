"""Robust baselines of sessions, and how a session departs from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.medians import medians

DIMENSIONS = ("duration_ms", "tool_calls", "tests", "read_write_ratio", "largest_output", "compactions", "models", "corrective_turns", "prompts")
SCOPES = ("personal", "project", "recent")
DEVIANT, RECENT_SESSIONS = 1.5, 10
TEST_KINDS = ("test", "unit-test")


def session_points(sessions: DataFrame, requests: DataFrame, tools: DataFrame, files: DataFrame, commands: DataFrame, verifications: DataFrame, prompts: DataFrame) -> DataFrame:
    """A row for each session: project_id, session_id, started_at and the columns of DIMENSIONS.

    The tables hang on session_id: requests (model_id), tools, files (operation),
    commands (output_bytes), verifications (kind, ts, success), prompts (ts). Each
    is summed up before it is joined. A session without rows in a table has zeros
    there; without writes it has no ratio, without output no largest one.
    """
    key, one = "session_id", F.count(F.lit(1))
    failed = verifications.where(~F.col("success")).groupBy(key).agg(F.min("ts").alias("first_failure"))
    parts = [
        requests.groupBy(key).agg(F.count_distinct("model_id").alias("models")), tools.groupBy(key).agg(one.alias("tool_calls")),
        files.groupBy(key).agg((F.count_if(F.col("operation") == "read") / F.nullif(F.count_if(F.col("operation").isin("write", "edit")), F.lit(0))).alias("read_write_ratio")),
        commands.groupBy(key).agg(F.nullif(F.max(F.coalesce("output_bytes", F.lit(0))), F.lit(0)).alias("largest_output")), verifications.groupBy(key).agg(F.count_if(F.col("kind").isin(*TEST_KINDS)).alias("tests")),
        prompts.join(failed, key).where("ts > first_failure").groupBy(key).agg(one.alias("corrective_turns")),
    ]
    out = reduce(lambda s, p: s.join(p, key, "left"), parts, sessions.select("project_id", key, "started_at", "duration_ms", "compactions", "prompts"))
    return out.na.fill(0, ["models", "tool_calls", "tests", "corrective_turns"]).select("project_id", key, "started_at", *(F.col(d).cast("double").alias(d) for d in DIMENSIONS))


def points(found: DataFrame) -> DataFrame:
    """(project_id, session_id, dimension, value): a row for each dimension, null values too."""
    return found.unpivot(["project_id", "session_id"], list(DIMENSIONS), "dimension", "value")


def recent(found: DataFrame, most: int = RECENT_SESSIONS) -> DataFrame:
    """The sessions that started last (a top-k)."""
    return found.orderBy(F.desc("started_at"), F.desc("session_id")).limit(most)


def scoped(found: DataFrame, most: int = RECENT_SESSIONS) -> DataFrame:
    """Session points under each scope that counts them: all sessions, those of a project, the recent ones. scope_key is the project."""
    none = F.lit(None).cast(found.schema["project_id"].dataType)
    each = F.array(F.struct(F.lit("personal").alias("scope"), none.alias("scope_key")), F.struct(F.lit("project").alias("scope"), F.col("project_id").alias("scope_key")))
    both = found.withColumn("at", F.explode(each)).select("at.scope", "at.scope_key", *found.columns)
    return both.unionByName(recent(found, most).select(F.lit("recent").alias("scope"), none.alias("scope_key"), *found.columns))


def baselines(found: DataFrame, most: int = RECENT_SESSIONS) -> DataFrame:
    """Median, median absolute deviation (mad) and sample size of each scope and dimension that has a value."""
    key = ["scope", "scope_key", "dimension"]
    rows = scoped(found, most).unpivot(["scope", "scope_key", "session_id"], list(DIMENSIONS), "dimension", "value").where("value is not null")
    middle = medians(rows, key, "value")
    away = rows.join(middle.withColumnsRenamed({k: f"m_{k}" for k in key}), (F.col("scope") == F.col("m_scope")) & F.col("scope_key").eqNullSafe(F.col("m_scope_key")) & (F.col("dimension") == F.col("m_dimension")))
    spread = medians(away.withColumn("away", F.abs(F.col("value") - F.col("median"))), key, "away", "mad").withColumnsRenamed({k: f"s_{k}" for k in key}).drop("n")
    met = middle.join(spread, (F.col("scope") == F.col("s_scope")) & F.col("scope_key").eqNullSafe(F.col("s_scope_key")) & (F.col("dimension") == F.col("s_dimension")))
    return met.select(*key, "median", "mad", "n", F.when(F.col("n") == 1, "reported").otherwise("inferred").alias("provenance"))


def _round3(x: Column) -> Column:
    """Three places as SQL's round takes them: a whole number of thousandths of the double itself, not of its decimal digits."""
    return F.round(x * 1000) / 1000


def compare(found: DataFrame, base: DataFrame, deviant: float = DEVIANT) -> DataFrame:
    """Ratio, score and direction of every session and dimension against each baseline that has the dimension.

    A ratio to a median of zero is infinite, or zero for a value of zero. A
    session without a value has score 0, no ratio and an unknown direction.
    """
    rows, b = points(found), base.withColumnsRenamed({"dimension": "b_dimension"})
    met = rows.join(b, (F.col("dimension") == F.col("b_dimension")) & ((F.col("scope") != "project") | (F.col("scope_key") == F.col("project_id"))))
    value, away = F.col("value"), F.abs(F.col("value") - F.col("median"))
    score = F.when(value.isNull(), 0.0).when(F.col("mad") > 0, away / F.col("mad")).when(away == 0, 0.0).otherwise(1.0)
    ratio = F.when(F.col("median") != 0, _round3(value / F.col("median"))).when(value > 0, float("inf")).when(value.isNotNull(), 0.0)
    out = met.withColumns({"score": score, "ratio": ratio})
    direction = F.when(value.isNull(), "unknown").when(F.col("score") < deviant, "typical").when(value > F.col("median"), "higher").otherwise("lower")
    return out.select("session_id", "scope", "dimension", "value", "median", "mad", "ratio", _round3(F.col("score")).alias("score"), direction.alias("direction"))


def model_distribution(requests: DataFrame, found: DataFrame, most: int = RECENT_SESSIONS) -> DataFrame:
    """Share of requests of each model (four places), by scope."""
    of = scoped(found, most).select("scope", "scope_key", "session_id")
    n = requests.join(of, "session_id").groupBy("scope", "scope_key", "model_id").agg(F.count(F.lit(1)).alias("requests"))
    total = n.groupBy("scope", "scope_key").agg(F.sum("requests").alias("total")).withColumnsRenamed({"scope": "t_scope", "scope_key": "t_key"})
    return n.join(total, (F.col("scope") == F.col("t_scope")) & F.col("scope_key").eqNullSafe(F.col("t_key"))).select("scope", "scope_key", "model_id", "requests", F.round(F.col("requests") / F.col("total"), 4).alias("share"))


def relative_durations(found: DataFrame) -> DataFrame:
    """Each session's duration against the upper median of all positive durations."""
    everyone = found.withColumn("everyone", F.lit(1))
    middle = medians(everyone.where("duration_ms > 0"), ["everyone"], "duration_ms", "personal_median", upper=True).select("everyone", "personal_median")
    relative = F.when((F.col("personal_median") > 0) & (F.col("duration_ms") > 0), F.concat(F.format_string("%.2f", F.col("duration_ms") / F.col("personal_median")), F.lit("× personal median")))
    return everyone.select("everyone", "session_id", "duration_ms").join(F.broadcast(middle), "everyone", "left").withColumn("relative", relative).drop("everyone")
