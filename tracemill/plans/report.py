"""Reports and exports of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import formats

#: Sections of figures: column, and how it is shown (number, duration, percent).
SECTIONS = {
    "Usage": (("sessions", "number"), ("median_ms", "duration"), ("prompts_per_session", "number"), ("tools_per_session", "number"), ("input_tokens", "number"), ("cache_read_tokens", "number"), ("compactions", "number")),
    "Verification quality": (("changed_unverified", "number"), ("ended_verified", "number"), ("ended_failed", "number"), ("changed_after_verification", "number"), ("corrective_prompts", "number")),
    "Tool efficiency": (("failure_rate", "percent"), ("max_output", "number"), ("tests", "number"), ("builds", "number"), ("repeated_read_top", "number"), ("repeated_command_top", "number")),
    "Data completeness": (("completed", "number"), ("failed", "number"), ("interrupted", "number")),
}
MOST_IMPORTANT, MOST_RECOMMENDED = 5, 20
DISCLAIMER = "Costs are estimates from a price list."
NOTHING = "_none_"


def _findings(recommendations: DataFrame) -> DataFrame:
    """project_id and its recommendations as lines, best first."""
    line = F.concat(F.lit("- "), F.col("rule_id"), F.lit(" ("), F.col("severity"), F.lit(", "), formats.percent(F.col("confidence")), F.lit(")"))
    rows = recommendations.select("project_id", F.struct((-F.col("score")).alias("score"), F.col("rule_id"), line.alias("line")).alias("r"))
    return rows.groupBy("project_id").agg(F.transform(F.slice(F.array_sort(F.collect_list("r")), 1, MOST_RECOMMENDED), lambda r: r["line"]).alias("lines"))


def markdown(snapshots: DataFrame, recommendations: DataFrame, privacy_mode: str = "redacted-content", source: str = "events") -> DataFrame:
    """project_id and its report as Markdown, in nine sections.

    recommendations (project_id, rule_id, severity, confidence, score) should be
    ranked by project, so that a project has a bounded number.
    """
    found = snapshots.join(_findings(recommendations), "project_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    listed = lambda n: F.when(F.size("lines") == 0, NOTHING).otherwise(F.array_join(F.slice("lines", 1, n), "\n"))
    figures = lambda title: [F.concat(F.lit(f"| {c} | "), getattr(formats, how)(F.col(c)), F.lit(" |")) for c, how in SECTIONS[title]]
    head = lambda title: F.lit(f"\n## {title}\n")
    parts = [F.concat(F.lit("# Project "), F.col("project_id").cast("string")), head("Summary"), F.concat(F.lit("- Sessions: "), formats.number(F.col("sessions"))), F.lit(f"- {DISCLAIMER}")]
    for title in ("Usage", "Most important findings", "Verification quality", "Tool efficiency", "Data completeness", "Top recommendations"):
        parts += [head(title), *(figures(title) if title in SECTIONS else [listed(MOST_IMPORTANT if title.startswith("Most") else MOST_RECOMMENDED)])]
    parts += [head("Privacy mode"), F.lit(f"`{privacy_mode}`"), head("Scan provenance"), F.concat(F.lit(f"| {source} | "), formats.number(F.col("sessions")), F.lit(" |"))]
    return found.select("project_id", F.concat_ws("\n", *parts).alias("report"))


def as_json(snapshots: DataFrame, privacy_mode: str = "redacted-content") -> DataFrame:
    """project_id and its snapshot as JSON, a section for each group of figures, which are numbers as they are, with the cost disclaimer beside them."""
    section = lambda names: F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{c}":'), formats.json_number(F.col(c))) for c, _ in names)), F.lit("}"))
    parts = [F.concat(F.lit(f'"{title.lower().replace(" ", "_")}":'), section(names)) for title, names in SECTIONS.items()]
    said = F.to_json(F.struct(F.lit(privacy_mode).alias("privacy_mode"), F.lit(DISCLAIMER).alias("cost_disclaimer")))
    return snapshots.select("project_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit(","), F.substring(said, 2, 1 << 20)).alias("report"))


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table (sessions, projects, recommendations) as JSON lines in its own folder below path, beside a manifest of rows; the manifest."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest = status({name: spark.read.text(f"{path}/{name}") for name in tables})
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
