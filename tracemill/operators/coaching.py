"""What became of prompts, and advice on them. Functions without arguments read the columns that text.prompt_features makes, and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text

#: What a prompt may lack, and how it is put to the user.
COMPONENTS = {
    "objective": "what is to be done", "target": "the file or symbol it is about", "acceptanceCriteria": "when it is done", "verificationRequest": "how it is checked", "scopeBoundary": "what stays as it is", "taskSplit": "one prompt for each task",
}
DISCLAIMER = "Put together from what the prompt states; it need not work better."


def outcome_evidence(prompts: DataFrame, files: DataFrame | None = None, verifications: DataFrame | None = None) -> DataFrame:
    """For each prompt (with its features): later corrective and reversal prompts of the session, rows of files in it, and whether it ran a check."""
    later = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(1, Window.unboundedFollowing)
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")).over(later), F.lit(0))
    out = prompts.select("session_id", "sequence", count("corrective").alias("later_corrections"), count("reversal").alias("later_reversals"))
    if files is not None:
        out = out.join(files.groupBy("session_id").agg(F.count(F.lit(1)).alias("files_inspected")), "session_id", "left").na.fill(0, ["files_inspected"])
    if verifications is not None:
        ran = verifications.select("session_id").distinct().withColumn("ran", F.lit(True))
        out = out.join(ran, "session_id", "left").withColumn("verification_ran", F.coalesce("ran", F.lit(False))).drop("ran")
    return out


def outcome_lines() -> Column:
    """The columns of outcome_evidence() in words."""
    n = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}")))
    found = F.array_compact(F.array(n("later_corrections", "corrective prompts followed"), n("later_reversals", "reversals followed"), F.when(F.col("verification_ran"), "a check ran in the session")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("nothing of note followed")))


def _named(conditions: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def missing_components() -> Column:
    """What a prompt with these features doesn't state, in the order of COMPONENTS."""
    said = F.col("length") > 0
    return _named({
        "objective": (F.col("imperatives") == 0) & said, "target": (F.col("file_refs") == 0) & said, "acceptanceCriteria": ~F.col("criteria"), "verificationRequest": ~F.col("asks_verification"), "scopeBoundary": ~F.col("scoped"), "taskSplit": F.col("multi_task"),
    })


def strengths() -> Column:
    return _named({
        "begins with what to do": F.col("imperatives") > 0, "names its target": F.col("file_refs") > 0, "says when it is done": F.col("criteria"), "asks for a check": F.col("asks_verification"), "bounds its scope": F.col("scoped"),
        "has one aim": (F.col("length") > 0) & ~F.col("multi_task"),
    })


def ambiguities() -> Column:
    return _named({
        "vague references": F.col("vague") > 0, "no target": (F.col("file_refs") == 0) & (F.col("length") > 0), "no criteria": ~F.col("criteria"), "no check": ~F.col("asks_verification"), "several tasks": F.col("multi_task"), "no bounds": ~F.col("scoped"),
    })


def signals() -> Column:
    """The features as evidence: an array of (label, value)."""
    names = ("imperatives", "file_refs", "vague", "criteria", "asks_verification", "scoped", "multi_task", "corrective", "reversal", "complexity", "length")
    return F.array(*(F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("value")) for n in names))


def labels(components: Column) -> Column:
    """Components as they are put to the user."""
    words = F.create_map(*(F.lit(x) for kv in COMPONENTS.items() for x in kv))
    return F.array_distinct(F.transform(components, lambda c: words[c]))


def _parts() -> dict[str, Column]:
    content, flat = F.col("content"), lambda x: F.regexp_replace(F.trim(x), r"\s+", " ")
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    lead = lambda x: F.regexp_replace(F.lower(F.get(F.split(x, r"\s+"), F.lit(0))), "[^a-z]", "")
    order = F.get(F.filter(lines, lambda x: lead(x).isin(text.IMPERATIVES)), F.lit(0))
    sentence = F.regexp_extract(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"^([^.!?]*[.!?]?)", 1)
    items = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*([-*]|\d+[.)])\s+", ""))), lambda x: x != "")
    refs = F.filter(F.regexp_extract_all(content, F.lit("(`[^`\\n]+`)"), F.lit(1)), lambda x: x.rlike("[./]"))
    return {"aim": flat(F.coalesce(order, sentence)), "items": items, "refs": refs}


def suggested_structure() -> Column:
    """The prompt's aim or tasks, and a line for target, criteria, check and bounds, to be filled in where it lacks them."""
    p = _parts()
    tasks = F.concat(F.lit("Tasks, one prompt each:\n  - "), F.array_join(p["items"], "\n  - "))
    aim = F.when(F.col("multi_task"), F.when(F.size(p["items"]) >= 2, tasks).otherwise("[one aim]")).when(p["aim"] == "", "[the aim]").otherwise(p["aim"])
    return F.concat_ws("\n", aim, F.when(F.size(p["refs"]) > 0, F.concat(F.lit("Target: "), F.array_join(p["refs"], ", "))).otherwise("Target: [file or symbol]"), F.when(F.col("criteria"), "Done when: as stated").otherwise("Done when: [criteria]"),
        F.when(F.col("asks_verification"), "Check: as stated").otherwise("Check: run the tests and report"), F.when(F.col("scoped"), "Bounds: as stated").otherwise("Bounds: change the target alone"))


def suggested_missing() -> Column:
    """Components that suggested_structure() leaves to be filled in, or splits."""
    p = _parts()
    bundled = F.col("multi_task")
    return _named({
        "taskSplit": bundled, "objective": F.when(bundled, F.size(p["items"]) < 2).otherwise(p["aim"] == ""), "target": F.size(p["refs"]) == 0, "acceptanceCriteria": ~F.col("criteria"), "verificationRequest": ~F.col("asks_verification"), "scopeBoundary": ~F.col("scoped"),
    })


def comparison(prompts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each prompt (with features) beside what became of it and how it could be put: strengths, ambiguities, missing, outcome, suggestion, disclaimer."""
    met = prompts.join(evidence, ["session_id", "sequence"])
    return met.select("session_id", "sequence", strengths().alias("strengths"), ambiguities().alias("ambiguities"), labels(suggested_missing()).alias("missing"), outcome_lines().alias("outcome"), suggested_structure().alias("suggestion"), F.lit(DISCLAIMER).alias("disclaimer"))


def templates(prompts: DataFrame, least: int = 2) -> DataFrame:
    """Prompts that say the same but for references and marks: key, occurrences, sessions, and the first one's beginning."""
    keyed = prompts.where(F.trim("content") != "").withColumn("template", text.template_key(F.col("content")))
    first = F.min_by(F.substring(F.trim("content"), 1, 80), F.struct("ts", "session_id", "sequence"))
    found = keyed.groupBy("template").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("session_id").alias("sessions"), first.alias("example"))
    return found.where((F.col("occurrences") >= least) & (F.col("template") != "")).orderBy(F.desc("occurrences"), F.desc("sessions"), "template")


def recent_prompts(prompts: DataFrame, most: int = 500) -> DataFrame:
    """The latest prompts (a top-k)."""
    return prompts.orderBy(F.desc("ts"), "session_id", "sequence").limit(most)


def mean_recent_quality(scored: DataFrame, most: int = 100) -> DataFrame:
    """Mean overall score of the latest prompts (a top-k report)."""
    return recent_prompts(scored, most).agg(F.round(F.sum(F.round(F.col("overall") * 100).cast("long")) / F.count(F.lit(1)) / 100, 6).alias("mean_overall"), F.count(F.lit(1)).alias("prompts"))


def by_category(candidates: DataFrame) -> DataFrame:
    """Candidates of each category, by severity."""
    return candidates.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("findings"))


def per_day(recommendations: DataFrame, now_ms: int, days: int = 14) -> DataFrame:
    """Recommendations made on each of the last days, today included, zero where none."""
    day = 86_400_000
    today = now_ms // day
    spine = recommendations.sparkSession.range(today - days + 1, today + 1).withColumnRenamed("id", "day")
    made = recommendations.groupBy(F.floor(F.col("created_at") / day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(made, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("recommendations"))
