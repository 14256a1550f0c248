"""Threshold rules over one snapshot row for each scope, and the life of what they find."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.sources.scratch import written

MIN_CONFIDENCE = 0.65
SEVERITY_WEIGHT = {"critical": 30, "high": 24, "medium": 18, "low": 12, "info": 6}
MOST_RECOMMENDED = 20


@dataclass(frozen=True)
class Rule:
    """severity, trigger, confidence and metrics are SQL over the snapshot's columns and the thresholds, by name.

    metrics, label=expression, are the evidence; occurrences is how often a thing
    was seen, if it was counted.
    """

    id: str
    severity: str
    trigger: str
    confidence: str
    metrics: str
    remedy: str
    thresholds: dict[str, float] = field(default_factory=dict)
    version: int = 1

    def filled(self, text: str, overrides: dict[str, float] | None = None) -> str:
        for name, value in (self.thresholds | (overrides or {})).items():
            text = text.replace(f":{name}", f"{value!r}")
        return text

    @property
    def category(self) -> str:
        return CATEGORIES[self.id.split("-")[0]]

    @property
    def kind(self) -> str:
        """What sort of evidence the metrics are."""
        return KINDS.get(self.id, "metrics")

    @property
    def severity_sql(self) -> str:
        return self.severity if " " in self.severity else f"'{self.severity}'"

    @property
    def evidence(self) -> dict[str, str]:
        return {label: sql or label for label, _, sql in (m.partition("=") for m in self.metrics.split())}


# The kind of each rule's evidence, and what the metrics rest on that aren't exact counts.
KINDS = {
    "TOOLS-001": "repeated-read", "TOOLS-002": "repeated-command", "TOOLS-003": "repeated-failed-command", "TOOLS-004": "broad-test-runs", "TOOLS-005": "oversized-output", "TOOLS-006": "exploration-to-change", "TOOLS-007": "repeated-search", "TOOLS-008": "failing-tool",
    "VERIFY-001": "changes-without-verification", "VERIFY-002": "changes-after-verification", "VERIFY-003": "failed-verification-at-end", "VERIFY-004": "narrow-verification", "VERIFY-005": "no-tests-with-changes", "VERIFY-006": "no-build-with-changes",
    "WORKFLOW-001": "corrective-turns", "WORKFLOW-002": "long-session", "WORKFLOW-003": "large-changes-no-verification", "WORKFLOW-004": "repeated-manual-validation",
    "CONTEXT-001": "frequent-compaction", "CONTEXT-002": "large-repeated-output", "CONTEXT-003": "stale-context", "CONTEXT-004": "verbose-exploration",
    "PROMPT-001": "missing-acceptance-criteria", "PROMPT-002": "missing-verification-request", "PROMPT-003": "multi-task-prompts", "PROMPT-004": "vague-references", "PROMPT-005": "repeated-corrections",
    "MODEL-001": "high-cost-light-work", "MODEL-002": "low-capability-struggling", "MODEL-003": "stale-context-premium", "SECURITY-001": "sensitive-path-access", "SECURITY-002": "redacted-secret", "CONFIG-001": "configuration-state", "CONFIG-002": "local-first-boundary",
}
PROVENANCE = {
    "inferred": "files_per_session prompts_per_session tools_per_session median_ms changed_unverified changed_after_verification ended_failed narrow_only corrective_prompts correction_prompts dominant_cost_tier dominant_capability failure_rate".split(),
    "reported": "max_output input_tokens cache_read_tokens".split(),
    "heuristic": "criteria_prompts verify_prompts multi_prompts vague_refs broad_exclusions".split(),
}


def provenance_of(label: str) -> str:
    return next((kind for kind, labels in PROVENANCE.items() if label in labels), "exact")


CATEGORIES = {"TOOLS": "tools", "VERIFY": "verification", "WORKFLOW": "workflow", "CONTEXT": "context", "PROMPT": "prompt", "MODEL": "model", "SECURITY": "security", "CONFIG": "configuration"}


def _count(n: str, base: float, per: float, most: float) -> str:
    return f"least({most}, {base} + greatest(0, {n}) * {per})"


CACHE = "(cache_read_tokens * 1.0 / nullif(cache_read_tokens + input_tokens, 0))"
UNVERIFIED = "(changed_unverified * 1.0 / nullif(sessions, 0))"
#: Reasons why much is kept or little is looked at, and why data may leave the machine.
KEPT = "(if(full_local,1,0) + if(retention_days > :days,1,0) + if(broad_exclusions > 0 or exclusions >= :least,1,0))"
OPEN = "(if(beyond_loopback,1,0) + if(external_provider,1,0))"
# Triggers, severities, confidences and thresholds of the rules.
RULES = [
    Rule("TOOLS-001", "medium", "repeated_read_top >= :min", _count("repeated_read_top", 0.5, 0.08, 0.9), "occurrences=repeated_read_top", "Keep what a file holds in mind, or search in it, instead of reading it again.", {"min": 3}),
    Rule("TOOLS-002", "low", "repeated_command_top >= :min", _count("repeated_command_top", 0.45, 0.06, 0.75), "occurrences=repeated_command_top", "Put the repeated commands into one script.", {"min": 3}),
    Rule("TOOLS-003", "high", "repeated_failed_top >= :min", _count("repeated_failed_top", 0.6, 0.1, 0.9), "occurrences=repeated_failed_top", "Read the error and change something before trying the same command again.", {"min": 2}),
    Rule("TOOLS-004", "low", "broad_tests >= :min", "least(0.55, 0.35 + 0.05 * (broad_tests - :min))", "broad_tests files_per_session", "Run the tests of what was changed, not all of them.", {"min": 3}),
    Rule("TOOLS-005", "medium", "max_output >= :bytes", "least(0.85, 0.5 + 0.3 * least(1, max_output * 1.0 / :bytes - 1))", "max_output", "Cut large outputs down, or write them to a file and read a part.", {"bytes": 200000}),
    Rule("TOOLS-006", "low", "read_write_ratio >= :ratio and files_per_session <= :files", "least(0.6, 0.4 + 0.2 * least(1, (read_write_ratio - :ratio) / :ratio))", "read_write_ratio files_per_session", "Look for the place to change with a narrower search.", {"ratio": 8, "files": 2}),
    Rule("TOOLS-007", "low", "repeated_search_top >= :min", _count("repeated_search_top", 0.45, 0.07, 0.8), "occurrences=repeated_search_top", "Keep the result of a search, or ask another question.", {"min": 3}),
    Rule("TOOLS-008", "medium", "worst_tool_rate >= :rate and worst_tool_failures >= :min", "least(0.8, 0.4 + 0.35 * least(1, worst_tool_failures / 4.0))", "worst_tool_failures worst_tool_rate", "See why the tool fails, or stop using it for this.", {"rate": 0.5, "min": 2}),
    Rule("VERIFY-001", "high", "changed_unverified >= 1", f"least(0.9, 0.55 + 0.3 * {UNVERIFIED})", "changed_unverified sessions", "Run a check after changing code."),
    Rule("VERIFY-002", "medium", "changed_after_verification >= 1", _count("changed_after_verification", 0.55, 0.1, 0.9), "changed_after_verification", "Run the check again after the last edit."),
    Rule("VERIFY-003", "high", "ended_failed >= 1", _count("ended_failed", 0.6, 0.1, 0.9), "ended_failed", "Mend what fails, or say that it does, before ending."),
    Rule("VERIFY-004", "low", "narrow_only >= 1", "least(0.55, 0.35 + 0.05 * narrow_only)", "narrow_only", "Add a second kind of check where a change is wide."),
    Rule("VERIFY-005", "high", "tests = 0 and changed_unverified >= 1", f"least(0.85, 0.5 + 0.3 * {UNVERIFIED})", "tests changed_unverified sessions", "Run the tests after changes, or write one."),
    Rule("VERIFY-006", "medium", "builds = 0 and files_per_session >= 3 and changed_unverified >= 1", "least(0.6, 0.35 + 0.2 * least(1, files_per_session / 8.0))", "builds files_per_session changed_unverified", "Build after large changes."),
    Rule("WORKFLOW-001", "medium", "corrective_prompts >= :min", _count("corrective_prompts", 0.5, 0.08, 0.8), "corrective_prompts", "Say aim, bounds and criteria in the first prompt.", {"min": 3}),
    Rule("WORKFLOW-002", "low", "median_ms >= :ms and prompts_per_session >= :prompts", "0.45", "median_ms prompts_per_session", "Give each aim a session of its own.", {"ms": 3600000, "prompts": 6}),
    Rule("WORKFLOW-003", "medium", "files_per_session >= 5 and changed_unverified >= 2", f"least(0.7, 0.35 + 0.3 * least(1, {UNVERIFIED}) + 0.1 * least(1, files_per_session / 10.0))", "files_per_session changed_unverified sessions", "Plan large changes, and check them."),
    Rule("WORKFLOW-004", "low", "tests + builds >= :runs and sessions >= 3", "least(0.65, 0.35 + 0.3 * least(1, (tests + builds) / 16.0))", "tests builds sessions", "Let a hook run the checks after edits.", {"runs": 8}),
    Rule("CONTEXT-001", "medium", "compactions >= :min", "least(0.8, 0.45 + 0.3 * least(1, compactions * 1.0 / nullif(sessions, 0)))", "compactions sessions", "Load less at the start, and read large outputs once.", {"min": 2}),
    Rule("CONTEXT-002", "medium", "max_output >= :bytes and repeated_command_top >= 1", "least(0.75, 0.45 + 0.25 * least(1, max_output / (4.0 * :bytes)))", "max_output repeated_command_top", "Page or filter large outputs.", {"bytes": 100000}),
    Rule("CONTEXT-003", "low", f"{CACHE} >= :share and compactions >= 1", f"least(0.7, 0.4 + 0.3 * {CACHE})", "cache_read_tokens input_tokens compactions", "Begin a new session for a new aim.", {"share": 0.6}),
    Rule("CONTEXT-004", "low", "(sum_repeated_reads >= :reads or sum_repeated_searches >= :searches) and files_per_session <= 2", "least(0.65, 0.35 + 0.3 * least(1, (sum_repeated_reads + sum_repeated_searches) / 18.0))", "sum_repeated_reads sum_repeated_searches files_per_session", "Hand wide exploration to a subagent.", {"reads": 12, "searches": 6}),
    Rule("PROMPT-001", "medium", "prompt_count >= 4 and criteria_prompts <= 0.2 * prompt_count", "least(0.7, 0.35 + 0.35 * least(1, (prompt_count - criteria_prompts) / 4.0))", "prompt_count criteria_prompts", "Add a line that says when the task is done."),
    Rule("PROMPT-002", "low", "prompt_count >= 4 and verify_prompts <= 0.2 * prompt_count", "least(0.65, 0.3 + 0.35 * least(1, (prompt_count - verify_prompts) / 4.0))", "prompt_count verify_prompts", "Ask for a check in the prompt."),
    Rule("PROMPT-003", "medium", "multi_prompts >= 3 and multi_prompts >= 0.3 * prompt_count", "least(0.65, 0.35 + 0.3 * least(1, multi_prompts / 3.0))", "prompt_count multi_prompts", "Ask for one thing at a time."),
    Rule("PROMPT-004", "low", "vague_refs >= 4 and vague_refs >= 0.5 * prompt_count", "least(0.6, 0.3 + 0.3 * least(1, vague_refs / 4.0))", "prompt_count vague_refs", "Name the file or the behaviour that is meant."),
    Rule("PROMPT-005", "medium", "correction_prompts >= 3 and correction_prompts >= 0.2 * prompt_count", "least(0.7, 0.4 + 0.3 * least(1, correction_prompts / 3.0))", "prompt_count correction_prompts", "Say aim, bounds and criteria first."),
    Rule("MODEL-001", "low", "dominant_cost_tier >= 4 and requests >= 3 and tools_per_session <= 6", "least(0.6, 0.3 + 0.3 * least(1, requests / 3.0))", "dominant_cost_tier requests tools_per_session", "Use a cheaper model for light work."),
    Rule("MODEL-002", "medium", "dominant_capability <= 2 and (failure_rate >= 0.3 or repeated_failed_top >= 2)", "least(0.6, 0.3 + 0.3 * least(1, failure_rate))", "dominant_capability failure_rate repeated_failed_top", "Use a stronger model for what fails again and again."),
    Rule("MODEL-003", "low", f"dominant_capability >= 4 and requests >= 3 and {CACHE} >= 0.6", f"least(0.6, 0.3 + 0.3 * {CACHE})", "dominant_capability requests cache_read_tokens input_tokens", "Begin a new session before using a strong model."),
    Rule("SECURITY-001", "high", "sensitive_ops >= 1", _count("sensitive_ops", 0.6, 0.08, 0.85), "sensitive_ops", "Keep files with credentials out of the context."),
    Rule("SECURITY-002", "critical", "secret_findings >= 1", _count("secret_findings", 0.65, 0.07, 0.9), "secret_findings", "Keep secrets out of prompts."),
    Rule("CONFIG-001", "case when full_local then 'high' else 'medium' end", f"{KEPT} >= 1", f"least(0.8, 0.45 + 0.15 * {KEPT})", "full_local=if(full_local,1,0) retention_days exclusions broad_exclusions", "Keep less, and exclude fewer projects.", {"days": 365, "least": 5}),
    Rule("CONFIG-002", "high", f"{OPEN} >= 1", f"least(0.85, 0.5 + 0.2 * {OPEN})", "beyond_loopback=if(beyond_loopback,1,0) external_provider=if(external_provider,1,0)", "Bind to loopback, and keep analysis on the machine."),
]


def chosen(rules: list[Rule], overrides: dict[str, dict]) -> list[Rule]:
    """Of rules with one id the last, unless disabled, by id."""
    return sorted((r for r in {r.id: r for r in rules}.values() if overrides.get(r.id, {}).get("enabled", True)), key=lambda r: r.id)


def evaluate(snapshots: DataFrame, rules: list[Rule] = RULES, overrides: dict[str, dict] | None = None, min_confidence: float = MIN_CONFIDENCE, scope: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Candidates of all rules in one pass: the columns of scope, rule_id, version, category, severity, confidence, kind, evidence, remedy, fingerprint.

    A snapshot's scope is a project, or a session of it, or all, where the columns
    are null; it is part of the fingerprint.

    evidence is an array of (label, value, provenance), values with two places;
    two findings of a rule and scope have one fingerprint only if it and its kind
    are the same. overrides:
    by rule id, "enabled" and thresholds. Rules whose columns the snapshots lack
    are left out; skipped() names them.
    """
    overrides = overrides or {}
    left_out = {r.id for r, why in _skipped(snapshots, rules, overrides)}
    found = []
    for r in chosen(rules, overrides):
        if r.id in left_out:
            continue
        own = {k: v for k, v in overrides.get(r.id, {}).items() if k != "enabled"}
        sql = lambda text: F.expr(r.filled(text, own))  # noqa: B023, E731
        metrics = F.array(*(F.struct(F.lit(label).alias("label"), F.round(sql(f"cast({text} as double)"), 2).alias("value"), F.lit(provenance_of(label)).alias("provenance")) for label, text in r.evidence.items()))
        hit = F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.version).alias("version"), F.lit(r.category).alias("category"), sql(r.severity_sql).alias("severity"), F.round(sql(f"cast({r.confidence} as double)"), 6).alias("confidence"), F.lit(r.kind).alias("kind"), metrics.alias("evidence"), F.lit(r.remedy).alias("remedy"))
        found.append(F.when(sql(r.trigger), hit))
    if not found:
        return snapshots.select(*scope, *(F.lit(None).cast(t).alias(n) for n, t in CANDIDATE.items())).limit(0)
    rows = snapshots.select(*scope, F.explode(F.array_compact(F.array(*found))).alias("c")).select(*scope, "c.*")
    where = F.concat_ws("/", *(F.col(c).cast("string") for c in scope))
    mark = F.sha2(F.concat_ws("|", "rule_id", F.col("version").cast("string"), F.when(where == "", "all").otherwise(where), "kind", evidence_text()), 256)
    return rows.where(F.col("confidence") >= min_confidence).withColumn("fingerprint", mark)


CANDIDATE = {"rule_id": "string", "version": "int", "category": "string", "severity": "string", "confidence": "double", "kind": "string", "evidence": "array<struct<label:string,value:double,provenance:string>>", "remedy": "string", "fingerprint": "string"}


def evidence_text() -> Column:
    """The column evidence as text: label=hundredths, one after the other."""
    return F.array_join(F.transform("evidence", lambda m: F.concat(m["label"], F.lit("="), F.coalesce(F.round(m["value"] * 100).cast("long").cast("string"), F.lit("-")))), ",")


def explained(candidates: DataFrame, references: DataFrame | None = None, most: int = 20) -> DataFrame:
    """candidates with what a reader is shown: description (kind and metrics in words), references, and remediation, an instruction that is never applied by itself.

    references (project_id, reference): sessions or files that a finding is about,
    at most so many of a project, the first by name (a top-k of what is shown).
    """
    shown = F.array_join(F.transform("evidence", lambda m: F.concat(m["label"], F.lit(" "), F.coalesce(F.regexp_replace(m["value"].cast("decimal(30,2)").cast("string"), r"\.?0+$", ""), F.lit("unknown")))), ", ")
    out = candidates.withColumns({
        "description": F.concat(F.regexp_replace("kind", "-", " "), F.lit(": "), shown), "remediation": F.struct(F.lit("instruction").alias("type"), F.col("remedy").alias("preview"), F.lit(False).alias("automatic")),
    })
    if references is None:
        return out.withColumn("references", F.array().cast("array<string>"))
    first = references.select("project_id", F.col("reference").cast("string").alias("reference")).distinct().withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("reference"))).where(F.col("place") <= most)
    named = first.groupBy("project_id").agg(F.array_sort(F.collect_list("reference")).alias("references"))
    return out.join(named, "project_id", "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def metric(label: str) -> Column:
    """A metric of the column evidence, null if it isn't there."""
    return F.get(F.transform(F.filter("evidence", lambda m: m["label"] == label), lambda m: m["value"]), F.lit(0))


_judged: dict[tuple[str, str], list[tuple[str, str]]] = {}


def _skipped(snapshots: DataFrame, rules: list[Rule], overrides: dict[str, dict]) -> list[tuple[Rule, str]]:
    """Rules that are disabled or can't be analysed, and why; found once for a schema, a list of rules and overrides."""
    out = [(r, "disabled") for r in {r.id: r for r in rules}.values() if not overrides.get(r.id, {}).get("enabled", True)]
    rest = chosen(rules, overrides)
    key = (snapshots.schema.json(), repr((rest, sorted(overrides.items()))))
    if key not in _judged:
        columns = snapshots.sparkSession.createDataFrame([], snapshots.schema)  # the same columns, but quick to analyse
        wrong = lambda some: _analysis(columns, some, overrides)
        _judged[key] = [] if wrong(rest) is None else [(r.id, why) for r in rest if (why := wrong([r])) is not None]
    by_id = {r.id: r for r in rest}
    return out + [(by_id[i], why) for i, why in _judged[key]]


def _analysis(columns: DataFrame, rules: list[Rule], overrides: dict[str, dict]) -> str | None:
    """What is wrong with the expressions of rules, if anything is."""
    own = lambda r: {k: v for k, v in overrides.get(r.id, {}).items() if k != "enabled"}
    try:
        columns.select(*(F.expr(r.filled(x, own(r))) for r in rules for x in (r.trigger, r.confidence, r.severity_sql, *r.evidence.values())))
    except AnalysisException as wrong:
        return wrong.getCondition() or "not valid"
    return None


def isolated(snapshots: DataFrame, rules: list[Rule] = RULES, overrides: dict[str, dict] | None = None, min_confidence: float = MIN_CONFIDENCE, scope: tuple[str, ...] = ("project_id",)) -> tuple[DataFrame, DataFrame]:
    """evaluate() and skipped(), run and written: a rule that fails while it runs is skipped, and the others' candidates stay.

    All rules run in one job. Only if that fails is each tried alone, over the
    written snapshots, to tell which are at fault.
    """
    overrides = overrides or {}
    held = written(snapshots, "rule-snapshots")
    try:
        found, failed = written(evaluate(held, rules, overrides, min_confidence, scope), "rule-candidates"), []
    except _RUNTIME:
        failed = [(r.id, why) for r in chosen(rules, overrides) if (why := _failure(held, r, overrides, scope)) is not None]
        bad = {i for i, _ in failed}
        found = written(evaluate(held, [r for r in rules if r.id not in bad], overrides, min_confidence, scope), "rule-candidates")
    rows = [(r.id, why) for r, why in _skipped(held, rules, overrides)] + failed
    return found, held.sparkSession.createDataFrame(sorted(rows), "rule_id string, why string")


_RUNTIME = (PySparkException, Py4JJavaError)


def _failure(snapshots: DataFrame, rule: Rule, overrides: dict[str, dict], scope: tuple[str, ...]) -> str | None:
    try:
        evaluate(snapshots, [rule], overrides, 0.0, scope).write.format("noop").mode("overwrite").save()
    except _RUNTIME as wrong:
        return (wrong.getCondition() if isinstance(wrong, PySparkException) else None) or "failed while running"
    return None


def skipped(snapshots: DataFrame, rules: list[Rule] = RULES, overrides: dict[str, dict] | None = None) -> DataFrame:
    """rule_id and why, of the rules that evaluate() leaves out."""
    rows = [(r.id, why) for r, why in _skipped(snapshots, rules, overrides or {})]
    return snapshots.sparkSession.createDataFrame(rows, "rule_id string, why string")


def catalogue(spark: SparkSession, rules: list[Rule] = RULES, overrides: dict[str, dict] | None = None) -> DataFrame:
    """Every rule with category, severity, thresholds in force, and whether it is enabled."""
    overrides, rows = overrides or {}, []
    for r in {r.id: r for r in rules}.values():
        own = {k: v for k, v in overrides.get(r.id, {}).items() if k != "enabled"}
        rows.append((r.id, r.version, r.category, {k: float(v) for k, v in (r.thresholds | own).items()}, overrides.get(r.id, {}).get("enabled", True)))
    return spark.createDataFrame(rows, "rule_id string, version int, category string, thresholds map<string, double>, enabled boolean").orderBy("rule_id")


def consolidate(candidates: DataFrame) -> DataFrame:
    """One candidate for each fingerprint, the first by rule, and how many there were."""
    rest = [c for c in candidates.columns if c != "fingerprint"]
    return candidates.groupBy("fingerprint").agg(F.min_by(F.struct(*rest), "rule_id").alias("c"), F.count(F.lit(1)).alias("copies")).select("c.*", "fingerprint", "copies")


STATUSES = ("active", "dismissed", "resolved", "superseded")


def merge(stored: DataFrame, candidates: DataFrame, now: int) -> DataFrame:
    """stored (fingerprint, rule_id, project_id, status, created_at, updated_at) after a run, with what was done to each row.

    A known active fingerprint is touched, a known inactive one left; a new one is
    inserted and supersedes other active rows of its rule and project.
    """
    new = candidates.select("fingerprint", F.col("rule_id").alias("c_rule"), F.col("project_id").alias("c_project"))
    met = stored.join(new, "fingerprint", "full")
    fresh = met.where("rule_id is null").select(F.col("c_rule").alias("n_rule"), F.col("c_project").alias("n_project")).distinct()
    out = met.join(fresh, F.col("rule_id").eqNullSafe(F.col("n_rule")) & F.col("project_id").eqNullSafe(F.col("n_project")), "left")
    active, again = F.col("status") == "active", F.col("c_rule").isNotNull()
    action = F.when(F.col("rule_id").isNull(), "inserted").when(active & again, "touched").when(active & F.col("n_rule").isNotNull(), "superseded").otherwise("retained")
    out = out.withColumn("action", action).withColumn("found", F.col("c_rule").isNotNull())
    status = F.when(F.col("action") == "inserted", "active").when(F.col("action") == "superseded", "superseded").otherwise(F.col("status"))
    changed = F.col("action").isin("inserted", "touched", "superseded")
    return out.select(
        "fingerprint", F.coalesce("rule_id", "c_rule").alias("rule_id"), F.when(F.col("action") == "inserted", F.col("c_project")).otherwise(F.col("project_id")).alias("project_id"), status.alias("status"),
        F.when(F.col("action") == "inserted", F.lit(now)).otherwise(F.col("created_at")).alias("created_at"), F.when(changed, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"), "action", "found",
    )


def outcome(merged: DataFrame) -> DataFrame:
    """How many candidates were inserted, found unchanged, or left as the user put them, and rows superseded."""
    count = lambda c: F.count_if(c)
    return merged.agg(
        count(F.col("action") == "inserted").alias("inserted"), count(F.col("action") == "superseded").alias("superseded"), count(F.col("action") == "touched").alias("unchanged"),
        count((F.col("action") == "retained") & F.col("found")).alias("retained"),
    )


def reported(merged: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of this run whose row is active: what users put aside is not shown again."""
    return candidates.join(merged.where("status = 'active'").select("fingerprint", "created_at", "updated_at"), "fingerprint")


def change_status(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """stored after changes (fingerprint, change, at): dismiss, resolve, restore and reopen; the latest of a row counts.

    restore puts a dismissed row, reopen a resolved one, back to active; a change
    that doesn't fit the row's status is left out.
    """
    last = changes.groupBy("fingerprint").agg(F.max_by(F.struct("change", "at"), F.struct("at", "change")).alias("c")).select("fingerprint", "c.*")
    becomes = F.when((F.col("change") == "dismiss") & (F.col("status") == "active"), "dismissed").when((F.col("change") == "resolve") & (F.col("status") == "active"), "resolved").when((F.col("change") == "restore") & (F.col("status") == "dismissed"), "active").when((F.col("change") == "reopen") & (F.col("status") == "resolved"), "active")
    met = stored.join(last, "fingerprint", "left").withColumn("becomes", becomes)
    return met.withColumn("updated_at", F.when(F.col("becomes").isNotNull(), F.col("at")).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("becomes", "status")).select(*stored.columns)


def active(stored: DataFrame, project_id: int | None = None) -> DataFrame:
    """Active rows, newest first, of one project if given."""
    rows = stored.where("status = 'active'")
    return (rows if project_id is None else rows.where(F.col("project_id") == project_id)).orderBy(F.desc("created_at"), "fingerprint")


DAY_MS = 86_400_000


def score(now: int) -> Column:
    """What ranks a recommendation: severity and confidence, impact, how recent and frequent it is, over how many sessions, whether it says what to do, less if its rule was dismissed.

    Columns: severity, confidence, evidence, impact_confidence, updated_at,
    references, remedy, automatic, dismissed_rule. A null counts for nothing.
    """
    weight = F.create_map(*(F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv))[F.col("severity")]
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("updated_at")) / F.lit(float(DAY_MS)))
    sessions = F.size(F.array_distinct(F.coalesce("references", F.lit([]).cast("array<string>"))))
    parts = [
        F.coalesce(weight, F.lit(0)), 25 * F.col("confidence"), F.coalesce(15 * F.col("impact_confidence"), F.lit(0.0)), F.when(F.col("updated_at").isNotNull(), F.greatest(F.lit(0.0), 10 - age * 1.5)).otherwise(0.0),
        F.least(F.lit(10.0), F.coalesce(metric("occurrences"), metric("count"), F.lit(0.0))), F.when(sessions > 1, F.least(F.lit(10), sessions * 3)).otherwise(0),
        F.when(F.col("remedy").isNotNull(), F.when(F.col("automatic"), 7).otherwise(2)).otherwise(0), F.when(F.col("dismissed_rule"), -6).otherwise(0),
    ]
    return F.round(sum(parts[1:], parts[0]), 4)


def rank(candidates: DataFrame, now: int, dismissed_rules: DataFrame | None = None, most: int = MOST_RECOMMENDED, by_project: bool = False) -> DataFrame:
    """The best candidates by score(), over all or of each project; ties by severity, rule and project.

    Columns that score() reads and candidates lacks count for nothing.
    dismissed_rules (rule_id) are the rules of which the user put advice aside.
    """
    kinds = {"impact_confidence": "double", "updated_at": "long", "references": "array<string>", "automatic": "boolean"}
    rows = candidates.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in candidates.columns})
    if dismissed_rules is None:
        rows = rows.withColumn("dismissed_rule", F.lit(False))
    else:
        rows = rows.join(dismissed_rules.select("rule_id").distinct().withColumn("dismissed_rule", F.lit(True)), "rule_id", "left")
    weight = F.create_map(*(F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv))[F.col("severity")]
    scored = rows.withColumn("score", score(now)).withColumn("weight", weight)
    order = [F.desc("score"), F.desc("weight"), "rule_id", "project_id"]
    if by_project:
        scored = scored.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).where(F.col("place") <= most).drop("place")
    else:
        scored = scored.orderBy(*order).limit(most)
    return scored.select("project_id", "rule_id", "severity", "confidence", "score")


def of_session(stored: DataFrame, session_id) -> DataFrame:
    """A session's recommendations, oldest first."""
    return stored.where(F.col("session_id") == session_id).orderBy("created_at", "fingerprint")


def avoidable(stored: DataFrame) -> DataFrame:
    """The least tokens and USD that active recommendations would save; null where none states a range."""
    return stored.where("status = 'active'").agg(F.sum("impact_tokens_min").alias("tokens"), F.sum("impact_usd_min").alias("usd"))


def opportunities(stored: DataFrame, most: int = 10) -> DataFrame:
    """The active recommendations of most confidence (a top-k)."""
    return stored.where("status = 'active'").orderBy(F.desc("confidence"), "rule_id", "project_id").limit(most)
