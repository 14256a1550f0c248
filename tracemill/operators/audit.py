"""Checks of instruction documents, settings, skills, agents and servers over many projects.

Documents come as a table (project_id, scope, path, body); scope is project or
user. A finding is a row (project_id, family, scope, slug, severity, confidence,
subject).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.sources.scratch import written

# Limits, patterns and paths of the checks.
LARGE_BYTES, LARGE_LINES, LONG_DESCRIPTION, SHORT_DESCRIPTION, LONG_TIMEOUT, MANY_AGENTS, MANY_COMMANDS, SHARED_VERB = 65_536, 600, 280, 20, 10_000, 12, 6, 3
HIGH, MODERATE, LOW = 0.8, 0.6, 0.4
PROJECT_PATH, PROJECT_TOOL = r"/(src|lib|app|packages|components)/", r"(?i)\b(turbo|pnpm|next\.config|vite\.config)\b"
BUILD, TEST, VERIFY = r"\b(build|compile|tsc|webpack|vite|rollup)\b", r"\b(test|vitest|jest|pytest|cargo test|lint)\b", r"\b(verify|check|typecheck|smoke|e2e|qa)\b"
ARCHITECTURE = r"\b(architecture|structure|monorepo|workspace|packages|modules)\b"
SECRET, SECRET_VALUE = r"\b(AKIA[0-9A-Z]{16}|sk-[a-zA-Z0-9]{20,}|xoxb-|ghp_|-----BEGIN [A-Z ]*PRIVATE KEY-----)\b", r"(?i)\b(password|secret|api[_-]?key|token)\s*[:=]\s*\S+"
REFERENCE = r"`([A-Za-z0-9_./-]+\.(?:ts|js|py|go|rs|md|json))`"
GENERATES, VALIDATES = r"\b(generate|create|write|scaffold|build)\b", r"\b(verify|test|check|validate|review)\b"
REWRITES, SCRIPT = r"\b(sed\s+-i|tee\b|>>?\s*/|perl\s+-i|awk\s+.*>)", r"\b([A-Za-z0-9_./-]+/[A-Za-z0-9_-]+\.(?:sh|js|ts|py))\b"
BYPASS, WHOLE_SHELL = r"(?i)\b(bypassPermissions|bypass)", r"^Bash\(\s*\*\s*\)$"
DANGEROUS = r"\b(rm\s+-rf\b|sudo\b|:\(\)\{|mkfs|dd\s+if=|>\s*/dev/sd|chmod\s+[0-7]{3,4}\s+/)"
NETWORK = r"\b(curl|wget|ssh|scp|nc|netcat)\b"
SENSITIVE = (".env", "settings.local.json", "id_rsa", ".npmrc", ".pypirc")
SECRET_NAME = r"(?i)(?:^|[_-])(token|secret|key|password|passwd|auth|credential|api[_-]?key)(?:$|[_-])"
FINDING = ("project_id", "family", "scope", "slug", "severity", "confidence", "subject")


def _rows(df: DataFrame, family: str, checks: dict[str, tuple[str, float, Column]], subject: Column, scope: Column | None = None) -> DataFrame:
    """A finding for each row of df and check (slug: severity, confidence, condition) that holds."""
    hits = [F.when(c, F.struct(F.lit(slug).alias("slug"), F.lit(severity).alias("severity"), F.lit(conf).alias("confidence"))) for slug, (severity, conf, c) in checks.items()]
    each = df.select("project_id", F.lit(family).alias("family"), (F.col("scope") if scope is None else scope).alias("scope"), subject.cast("string").alias("subject"), F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return each.select("project_id", "family", "scope", "f.slug", "f.severity", "f.confidence", "subject")


def _like(c: Column, pattern: str) -> Column:
    return c.rlike(text.ascii_words(pattern))


def first_prose_line(body: Column) -> Column:
    """The first line that isn't blank, outside the frontmatter, trimmed; empty if there is none."""
    prose = F.regexp_replace(body, r"\A\s*---[^\n]*\n(?:[^\n]*\n)*?---[^\n]*(?:\n|\z)", "")
    return F.coalesce(F.get(F.filter(F.transform(F.split(prose, r"\r?\n", -1), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def instructions(docs: DataFrame) -> DataFrame:
    """docs with bytes, lines, approximate tokens, 16 digits of a hash, and the first prose line."""
    body = F.coalesce("body", F.lit(""))
    return docs.select(
        "project_id", "scope", "path", F.octet_length(body).cast("long").alias("bytes"), F.size(F.split(body, r"\r?\n", -1)).cast("long").alias("lines"), F.greatest(F.lit(1), F.round(F.length(body) / 4)).cast("long").alias("tokens"),
        F.substring(F.sha2(body, 256), 1, 16).alias("hash"), first_prose_line(body).alias("first_line"),
    )


def instruction_findings(facts: DataFrame, projects: DataFrame) -> DataFrame:
    """Checks of instruction documents; projects (project_id) are those that should have one.

    Copies and conflicts are counted by project; the first document by path
    stands for its group.
    """
    line = F.col("first_line")
    single = _rows(facts, "instructions", {
        "large-file": ("warning", HIGH, (F.col("bytes") >= LARGE_BYTES) | (F.col("lines") >= LARGE_LINES)), "global-specialised": ("info", LOW, (F.col("scope") == "user") & (line.rlike(PROJECT_PATH) | _like(line, PROJECT_TOOL))),
        "sensitive-content": ("critical", MODERATE, _like(line, SECRET) | _like(line, SECRET_VALUE)), "stale-ref": ("info", LOW, F.regexp_extract(line, REFERENCE, 1).contains("/")),
    }, F.col("path"))
    copies = facts.groupBy("project_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.min_by("scope", "path").alias("scope"))
    several = facts.groupBy("project_id", "scope").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("kinds"))
    own = facts.where("scope = 'project'").groupBy("project_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "first_line"))), lambda r: r["first_line"]), " ")).alias("said"))
    lacks = F.array_compact(F.array(*(F.when(~_like(F.col("said"), p), F.lit(n)) for n, p in (("build", BUILD), ("test", TEST), ("verification", VERIFY)))))
    missing = projects.select("project_id").distinct().join(own.select("project_id"), "project_id", "left_anti")
    project = F.lit("project")
    return reduce(DataFrame.unionByName, [
        single, _rows(copies, "instructions", {"duplicate": ("warning", HIGH, F.col("n") > 1)}, F.col("hash")), _rows(several, "instructions", {"conflicting": ("warning", MODERATE, (F.col("n") > 1) & (F.col("kinds") > 1))}, F.col("n")),
        _rows(own, "instructions", {"missing-build-test-verify": ("info", LOW, F.size(lacks) > 0)}, F.array_join(lacks, ","), project), _rows(own, "instructions", {"missing-architecture": ("info", LOW, ~_like(F.col("said"), ARCHITECTURE))}, F.lit(""), project),
        _rows(missing, "instructions", {"missing-project": ("warning", MODERATE, F.lit(True))}, F.lit(""), project),
    ])


def frontmatter(docs: DataFrame) -> DataFrame:
    """docs with valid (a block between two lines of ---) and fields, map<string, string>, of its lines "key: value"; quotes around a value go."""
    docs = docs.withColumn("_lines", F.split(F.coalesce("body", F.lit("")), r"\r?\n", -1))
    docs = docs.withColumns({"_opened": F.trim(F.get("_lines", F.lit(0))) == "---", "_rest": F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))})
    docs = docs.withColumn("_close", F.array_position(F.transform("_rest", lambda x: F.trim(x) == "---"), True))
    inside = F.filter(F.when(F.col("_close") > 0, F.slice("_rest", F.lit(1), (F.col("_close") - 1).cast("int"))).otherwise(F.col("_rest")), lambda x: x.rlike(r"^[A-Za-z0-9_-]+\s*:"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_-]+)", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[A-Za-z0-9_-]+\s*:\s*(.*)$", 1)), r"^[\"']|[\"']$", "").alias("value"))
    docs = docs.withColumn("_pairs", F.transform(inside, pair))
    last = F.filter("_pairs", lambda p, i: ~F.exists(F.slice("_pairs", i + 2, F.size("_pairs")), lambda q: q["key"] == p["key"]))
    opened = F.col("_opened")
    return docs.withColumns({"valid": opened & (F.col("_close") > 0), "fields": F.when(opened, F.map_from_entries(last)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))}).drop("_lines", "_opened", "_rest", "_close", "_pairs")


def listed(value: Column) -> Column:
    """Items of a value like [a, "b"]; none if it isn't one."""
    items = F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", ""))
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x != "")


def entries(docs: DataFrame) -> DataFrame:
    """Skills or agents: project_id, scope, path, name, description, tools, valid (a name and a description in the frontmatter)."""
    f = frontmatter(docs)
    field = lambda k: F.coalesce(F.col("fields")[k], F.lit(""))
    scalar = lambda k: F.when(field(k).rlike(r"^\[.*\]$"), "").otherwise(field(k))
    return f.select("project_id", "scope", "path", scalar("name").alias("name"), scalar("description").alias("description"), listed(field("tools")).alias("tools"), (F.col("valid") & (scalar("name") != "") & (scalar("description") != "")).alias("valid"))


def skill_findings(skills: DataFrame, commands: DataFrame) -> DataFrame:
    """Checks of skills; and of commands (project_id, name): whether several begin with one verb."""
    described = F.lower("description")
    poor = ~F.col("valid") | (F.col("description") == "")
    single = _rows(skills, "skills", {
        "poor-description": ("warning", HIGH, poor), "verbose-description": ("info", LOW, ~poor & (F.length("description") > LONG_DESCRIPTION)), "missing-validation": ("info", LOW, _like(described, GENERATES) & ~_like(described, VALIDATES)),
    }, F.col("path"))
    named = skills.groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min_by("scope", "path").alias("scope"))
    verb = F.get(F.split("name", "[-_]"), F.lit(0))
    verbs = commands.withColumn("verb", verb).groupBy("project_id", "verb").agg(F.count(F.lit(1)).alias("n"))
    repeated = verbs.groupBy("project_id").agg(F.sum("n").alias("total"), F.max(F.when(F.col("verb") != "", F.col("n"))).alias("most"))
    return reduce(DataFrame.unionByName, [
        single, _rows(named, "skills", {"duplicate-skill": ("warning", HIGH, F.col("n") > 1)}, F.col("name")),
        _rows(repeated, "skills", {"repeated-workflow": ("info", LOW, (F.col("total") >= MANY_COMMANDS) & (F.col("most") >= SHARED_VERB))}, F.col("total"), F.lit("project")),
    ])


def agent_findings(agents: DataFrame) -> DataFrame:
    single = _rows(agents, "agents", {
        "broad-tools": ("warning", MODERATE, F.array_contains("tools", "*") | (F.size("tools") == 0)), "missing-limits": ("warning", HIGH, ~F.col("valid") | (F.col("description") == "")),
        "accidental-invocation": ("info", LOW, (F.length("description") > 0) & (F.length("description") < SHORT_DESCRIPTION)),
    }, F.col("path"))
    many = agents.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return single.unionByName(_rows(many, "agents", {"excessive-overhead": ("info", LOW, F.col("n") >= MANY_AGENTS)}, F.col("n"), F.lit("user")))


def _object(settings: DataFrame, path: str) -> DataFrame:
    """Settings with the object at path exploded into key and value; what isn't an object gives nothing."""
    inside = F.expr(f"try_cast(try_variant_get(try_parse_json(body), '$.{path}', 'variant') as map<string, variant>)")
    return settings.select("project_id", "scope", "path", F.explode(inside).alias("key", "value"))


def _get(of: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({of}, '$.{path}', '{kind}')")


def settings_hooks(settings: DataFrame) -> DataFrame:
    """Hooks of settings: project_id, scope, path, event, matcher (* if none), command, timeout."""
    blocks = _object(settings, "hooks").select("project_id", "scope", "path", F.col("key").alias("event"), F.explode(F.expr("try_cast(value as array<variant>)")).alias("g"))
    hooks = blocks.select("project_id", "scope", "path", "event", F.coalesce(_get("g", "matcher"), F.lit("*")).alias("matcher"), F.explode(F.expr("try_cast(try_variant_get(g, '$.hooks', 'variant') as array<variant>)")).alias("h"))
    return hooks.select("project_id", "scope", "path", "event", "matcher", F.coalesce(_get("h", "command"), _get("h", "script"), F.lit("")).alias("command"), _get("h", "timeout", "long").alias("timeout"))


def hook_findings(hooks: DataFrame, own: str = "tracemill") -> DataFrame:
    """Checks of hooks; own names the commands that are this engine's own collectors."""
    command, everywhere = F.col("command"), F.col("matcher").isin("*", "") & F.col("event").isin("PreToolUse", "PostToolUse")
    single = _rows(hooks, "hooks", {
        "no-timeout": ("warning", HIGH, F.col("timeout").isNull()), "slow-hook": ("warning", HIGH, F.col("timeout") > LONG_TIMEOUT), "broad-matcher": ("warning", HIGH, everywhere), "behaviour-modifying": ("warning", LOW, _like(command, REWRITES)),
        "script-ref": ("info", LOW, _like(command, SCRIPT)),
    }, F.concat_ws("|", "event", "matcher", "command"))
    same = hooks.groupBy("project_id", "event", "matcher", "command").agg(F.count(F.lit(1)).alias("n"), F.min_by("scope", "path").alias("scope"))
    ours = hooks.where(F.lower(command).contains(own)).groupBy("project_id").agg(F.min_by("scope", F.struct("path", "event")).alias("scope"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("timeout").isNull()).alias("open"))
    return reduce(DataFrame.unionByName, [
        single, _rows(same, "hooks", {"duplicate-hook": ("warning", HIGH, F.col("n") > 1)}, F.concat_ws("|", "event", "matcher", "command")), _rows(ours, "hooks", {"own-health": ("info", HIGH, F.col("open") > 0)}, F.col("n")),
    ])


def settings_permissions(settings: DataFrame) -> DataFrame:
    """Permission rules of settings (effect allow, deny or ask), trimmed, blank ones left out; and the default mode, as effect mode."""
    v = text.once(settings, p=F.expr("try_variant_get(try_parse_json(body), '$.permissions', 'variant')"))
    said = lambda e, rule: F.struct(F.lit(e).alias("effect"), rule.alias("rule"))
    stated = lambda e: F.transform(F.expr(f"try_cast(try_variant_get(p, '$.{e}', 'variant') as array<variant>)"), lambda r: said(e, F.when(F.schema_of_variant(r) == "STRING", F.trim(F.try_variant_get(r, "$", "string")))))
    none = F.array().cast("array<struct<effect:string,rule:string>>")
    every = F.concat(*(F.coalesce(stated(e), none) for e in ("allow", "deny", "ask")), F.array(said("mode", _get("p", "defaultMode"))))
    return v.select("project_id", "scope", "path", F.inline(every)).where("rule <> ''")


def permission_findings(rules: DataFrame) -> DataFrame:
    rule, allowed = F.col("rule"), F.col("effect") == "allow"
    shell = allowed & rule.startswith("Bash(")
    unbalanced = F.regexp_count("rule", F.lit(r"\(")) != F.regexp_count("rule", F.lit(r"\)"))
    single = _rows(rules, "permissions", {
        "bypass-mode": ("critical", HIGH, (F.col("effect") == "mode") & _like(rule, BYPASS)), "wildcard-allow": ("critical", HIGH, allowed & rule.rlike(WHOLE_SHELL)), "dangerous-shell": ("critical", HIGH, shell & _like(rule, DANGEROUS)),
        "network-allow": ("warning", MODERATE, shell & _like(rule, NETWORK) & rule.contains("*")), "never-matches": ("info", MODERATE, (F.col("effect") != "mode") & unbalanced),
    }, rule)
    effects = rules.where("effect <> 'mode'").groupBy("project_id", "rule").agg(F.count_distinct("effect").alias("n"), F.min_by("scope", F.struct("path", "effect")).alias("scope"))
    named = rules.withColumn("sensitive", F.explode(F.filter(F.array(*map(F.lit, SENSITIVE)), lambda p: rule.contains(p))))
    bare = named.where(allowed).select("project_id", "sensitive").distinct().join(named.where("effect = 'deny'").select("project_id", "sensitive").distinct(), ["project_id", "sensitive"], "left_anti")
    return reduce(DataFrame.unionByName, [
        single, _rows(effects, "permissions", {"scope-conflict": ("warning", HIGH, F.col("n") > 1)}, rule), _rows(bare, "permissions", {"sensitive-not-denied": ("warning", MODERATE, F.lit(True))}, F.col("sensitive"), F.lit("project")),
    ])


def settings_plugins(settings: DataFrame) -> DataFrame:
    """Plugins of settings: project_id, scope, path, plugin, enabled."""
    return _object(settings, "enabledPlugins").select("project_id", "scope", "path", F.col("key").alias("plugin"), F.coalesce((F.schema_of_variant("value") == "BOOLEAN") & F.expr("try_cast(value as boolean)"), F.lit(False)).alias("enabled"))


def servers(settings: DataFrame) -> DataFrame:
    """Tool servers of settings, and of the projects that user settings list: name, transport, command, url, names of environment variables."""
    nested = _object(settings, "projects").select("project_id", "scope", "path", F.explode(F.expr("try_cast(try_variant_get(value, '$.mcpServers', 'variant') as map<string, variant>)")).alias("key", "value"))
    found = _object(settings, "mcpServers").unionByName(nested)
    url, command = _get("value", "url"), _get("value", "command")
    transport = F.when(url.isNotNull() & (_get("value", "type") == "sse"), "sse").when(url.isNotNull(), "http").when(command.isNotNull(), "stdio").otherwise("unknown")
    env = F.array_sort(F.map_keys(F.expr("try_cast(try_variant_get(value, '$.env', 'variant') as map<string, variant>)")))
    return found.select("project_id", "scope", "path", F.col("key").alias("name"), transport.alias("transport"), command.alias("command"), url.alias("url"), F.coalesce(env, F.array().cast("array<string>")).alias("env_names"))


def server_findings(found: DataFrame) -> DataFrame:
    command = F.coalesce("command", F.lit(""))
    single = _rows(found, "servers", {
        "untrusted-command": ("warning", MODERATE, command.rlike(r"^\.?/") | command.contains("~/")), "npx-fetch": ("info", LOW, _like(command, r"\b(npx|unpx)\b")),
        "env-secret-names": ("info", MODERATE, F.exists("env_names", lambda n: n.rlike(SECRET_NAME))),
    }, F.col("name"))
    first = found.groupBy("project_id", "name").agg(F.min_by(F.struct("scope", "transport", "command", "url"), F.struct("scope", "path")).alias("f")).select("project_id", "name", "f.*")
    bad = (F.col("transport") == "unknown") & (command == "") & (F.coalesce("url", F.lit("")) == "")
    return single.unionByName(_rows(first, "servers", {"misconfigured": ("warning", HIGH, bad)}, F.col("name")))


def run_checks(projects: DataFrame, documents: DataFrame, settings: DataFrame, skills: DataFrame, commands: DataFrame, agents: DataFrame) -> DataFrame:
    """The findings of all families; what the checks of a family read is made once."""
    facts, skilled, acting = written(instructions(documents), "audit-instructions"), written(entries(skills), "audit-skills"), written(entries(agents), "audit-agents")
    hooks, found, rules = written(settings_hooks(settings), "audit-hooks"), written(servers(settings), "audit-servers"), written(settings_permissions(settings), "audit-permissions")
    return reduce(DataFrame.unionByName, [instruction_findings(facts, projects), skill_findings(skilled, commands), hook_findings(hooks), agent_findings(acting), server_findings(found), permission_findings(rules)])


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scope", "severity").agg(F.count(F.lit(1)).alias("findings"))


def configuration(settings: DataFrame) -> DataFrame:
    """Flags of tenants' settings (project_id, mode, retention_days, excluded, host, analysis, provider): the columns that configuration rules read.

    An exclusion is broad with a wildcard or three characters at most. A host is
    beyond loopback unless it is loopback; all interfaces are beyond.
    """
    broad = F.filter("excluded", lambda p: (F.trim(p) != "") & (p.rlike(r"[*?]") | (F.length(F.trim(p)) <= 3)))
    return settings.select(
        "project_id", (F.col("mode") == "full-local").alias("full_local"), F.col("retention_days").cast("long").alias("retention_days"), F.size(broad).cast("long").alias("broad_exclusions"), F.size("excluded").cast("long").alias("exclusions"),
        (~F.col("host").isin("127.0.0.1", "::1", "localhost")).alias("beyond_loopback"), (F.col("analysis") & F.col("provider").isin("openai-compatible", "local-model")).alias("external_provider"),
    )
