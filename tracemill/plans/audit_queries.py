"""Queries over configuration documents that are made from customers, one set for each, and the findings in DuckDB's SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import audit

#: What the documents say, by the customer's number modulo the list's length.
MATCHERS = ['"matcher":"*",', '"matcher":"Bash",', ""]
COMMANDS = ["tee /tmp/x", "scripts/check.sh --all", "tracemill-collect", "echo hi", "sed -i s/a/b/ f"]
TIMEOUTS = ["", ',"timeout":5000', ',"timeout":20000', ',"timeout":10000']
ALLOWED = ["Bash(*)", "Bash(rm -rf /)", "Bash(curl *)", "Read(.env)", "Bash(chmod 755 /x", "Edit(src)"]
SERVERS = ["{}", '{"command":"./run"}', '{"command":"npx thing","env":{"API_TOKEN":"x","HOME":"y"}}', '{"url":"http://x","type":"sse"}', '{"command":"node"}']
BODIES = ["Build, test and verify the modules", "---\nname: x\n---\n\nUse `src/app.ts` here", "password = hunter22", "See /src/lib/x", "LONG", ""]
DESCRIPTIONS = ["generate code", "", "long " * 60, "write and test it"]
TOOLS = ["tools: [a, 'b']\n", "", 'tools: ["*"]\n']


def _pick(values: list[str], shift: int = 0) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), ((F.col("c") + shift) % len(values) + 1).cast("int"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    scope = F.when(F.col("c_custkey") % 2 == 0, "user").otherwise("project")
    dealt = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # a narrow file of many customers is few tasks, of which each has their documents to make
    return dealt.select(F.col("c_custkey").alias("c"), F.col("c_custkey").alias("project_id"), scope.alias("scope"))


def settings(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: c.cast("string")
    hook = F.concat(F.lit("{"), _pick(MATCHERS), F.lit('"hooks":[{"type":"command","command":"'), _pick(COMMANDS), F.lit('"'), _pick(TIMEOUTS), F.lit("}]}"))
    hooks = F.when(F.col("c") % 7 == 0, F.concat(hook, F.lit(","), hook)).otherwise(hook)
    deny, mode = F.when(F.col("c") % 4 == 3, '"Read(.env)"').otherwise(""), F.when(F.col("c") % 10 == 0, ',"defaultMode":"bypassPermissions"').otherwise("")
    nested = F.when(F.col("c") % 3 == 0, F.concat(F.lit(',"projects":{"/p":{"mcpServers":{"inner":'), _pick(SERVERS, 1), F.lit("}}}"))).otherwise("")
    body = F.concat(F.lit('{"hooks":{"PreToolUse":['), hooks, F.lit('],"Stop":"none"},"permissions":{"allow":["'), _pick(ALLOWED), F.lit('"," ",7],"deny":['), deny, F.lit("]"), mode, F.lit('},"enabledPlugins":{"p'), text(F.col("c")), F.lit('":'), text(F.col("c") % 2 == 0), F.lit('},"mcpServers":{"srv":'), _pick(SERVERS), F.lit("}"), nested, F.lit("}"))
    return _customers(spark, d).select("project_id", "scope", F.lit("settings.json").alias("path"), body.alias("body"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """One instruction document for most, a second one for some: of other text, or the same."""
    c = _customers(spark, d)
    body = F.when(_pick(BODIES) == "LONG", F.repeat(F.lit("a line of it\n"), 700)).otherwise(_pick(BODIES))
    first = c.where("c % 11 <> 0").select("project_id", "scope", F.lit("a.md").alias("path"), body.alias("body"))
    other = c.where("c % 9 = 0").select("project_id", "scope", F.lit("b.md").alias("path"), F.lit("Other build").alias("body"))
    same = c.where("c % 13 = 0").select("project_id", "scope", F.lit("c.md").alias("path"), body.alias("body"))
    return first.unionByName(other).unionByName(same)


def _entry(name: F.Column, description: F.Column, rest: F.Column) -> F.Column:
    return F.concat(F.lit("---\nname: "), name, F.lit('\ndescription: "'), description, F.lit('"\n'), rest, F.lit("---\ntext"))


def skills(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    body = _entry(F.concat(F.lit("s"), (F.col("c") % 3).cast("string")), _pick(DESCRIPTIONS), F.lit(""))
    one = c.select("project_id", "scope", F.lit("one/SKILL.md").alias("path"), body.alias("body"))
    return one.unionByName(c.where("c % 8 = 0").select("project_id", "scope", F.lit("two/SKILL.md").alias("path"), body.alias("body")))


def commands(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("c") % 5 == 0, 6).otherwise(2)
    return _customers(spark, d).select("project_id", F.explode(F.sequence(F.lit(1), n)).alias("i")).select("project_id", F.concat(F.when(F.col("i") % 2 == 0, "run-").otherwise("see_"), F.col("i").cast("string")).alias("name"))


def agents(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("c") % 20 == 0, 12).otherwise(1)
    rows = _customers(spark, d).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    return rows.select("project_id", "scope", F.concat(F.lit("agent"), F.col("i").cast("string")).alias("path"), _entry(F.lit("x"), _pick(DESCRIPTIONS, 1), _pick(TOOLS)).alias("body"))


def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    return audit.run_checks(_customers(spark, d), documents(spark, d), settings(spark, d), skills(spark, d), commands(spark, d), agents(spark, d))


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.summary(audit_findings(spark, d))


def audit_hooks(spark: SparkSession, d: str) -> DataFrame:
    return audit.settings_hooks(settings(spark, d))


def audit_permissions(spark: SparkSession, d: str) -> DataFrame:
    return audit.settings_permissions(settings(spark, d))


def audit_servers(spark: SparkSession, d: str) -> DataFrame:
    return audit.servers(settings(spark, d)).withColumn("env_names", F.array_join("env_names", ","))


def audit_plugins(spark: SparkSession, d: str) -> DataFrame:
    return audit.settings_plugins(settings(spark, d))


def instruction_facts(spark: SparkSession, d: str) -> DataFrame:
    """Size, hash and first line of every document of the corpus, as if it were an instruction document."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("project_id"), F.col("source").alias("scope"), F.col("lang").alias("path"), F.col("text").alias("body"))
    return audit.instructions(docs)


QUERIES = {"audit_findings": audit_findings, "audit_summary": audit_summary, "audit_hooks": audit_hooks, "audit_permissions": audit_permissions, "audit_servers": audit_servers, "audit_plugins": audit_plugins, "instruction_facts": instruction_facts}


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_AT = lambda values, shift=0: f"{_sql_list(values)}[(c + {shift}) % {len(values)} + 1]"
_C = f"""WITH cs AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'project' END AS scope FROM customer),
s AS (SELECT *, ['*', 'Bash', '*'][c % 3 + 1] AS matcher, {_AT(COMMANDS)} AS command, [NULL, 5000, 20000, 10000][c % 4 + 1] AS timeout, {_AT(ALLOWED)} AS rule, CASE WHEN c % 7 = 0 THEN 2 ELSE 1 END AS times FROM cs),
h AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE times = 2),
docs AS (SELECT c, scope, 'a.md' AS path, {_AT(BODIES)} AS body FROM cs WHERE c % 11 <> 0 UNION ALL SELECT c, scope, 'b.md', 'Other build' FROM cs WHERE c % 9 = 0 UNION ALL SELECT c, scope, 'c.md', {_AT(BODIES)} FROM cs WHERE c % 13 = 0),
lined AS (SELECT *, CASE WHEN starts_with(body, '---') THEN 'Use `src/app.ts` here' WHEN body = 'LONG' THEN 'a line of it' ELSE body END AS line FROM docs),
own AS (SELECT c, lower(string_agg(line, ' ' ORDER BY path)) AS said FROM lined WHERE scope = 'project' GROUP BY 1),
lacks AS (SELECT c, said, array_to_string(list_filter([CASE WHEN NOT regexp_matches(said, '{audit.BUILD}') THEN 'build' END, CASE WHEN NOT regexp_matches(said, '{audit.TEST}') THEN 'test' END, CASE WHEN NOT regexp_matches(said, '{audit.VERIFY}') THEN 'verification' END], lambda x: x IS NOT NULL), ',') AS missing FROM own),
groups AS (SELECT c, min(scope) AS scope, count(*) AS n, count(DISTINCT body) AS kinds FROM docs GROUP BY 1),
copies AS (SELECT c, min(scope) AS scope, CASE WHEN body = 'LONG' THEN repeat('a line of it' || chr(10), 700) ELSE body END AS body FROM docs GROUP BY c, body HAVING count(*) > 1),
sk AS (SELECT *, 'one/SKILL.md' AS path, {_AT(DESCRIPTIONS)} AS description FROM cs UNION ALL SELECT *, 'two/SKILL.md', {_AT(DESCRIPTIONS)} FROM cs WHERE c % 8 = 0),
ag AS (SELECT *, {_AT(DESCRIPTIONS, 1)} AS description, unnest(range(1, CASE WHEN c % 20 = 0 THEN 13 ELSE 2 END)) AS i FROM cs),
sv AS (SELECT *, 'srv' AS name, c % 5 AS kind FROM cs UNION ALL SELECT *, 'inner', (c + 1) % 5 FROM cs WHERE c % 3 = 0)"""


def _found(family: str, slug: str, severity: str, confidence: float, source: str, where: str, subject: str, scope: str = "scope") -> str:
    return f"SELECT c AS project_id, '{family}' AS family, {scope} AS scope, '{slug}' AS slug, '{severity}' AS severity, {confidence}::DOUBLE AS confidence, CAST({subject} AS VARCHAR) AS subject FROM {source} WHERE {where}"


_HOOK = "'PreToolUse|' || matcher || '|' || command"
_FINDINGS = " UNION ALL ".join([
    _found("instructions", "large-file", "warning", 0.8, "lined", "body = 'LONG'", "path"), _found("instructions", "global-specialised", "info", 0.4, "lined", "scope = 'user' AND regexp_matches(line, '/(src|lib|app|packages|components)/')", "path"),
    _found("instructions", "sensitive-content", "critical", 0.6, "lined", "starts_with(line, 'password')", "path"), _found("instructions", "stale-ref", "info", 0.4, "lined", "starts_with(line, 'Use')", "path"),
    _found("instructions", "duplicate", "warning", 0.8, "copies", "true", "sha256(body)[1:16]"), _found("instructions", "conflicting", "warning", 0.6, "groups", "n > 1 AND kinds > 1", "n"),
    _found("instructions", "missing-build-test-verify", "info", 0.4, "lacks", "missing <> ''", "missing", "'project'"), _found("instructions", "missing-architecture", "info", 0.4, "lacks", f"NOT regexp_matches(said, '{audit.ARCHITECTURE}')", "''", "'project'"),
    _found("instructions", "missing-project", "warning", 0.6, "cs", "c NOT IN (SELECT c FROM own)", "''", "'project'"),
    _found("skills", "poor-description", "warning", 0.8, "sk", "description = ''", "path"), _found("skills", "verbose-description", "info", 0.4, "sk", "length(description) > 280", "path"), _found("skills", "missing-validation", "info", 0.4, "sk", "description = 'generate code'", "path"),
    _found("skills", "duplicate-skill", "warning", 0.8, "cs", "c % 8 = 0", "'s' || c % 3"), _found("skills", "repeated-workflow", "info", 0.4, "cs", "c % 5 = 0", "6", "'project'"),
    _found("hooks", "no-timeout", "warning", 0.8, "h", "timeout IS NULL", _HOOK), _found("hooks", "slow-hook", "warning", 0.8, "h", "timeout > 10000", _HOOK), _found("hooks", "broad-matcher", "warning", 0.8, "h", "matcher = '*'", _HOOK),
    _found("hooks", "behaviour-modifying", "warning", 0.4, "h", "regexp_matches(command, '^(tee|sed -i)')", _HOOK), _found("hooks", "script-ref", "info", 0.4, "h", "starts_with(command, 'scripts/')", _HOOK), _found("hooks", "duplicate-hook", "warning", 0.8, "s", "times = 2", _HOOK),
    _found("hooks", "own-health", "info", 0.8, "s", "command = 'tracemill-collect' AND timeout IS NULL", "times"),
    _found("agents", "broad-tools", "warning", 0.6, "ag", "c % 3 > 0", "'agent' || i"), _found("agents", "missing-limits", "warning", 0.8, "ag", "description = ''", "'agent' || i"), _found("agents", "accidental-invocation", "info", 0.4, "ag", "length(description) BETWEEN 1 AND 19", "'agent' || i"),
    _found("agents", "excessive-overhead", "info", 0.4, "cs", "c % 20 = 0", "12", "'user'"),
    _found("servers", "untrusted-command", "warning", 0.6, "sv", "kind = 1", "name"), _found("servers", "npx-fetch", "info", 0.4, "sv", "kind = 2", "name"), _found("servers", "env-secret-names", "info", 0.6, "sv", "kind = 2", "name"), _found("servers", "misconfigured", "warning", 0.8, "sv", "kind = 0", "name"),
    _found("permissions", "bypass-mode", "critical", 0.8, "cs", "c % 10 = 0", "'bypassPermissions'"), _found("permissions", "wildcard-allow", "critical", 0.8, "s", "rule = 'Bash(*)'", "rule"), _found("permissions", "dangerous-shell", "critical", 0.8, "s", "rule IN ('Bash(rm -rf /)', 'Bash(chmod 755 /x')", "rule"),
    _found("permissions", "network-allow", "warning", 0.6, "s", "starts_with(rule, 'Bash(curl')", "rule"), _found("permissions", "never-matches", "info", 0.6, "s", "rule = 'Bash(chmod 755 /x'", "rule"),
    _found("permissions", "scope-conflict", "warning", 0.8, "s", "rule = 'Read(.env)' AND c % 4 = 3", "rule"), _found("permissions", "sensitive-not-denied", "warning", 0.6, "s", "rule = 'Read(.env)' AND c % 4 <> 3", "'.env'", "'project'"),
])

ORACLE_SQL = {
    "audit_findings": f"{_C} {_FINDINGS}",
    "audit_summary": f"{_C}, f AS ({_FINDINGS}) SELECT scope, severity, count(*) AS findings FROM f GROUP BY 1, 2",
    "audit_hooks": f"{_C} SELECT c AS project_id, scope, 'settings.json' AS path, 'PreToolUse' AS event, matcher, command, timeout FROM h",
    "audit_permissions": f"{_C} SELECT c AS project_id, scope, 'settings.json' AS path, 'allow' AS effect, rule FROM s UNION ALL SELECT c, scope, 'settings.json', 'deny', 'Read(.env)' FROM s WHERE c % 4 = 3 UNION ALL SELECT c, scope, 'settings.json', 'mode', 'bypassPermissions' FROM s WHERE c % 10 = 0",
    "audit_servers": f"{_C} SELECT c AS project_id, scope, 'settings.json' AS path, name, ['unknown', 'stdio', 'stdio', 'sse', 'stdio'][kind + 1] AS transport, [NULL, './run', 'npx thing', NULL, 'node'][kind + 1] AS command, CASE WHEN kind = 3 THEN 'http://x' END AS url, CASE WHEN kind = 2 THEN 'API_TOKEN,HOME' ELSE '' END AS env_names FROM sv",
    "audit_plugins": f"{_C} SELECT c AS project_id, scope, 'settings.json' AS path, 'p' || c AS plugin, c % 2 = 0 AS enabled FROM cs",
    "instruction_facts": """WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents) SELECT doc_id AS project_id, source AS scope, lang AS path, octet_length(encode(t)) AS bytes, len(regexp_split_to_array(t, '\\r?\\n')) AS lines, greatest(1, round(length(t) / 4))::BIGINT AS tokens, sha256(t)[1:16] AS hash,
  coalesce(list_filter(list_transform(regexp_split_to_array(t, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '')[1], '') AS first_line FROM d""",
}
