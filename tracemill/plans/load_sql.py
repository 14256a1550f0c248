"""The results of load_queries in DuckDB's SQL, stated over the conversations alone."""

from tracemill.functions import text
from tracemill.plans import queries as base
from tracemill.sources import load, store

_REDACTED = base.redacted_sql("content")
TURNS = """turns AS (SELECT *, CAST(conv_id AS VARCHAR) AS s, conv_id AS c, (conv_id + turn) % 6 AS k, 1704067200000 + (conv_id % 24) * 3600000 + CASE WHEN conv_id % 7 = 4 THEN 59 - turn % 60 ELSE turn % 60 END * 60000 AS base, '/home/u/p' || (conv_id % 5) || '/src/f' || (turn % 3) || '.py' AS path FROM conversations),
lines AS (SELECT s, turn, -1 AS sub, 'summary' AS what, NULL::BIGINT AS ts FROM turns WHERE turn = 0 AND c % 8 = 0
  UNION ALL SELECT s, turn, 0, role, base FROM turns WHERE role IN ('user', 'system') UNION ALL SELECT s, turn, 1, 'assistant', base + 1000 FROM turns WHERE role = 'assistant' UNION ALL SELECT s, turn, 2, 'assistant', base + 1000 FROM turns WHERE role = 'assistant'
  UNION ALL SELECT s, turn, 3, 'user', base + 3000 FROM turns WHERE role = 'assistant' AND turn % 7 <> 3
  UNION ALL SELECT s, turn, 5, ['broken', 'other', 'untimed', 'array'][c % 9 + 1], CASE WHEN c % 9 = 1 THEN base + 5000 END FROM turns WHERE turn = 0 AND c % 9 < 4),
numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY turn, sub) AS line_no FROM lines),
calls AS (SELECT t.*, 't' || turn || '-' || c AS call_id, ['Read', 'Edit', 'Bash', 'Bash', 'Grep', 'Task'][k + 1] AS tool, turn % 7 <> 3 AS answered, (c + turn) % 4 = 0 AS failed, (SELECT count(*) FROM turns p WHERE p.c = t.c AND p.role = 'user' AND p.turn < t.turn) AS before,
  CASE k WHEN 2 THEN 'npm test' WHEN 3 THEN 'git commit -m x ' || substr(sha256(CAST(turn AS VARCHAR)), 1, 40) END AS command, CASE WHEN k IN (0, 1) THEN path END AS file FROM turns t WHERE role = 'assistant'),
prompts AS (SELECT s AS session_id, row_number() OVER (PARTITION BY c ORDER BY turn) AS sequence, base AS ts, CASE WHEN turn % 5 = 4 THEN trim(text) ELSE text END AS content FROM turns WHERE role = 'user'),
requests AS (SELECT s AS session_id, 'm' || turn AS message_id, base + 1000 AS ts, CASE WHEN before > 0 THEN s || ':p:' || before END AS prompt_id, CASE c % 3 WHEN 0 THEN 'north-large' WHEN 2 THEN 'delta-mid' END AS model_id,
  CASE WHEN c % 10 <> 7 THEN length(text) END AS input_tokens, CASE WHEN c % 10 <> 7 THEN turn + 2 END AS output_tokens, CASE WHEN c % 10 <> 7 AND c % 2 = 0 THEN turn * 10 END AS cache_read_input_tokens, NULL::BIGINT AS cache_creation_input_tokens FROM calls),
tool_calls AS (SELECT s AS session_id, call_id, base + 1000 AS ts, CASE WHEN before > 0 THEN s || ':p:' || before END AS prompt_id, CASE WHEN k = 5 THEN 'subagent' END AS attribution, tool, sha256(CASE k WHEN 0 THEN '{"file_path":"' || path || '"}' WHEN 1 THEN '{"content":"héé","file_path":"' || path || '"}' WHEN 4 THEN '{"pattern":"x"}' WHEN 5 THEN '{}' ELSE '{"command":"' || command || '"}' END) AS input_hash, CASE WHEN answered THEN 'matched' ELSE 'partial' END AS state, answered AND NOT failed AS success,
  CASE WHEN NOT answered THEN 'unknown' WHEN failed THEN 'error' END AS failure_type,
  CASE k WHEN 0 THEN 16 + length(path) WHEN 1 THEN 34 + length(path) WHEN 2 THEN 22 WHEN 3 THEN 14 + length(command) WHEN 4 THEN 15 ELSE 2 END AS input_bytes,
  CASE WHEN answered THEN CASE WHEN failed THEN octet_length(encode(chr(10) || '  line ' || turn || ' failed' || chr(10) || 'more')) ELSE 4 END END AS output_bytes, CASE WHEN answered THEN 2000 END AS duration_ms, CASE k WHEN 0 THEN 'read' WHEN 1 THEN 'edit' WHEN 4 THEN 'search' END AS operation, file AS path,
  CASE WHEN k = 1 THEN 5 END AS content_bytes, command, CASE WHEN answered AND failed THEN '  line ' || turn || ' failed' END AS failure_signature FROM calls),
files AS (SELECT call_id || ':file' AS id, session_id, call_id, ts, operation, replace(path, '/home/u', '[HOME]') AS path, sha256('path:' || path) AS path_hash, success, content_bytes FROM tool_calls WHERE path IS NOT NULL),
commands AS (SELECT call_id || ':cmd' AS id, session_id, call_id, ts, split_part(command, ' ', 1) AS executable, split_part(command, ' ', 1) AS family, command, sha256('cmd:' || lower(command)) AS command_hash, CASE WHEN command = 'npm test' THEN 'test' ELSE 'git' END AS classification, 'narrow' AS scope, success, output_bytes, failure_signature,
  CASE WHEN command <> 'npm test' THEN substr(command, 17) END AS commit_id FROM tool_calls WHERE command IS NOT NULL),
verifications AS (SELECT call_id || ':verify' AS id, session_id, call_id, ts, 'unit-test' AS kind, success FROM commands WHERE classification = 'test'),
compactions AS (SELECT s AS session_id, base AS ts, 'compact_boundary' AS label FROM turns WHERE role = 'system'),
ends AS (SELECT s, arg_min(ts, line_no) AS started_at, arg_max(ts, line_no) AS ended_at FROM numbered WHERE what NOT IN ('broken', 'array', 'untimed', 'summary') GROUP BY 1),
sums AS (SELECT s, any_value(c) AS c, arg_max(turn, turn) FILTER (role = 'assistant') AS last_turn, count(*) FILTER (role = 'user') AS prompts, count(*) FILTER (role = 'assistant') AS asked, count(*) FILTER (role = 'system') AS compactions, count(*) FILTER (role = 'assistant' AND k = 5) AS subagent_calls FROM turns GROUP BY 1),
sessions AS (SELECT s AS session_id, started_at, ended_at, ended_at - started_at AS duration_ms, CASE WHEN last_turn % 4 = 1 THEN 'completed' ELSE 'interrupted' END AS completion, 'unknown' AS entry_point, CASE WHEN prompts > 0 THEN '/home/u/p' || (c % 5) END AS cwd, prompts, asked AS model_requests, asked AS tool_calls, compactions, subagent_calls,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN last_turn % 4 = 1 THEN NULL ELSE 'tail-missing' END, CASE WHEN asked > 0 AND c % 10 = 7 THEN 'metrics-missing' END, CASE WHEN prompts = 0 THEN 'prompts-missing' END], lambda x: x IS NOT NULL), ','), ''), 'complete') AS completeness FROM sums JOIN ends USING (s)),
diagnostics AS (SELECT s AS session_id, line_no, CASE what WHEN 'broken' THEN 'error' WHEN 'other' THEN 'info' ELSE 'warn' END AS level, CASE what WHEN 'broken' THEN 'malformed JSON' WHEN 'other' THEN 'unknown type' WHEN 'array' THEN 'not a record' WHEN 'untimed' THEN 'invalid timestamp' ELSE 'no timestamp yet' END AS note FROM numbered WHERE what IN ('broken', 'other', 'array', 'untimed', 'summary'))"""
WITH = f"WITH {TURNS}"
_FEATURES = base.features_sql("session_id, sequence, content, ts", "(SELECT * REPLACE (REDACTED AS content) FROM prompts)".replace("REDACTED", _REDACTED))
_PART = lambda table, kind, label, rank: f"SELECT session_id, ts, '{kind}' AS kind, {label} AS label, {rank} AS rank FROM {table}"
_TIMELINE = " UNION ALL ".join([_PART("prompts", "prompt", "sha256(content)", "sequence * 10"), _PART("requests", "model", "message_id", 1), _PART("tool_calls", "tool", "call_id", 2), _PART("files", "file", "id", 3), _PART("commands", "command", "id", 4), _PART("verifications", "verification", "id", 5), _PART("compactions", "compaction", "label", 6)])
_N = "count(DISTINCT conv_id)"
_LIST = lambda pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL), '; ')"
_LINES = "list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_LEAD = f"list_filter({_LINES}, lambda x: regexp_replace(lower(regexp_split_to_array(x, '\\s+')[1]), '[^a-z]', '', 'g') IN ({', '.join(repr(v) for v in text.IMPERATIVES)}))"
_AIM = f"regexp_replace(trim(coalesce({_LEAD}[1], regexp_extract(coalesce({_LINES}[1], ''), '^([^.!?]*[.!?]?)', 1))), '\\s+', ' ', 'g')"
_ITEMS = "list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '^\\s*([-*]|\\d+[.)])\\s+', ''))), lambda x: x <> '')"
_REFS = "list_filter(regexp_extract_all(content, '`[^`\\n]+`'), lambda x: regexp_matches(x, '[./]'))"
_SUGGESTION = f"""CASE WHEN multi_task THEN CASE WHEN len({_ITEMS}) >= 2 THEN 'Tasks, one prompt each:' || chr(10) || '  - ' || array_to_string({_ITEMS}, chr(10) || '  - ') ELSE '[one aim]' END WHEN {_AIM} = '' THEN '[the aim]' ELSE {_AIM} END || chr(10) ||
  CASE WHEN len({_REFS}) > 0 THEN 'Target: ' || array_to_string({_REFS}, ', ') ELSE 'Target: [file or symbol]' END || chr(10) || CASE WHEN criteria THEN 'Done when: as stated' ELSE 'Done when: [criteria]' END || chr(10) ||
  CASE WHEN asks_verification THEN 'Check: as stated' ELSE 'Check: run the tests and report' END || chr(10) || CASE WHEN scoped THEN 'Bounds: as stated' ELSE 'Bounds: change the target alone' END"""
_COMPONENT = "what is to be done", "the file or symbol it is about", "when it is done", "how it is checked", "what stays as it is", "one prompt for each task"
_MISSING = [(_COMPONENT[5], "multi_task"), (_COMPONENT[0], f"CASE WHEN multi_task THEN len({_ITEMS}) < 2 ELSE {_AIM} = '' END"), (_COMPONENT[1], f"len({_REFS}) = 0"), (_COMPONENT[2], "NOT criteria"), (_COMPONENT[3], "NOT asks_verification"), (_COMPONENT[4], "NOT scoped")]
_GOOD = [("begins with what to do", "imperatives > 0"), ("names its target", "file_refs > 0"), ("says when it is done", "criteria"), ("asks for a check", "asks_verification"), ("bounds its scope", "scoped"), ("has one aim", "length > 0 AND NOT multi_task")]
_VAGUE = [("vague references", "vague > 0"), ("no target", "file_refs = 0 AND length > 0"), ("no criteria", "NOT criteria"), ("no check", "NOT asks_verification"), ("several tasks", "multi_task"), ("no bounds", "NOT scoped")]
_OUTCOME = "coalesce(nullif(array_to_string(list_filter([CASE WHEN later_corrections > 0 THEN later_corrections || ' corrective prompts followed' END, CASE WHEN later_reversals > 0 THEN later_reversals || ' reversals followed' END, CASE WHEN ran THEN 'a check ran in the session' END], lambda x: x IS NOT NULL), '; '), ''), 'nothing of note followed')"

_HOUR = lambda h: 1_704_067_200_000 + h * 3_600_000
_TABLES = {"prompts": "prompts", "model_requests": "requests", "tool_calls": "tool_calls", "file_activity": "files", "command_runs": "commands", "verification_runs": "verifications", "compactions": "compactions"}
_HOLD = "hold AS (" + " UNION ALL ".join([f"SELECT '{t}' AS \"table\", session_id, ts FROM {s}" for t, s in _TABLES.items()] + ["SELECT 'diagnostics', session_id, NULL FROM diagnostics", "SELECT 'sessions', session_id, NULL FROM sessions", "SELECT DISTINCT 'scan_state', CAST(conv_id AS VARCHAR), NULL::BIGINT FROM conversations"]) + ")"

ORACLE_SQL = {
    "loaded_prompts": f"{WITH} SELECT session_id, sequence, ts, sha256({_REDACTED}) AS content_sha256, sha256(content) AS content_hash, length(content) AS character_count, CAST(ceil(length(content) / 4) AS BIGINT) AS approximate_tokens FROM prompts",
    "loaded_requests": f"{WITH} SELECT * FROM requests",
    "loaded_calls": f"{WITH} SELECT * FROM tool_calls",
    "loaded_files": f"{WITH} SELECT * FROM files",
    "loaded_commands": f"{WITH} SELECT * FROM commands",
    "loaded_verifications": f"{WITH} SELECT * FROM verifications",
    "loaded_sessions": f"{WITH} SELECT * FROM sessions",
    "loaded_diagnostics": f"{WITH} SELECT * FROM diagnostics",
    "scan_summary": f"""{WITH}, d AS (SELECT count(*) AS n FROM diagnostics), c AS (SELECT {_N} AS n, count(DISTINCT conv_id) FILTER (conv_id % 5 <> 1) AS rest FROM conversations)
  SELECT c.n AS discovered, 0::BIGINT AS imported, c.n AS skipped, 0::BIGINT AS diagnostics, 0::BIGINT AS pruned, 'again' AS run FROM c UNION ALL SELECT c.n, c.n, 0, CAST(d.n AS BIGINT), 0, 'forced' FROM c, d UNION ALL SELECT rest, 0, rest, 0, 0, 'dry, a project excluded' FROM c""",
    "store_rewrites": f"""{WITH}, {_HOLD}, b AS (SELECT DISTINCT "table", ('0x' || substr(md5(session_id), 1, 8))::BIGINT % {store.BUCKETS} AS b FROM hold), grown AS (SELECT DISTINCT ('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8))::BIGINT % {store.BUCKETS} AS b FROM conversations WHERE conv_id % 5 = 3)
  SELECT "table", CAST(count(*) AS INTEGER) AS buckets, CAST(count(*) FILTER (b IN (SELECT b FROM grown)) AS INTEGER) AS rewritten, CAST(count(*) FILTER (b NOT IN (SELECT b FROM grown)) AS INTEGER) AS kept FROM b GROUP BY 1""",
    "scan_range": f"""{WITH}, {_HOLD}, gone AS (SELECT session_id FROM sessions WHERE ended_at < {_HOUR(9)}), left_over AS (SELECT * FROM hold WHERE "table" = 'scan_state' OR session_id NOT IN (SELECT session_id FROM gone) AND (ts IS NULL OR ts BETWEEN {_HOUR(6)} AND {_HOUR(18)}))
  SELECT t."table", count(l.session_id) AS rows, count(l.session_id) FILTER (l."table" <> 'scan_state' AND CAST(l.session_id AS BIGINT) % 5 = 2 AND l.session_id IN (SELECT session_id FROM sessions)) AS gone FROM (VALUES {", ".join(f"('{t}')" for t in load.TABLES)}) t("table") LEFT JOIN left_over l ON l."table" = t."table" GROUP BY 1
  UNION ALL SELECT 'pruned sessions', count(*), 0 FROM gone""",
    "tool_behaviour": f"""{WITH} SELECT tool, count(*) AS calls, count(*) FILTER (NOT success) AS failures, round(count(*) FILTER (NOT success) / count(*), 6) AS failure_rate, round(avg(duration_ms), 4) AS mean_duration_ms, max(input_bytes) AS largest_input, max(output_bytes) AS largest_output, count(attribution) AS subagent_calls FROM tool_calls GROUP BY ROLLUP (tool)""",
    "repeated_tool_searches": f"""{WITH} SELECT project, tool, input_hash, count(*) AS occurrences, count(DISTINCT session_id) AS sessions FROM (SELECT *, CAST(session_id AS BIGINT) % 5 AS project FROM tool_calls) WHERE tool IN ('Grep', 'Glob', 'WebSearch', 'WebFetch') GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    "overview_tops": f"""{WITH}, t AS (SELECT tool AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tool) AS place FROM tool_calls GROUP BY 1), c AS (SELECT executable || ' ' || classification AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, executable || ' ' || classification) AS place FROM commands GROUP BY 1)
  SELECT 'tools' AS list, CAST(place AS INTEGER) AS place, name, n FROM t WHERE place <= 6 UNION ALL SELECT 'commands', CAST(place AS INTEGER), name, n FROM c WHERE place <= 5""",
    "loaded_usage": f"""{WITH} SELECT CAST(session_id AS BIGINT) % 5 AS project, count(*) AS sessions, CAST(sum(compactions) AS BIGINT) AS compactions, CAST(sum(subagent_calls) AS BIGINT) AS subagent_calls, CAST(sum(tool_calls) AS BIGINT) AS tool_calls FROM sessions GROUP BY ROLLUP (1)""",
    "completeness": f"{WITH} SELECT count(*) FILTER (completeness = 'complete') AS complete, count(*) FILTER (completeness LIKE '%tail-missing%') AS tail_missing, count(*) FILTER (completeness LIKE '%metrics-missing%') AS metrics_missing, count(*) FILTER (completeness LIKE '%prompts-missing%') AS prompts_missing FROM sessions",
    "scan_provenance": f"{WITH} SELECT 's' || min(CAST(session_id AS BIGINT) % 2) AS source_id, CASE min(CAST(session_id AS BIGINT) % 2) WHEN 0 THEN '1.2' ELSE '1.3' END AS adapter_version, 1 AS parser_version, count(*) AS imported FROM sessions",
    "session_timeline": f"{WITH}, t AS ({_TIMELINE}) SELECT session_id, ts, kind, label, row_number() OVER (PARTITION BY session_id ORDER BY ts, rank, kind, label) AS position FROM t",
    "prompt_comparison": f"""{WITH}, {_FEATURES},
  o AS (SELECT *, coalesce(count(*) FILTER (corrective) OVER w, 0) AS later_corrections, coalesce(count(*) FILTER (reversal) OVER w, 0) AS later_reversals, session_id IN (SELECT session_id FROM verifications) AS ran FROM f WINDOW w AS (PARTITION BY session_id ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT session_id, sequence, {_LIST(_GOOD)} AS strengths, {_LIST(_VAGUE)} AS ambiguities, {_LIST(_MISSING)} AS missing, {_OUTCOME} AS outcome, sha256({_SUGGESTION}) AS suggestion_sha256, 'Put together from what the prompt states; it need not work better.' AS disclaimer FROM o""",
    "metadata_only": f"""{WITH} SELECT 'prompts' AS "table", count(*) AS rows, 0::BIGINT AS content_values FROM prompts UNION ALL SELECT 'tool_calls', count(*), 0 FROM tool_calls UNION ALL SELECT 'file_activity', count(*), 0 FROM files UNION ALL SELECT 'command_runs', count(*), 0 FROM commands""",
}
