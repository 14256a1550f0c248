"""Operators on small made-up tables."""

import json
import random
import statistics

from pyspark.sql import functions as F

from tracemill.operators import audit, baselines, correlation, costs, medians, metrics, retention, rules
from tracemill.plans import report, snapshot
from tracemill.sources import otlp

HOUR = 3_600_000


def test_prices_take_the_longest_family_and_overrides(spark):
    prices = costs.price_list(spark, [("a", "1", "1", "0", "0"), ("a-b", "2", "2", "0", "0")]).unionByName(costs.price_list(spark, [("a-b", "3", "3", "0", "0")], "override"))
    models = spark.createDataFrame([("a-b-2024",), ("a-c",), ("z",), ("a-b",)], "model_id string")
    got = {r["model_id"]: (r["family"], float(r["input"] or 0), r["price_source"]) for r in costs.resolve_prices(models, prices).collect()}
    assert got == {"a-b-2024": ("a-b", 3.0, "override"), "a-c": ("a", 1.0, "default"), "z": (None, 0.0, None), "a-b": ("a-b", 3.0, "override")}


def test_tiers_and_dominant_models(spark):
    entries = costs.catalogue(spark, [("a", 1, 1), ("a-b", 2, 2)]).unionByName(costs.catalogue(spark, [("a", 5, 5)], "override"))
    requests = spark.createDataFrame([(1, "a-b-9"), (1, "z"), (2, "z"), (2, "z"), (2, "a-b")], "project_id int, model_id string")
    assert {r["model_id"]: (r["capability"], r["cost_tier"]) for r in costs.tiers(requests, entries).collect()} == {"a-b-9": (5, 5), "z": (0, 0), "a-b": (2, 2)}
    assert {r["project_id"]: (r["model_id"], r["requests"]) for r in costs.dominant_models(requests).collect()} == {1: ("a-b-9", 2), 2: ("z", 3)}


def test_pairing_states(spark):
    rows = [(1, True), (2, True), (3, False), (4, False), (5, True)]
    df = spark.createDataFrame([("s", "c", t, t, u) for t, u in rows], "session_id string, call_id string, ts long, event_id long, is_use boolean")
    assert [(r["event_id"], r["state"], r["duration_ms"]) for r in metrics.pair_calls(df).orderBy("event_id").collect()] == [(1, "overwritten", None), (2, "matched", 1), (4, "orphan", None), (5, "partial", None)]


def test_correlation_tiers(spark):
    sessions = spark.createDataFrame([("s1", 1, 10 * HOUR), ("s2", 1, 20 * HOUR), ("s3", 2, 30 * HOUR)], "session_id string, project_id int, started_at long")
    events = spark.createDataFrame([(1, 1, "s3", 10 * HOUR), (2, 1, None, 11 * HOUR), (3, 1, None, 15 * HOUR), (4, None, None, 29 * HOUR), (5, None, None, 25 * HOUR)], "event_id int, project_id int, source_session_id string, ts long")
    got = {r["event_id"]: (r["session_id"], r["confidence"]) for r in correlation.correlate(events, sessions).collect()}
    assert got == {1: ("s3", 1.0), 2: ("s1", 0.7), 3: ("s2", 0.4), 4: ("s3", 0.25)}


def test_rules_fire_and_stay_silent(spark):
    loud = spark.createDataFrame([(1, 5, 4)], "project_id int, repeated_read_top int, secret_findings int")
    chosen = [r for r in rules.RULES if r.id in ("TOOLS-001", "SECURITY-002")]
    got = {r["rule_id"]: r["confidence"] for r in rules.evaluate(loud, chosen).collect()}
    assert got == {"TOOLS-001": 0.9, "SECURITY-002": 0.9}
    off = {"TOOLS-001": {"min": 6}, "SECURITY-002": {"enabled": False}}
    assert rules.evaluate(loud, chosen, off).count() == 0
    assert [tuple(r) for r in rules.skipped(loud, chosen, off).collect()] == [("SECURITY-002", "disabled")]
    assert rules.evaluate(loud.withColumn("repeated_read_top", F.lit(2)), chosen[:1]).count() == 0
    assert len({r.id for r in rules.RULES}) == 34
    left_out = {r["rule_id"]: r["why"] for r in rules.skipped(loud).collect()}
    assert len(left_out) == 32 and rules.evaluate(loud).count() == 2
    broken = rules.Rule("TOOLS-009", "low", "repeated_read_top ===", "1", "repeated_read_top", "none")
    assert rules.evaluate(loud, [*chosen, broken]).count() == 2 and rules.skipped(loud, [broken]).count() == 1


def everything(spark, value):
    names = "sessions median_ms prompts_per_session tools_per_session compactions files_per_session read_write_ratio changed_unverified narrow_only ended_failed changed_after_verification corrective_prompts repeated_read_top repeated_command_top repeated_failed_top repeated_search_top sum_repeated_reads sum_repeated_searches max_output failure_rate tests builds broad_tests worst_tool_failures worst_tool_rate input_tokens cache_read_tokens prompt_count criteria_prompts verify_prompts multi_prompts vague_refs correction_prompts requests dominant_cost_tier dominant_capability sensitive_ops secret_findings retention_days broad_exclusions exclusions"
    return spark.range(1).select(F.lit(1).alias("project_id"), *(F.lit(value).alias(n) for n in names.split()), *(F.lit(bool(value)).alias(n) for n in snapshot.FLAGS))


def test_every_rule_can_be_evaluated(spark):
    for value in (0, 10):
        df = everything(spark, value)
        assert rules.skipped(df).count() == 0
        found = rules.evaluate(df, min_confidence=0.0).count()
        assert found > 20 if value else found < 20


def test_configuration_rules_count_their_reasons(spark):
    of = lambda **k: {r["rule_id"]: (r["severity"], r["confidence"]) for r in rules.evaluate(everything(spark, 0).withColumns({n: F.lit(v) for n, v in k.items()}), min_confidence=0.0).where("category = 'configuration'").collect()}
    assert of() == {}
    assert of(retention_days=366) == {"CONFIG-001": ("medium", 0.6)} and of(retention_days=365) == {}
    assert of(full_local=True, exclusions=5) == {"CONFIG-001": ("high", 0.75)} and of(full_local=True, exclusions=5, retention_days=400) == {"CONFIG-001": ("high", 0.8)}
    assert of(beyond_loopback=True) == {"CONFIG-002": ("high", 0.7)} and of(beyond_loopback=True, external_provider=True) == {"CONFIG-002": ("high", 0.85)}


def test_fingerprints_follow_the_evidence(spark):
    rule = [r for r in rules.RULES if r.id == "VERIFY-001"]
    mark = lambda unverified, sessions: rules.evaluate(everything(spark, 0).withColumns({"changed_unverified": F.lit(unverified), "sessions": F.lit(sessions)}), rule, min_confidence=0.0).first()["fingerprint"]
    assert mark(2, 5) == mark(2, 5) and len({mark(2, 5), mark(2, 6), mark(3, 5)}) == 3


def test_score_has_every_term(spark):
    day = 86_400_000
    row = (1, "R", "high", 0.8, [("occurrences", 4.0)], 0.5, 10 * day, ["a", "b", "a"], "do", True)
    schema = "project_id int, rule_id string, severity string, confidence double, evidence array<struct<label:string,value:double>>, impact_confidence double, updated_at long, references array<string>, remedy string, automatic boolean"
    score = lambda r, dismissed=(): rules.rank(spark.createDataFrame([r], schema), 12 * day, spark.createDataFrame([(x,) for x in dismissed], "rule_id string")).first()["score"]
    assert score(row) == 24 + 20 + 7.5 + 7 + 4 + 6 + 7
    assert score(row, ["R"]) == score(row) - 6
    assert score((1, "R", "info", 0.0, [("count", 40.0)], None, -day, None, None, None)) == 6 + 10
    assert score((1, "R", "low", 1.0, [], None, 12 * day, list("abcdefg"), "do", False)) == 12 + 25 + 10 + 10 + 2


def test_merge_actions(spark):
    stored = spark.createDataFrame([("f1", "R1", 1, "active", 0, 0), ("f2", "R1", 2, "dismissed", 0, 0), ("f3", "R2", 1, "active", 0, 0), ("f4", "R3", 1, "active", 0, 0)], "fingerprint string, rule_id string, project_id int, status string, created_at int, updated_at int")
    new = spark.createDataFrame([("f1", "R1", 1), ("f2", "R1", 2), ("f5", "R2", 1)], "fingerprint string, rule_id string, project_id int")
    merged = rules.merge(stored, new, 9)
    got = {r["fingerprint"]: (r["action"], r["status"], r["updated_at"], r["created_at"]) for r in merged.collect()}
    assert got == {"f1": ("touched", "active", 9, 0), "f2": ("retained", "dismissed", 0, 0), "f3": ("superseded", "superseded", 9, 0), "f4": ("retained", "active", 0, 0), "f5": ("inserted", "active", 9, 9)}
    assert tuple(rules.outcome(merged).first()) == (1, 1, 1, 1)
    assert {r["fingerprint"] for r in rules.reported(merged, new).collect()} == {"f1", "f5"}


def test_status_changes_that_fit(spark):
    stored = spark.createDataFrame([(f, s, 0) for f, s in (("a", "active"), ("b", "dismissed"), ("c", "resolved"), ("d", "superseded"), ("e", "active"))], "fingerprint string, status string, updated_at int")
    changes = spark.createDataFrame([("a", "dismiss", 1), ("a", "resolve", 2), ("b", "restore", 3), ("c", "reopen", 4), ("d", "restore", 5), ("e", "restore", 6)], "fingerprint string, change string, at int")
    got = {r["fingerprint"]: (r["status"], r["updated_at"]) for r in rules.change_status(stored, changes).collect()}
    assert got == {"a": ("resolved", 2), "b": ("active", 3), "c": ("active", 4), "d": ("superseded", 0), "e": ("active", 0)}


def test_medians_are_exact(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1.0, 2.5, 1e9, -3.0, rnd.random(), None])) for _ in range(3000)] + [("one", 4.0), ("same", 7.0), ("same", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    groups = {k: sorted(x for j, x in rows if j == k and x is not None) for k in {k for k, _ in rows}}
    assert {r["k"]: (r["median"], r["n"]) for r in medians.medians(df, ["k"], "x").collect()} == {k: (statistics.median(v), len(v)) for k, v in groups.items() if v}
    assert {r["k"]: r["median"] for r in medians.medians(df, ["k"], "x", upper=True).collect()} == {k: statistics.median_high(v) for k, v in groups.items() if v}


def test_medians_beside_outliers(spark):
    """One value of 1e15 among 10^6 leaves few rows to put in order, and so do values of any other shape."""
    n = 1_000_000
    for shape in ("if(id = 7, 1e15, cast(id % 65521 as double))", "cast(id as double)", "exp(id % 700)", "cast(pmod(xxhash64(id), 3) as double)"):
        df = spark.range(0, n, 1, 4).selectExpr("cast(null as string) as k", f"{shape} as value").cache()
        assert medians.bracketed(df, ["k"]).count() < 0.01 * n
        assert medians.medians(df, ["k"], "value").first()["median"] == df.selectExpr("percentile(value, 0.5)").first()[0]
        df.unpersist()


def test_attached_medians_count_rows_of_no_group_once(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 3, None), (None, 10, 7.0), ("b", 4, 9.0)], "k string, x int, y double")
    groups = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert {tuple(r) for r in medians.attach(groups, rows, "k", mx="x", my="y").collect()} == {("a", 2.0, 5.0), ("b", 4.0, 9.0), (None, 3.5, 7.0)}


def test_baselines_and_comparison(spark):
    base = {d: 0.0 for d in baselines.DIMENSIONS}
    values = [(1, 100.0, 0.0), (1, 200.0, 0.0), (1, 300.0, 3.0), (2, 1000.0, 0.0)]
    rows = [{"project_id": p, "session_id": f"s{i}", "started_at": i, **base, "duration_ms": d, "corrective_turns": c, "read_write_ratio": None} for i, (p, d, c) in enumerate(values)]
    points = spark.createDataFrame(rows, "project_id int, session_id string, started_at long, " + ", ".join(f"{d} double" for d in baselines.DIMENSIONS))
    found = baselines.baselines(points, most=2)
    got = {(r["scope"], r["scope_key"]): (r["median"], r["mad"], r["n"], r["provenance"]) for r in found.where("dimension = 'duration_ms'").collect()}
    assert got == {("personal", None): (250.0, 100.0, 4, "inferred"), ("project", 1): (200.0, 100.0, 3, "inferred"), ("project", 2): (1000.0, 0.0, 1, "reported"), ("recent", None): (650.0, 350.0, 2, "inferred")}
    assert found.where("dimension = 'read_write_ratio'").count() == 0
    c = {(r["session_id"], r["scope"], r["dimension"]): r for r in baselines.compare(points, found).collect()}
    assert (c["s2", "personal", "corrective_turns"]["ratio"], c["s2", "personal", "corrective_turns"]["direction"]) == (float("inf"), "typical")
    assert c["s3", "personal", "duration_ms"]["score"] == 7.5 and c["s3", "personal", "duration_ms"]["direction"] == "higher" and c["s3", "personal", "duration_ms"]["ratio"] == 4.0
    assert c["s0", "personal", "corrective_turns"]["ratio"] == 0.0 and ("s0", "project", "duration_ms") in c and len([k for k in c if k[0] == "s0" and k[2] == "duration_ms"]) == 3


def test_retention(spark):
    sessions = spark.createDataFrame([("a", 1, 0, 10), ("b", 1, 0, None), ("c", 2, 0, 5 * retention.DAY_MS)], "session_id string, project_id int, started_at long, ended_at long")
    gone = retention.expired(sessions, 4 * retention.DAY_MS, 2)
    assert {r[0] for r in gone.collect()} == {"a", "b"} and retention.expired(sessions, 10, 0).count() == 0
    child = spark.createDataFrame([("a",), ("c",), (None,)], "session_id string")
    after = retention.without({"child": child}, gone)
    assert retention.summary({"child": child}, after).first()["gone"] == 1


def test_purges_reach_what_only_points_at_sessions(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "sessions": make([("a", 1, 5, None), ("b", 2, 50, 90)], "session_id string, project_id int, started_at long, ended_at long"), "prompts": make([("a",), ("b",)], "session_id string"), "projects": make([(1,), (2,)], "project_id int"),
        "hook_events": make([("a", 99), (None, 5), (None, 99)], "correlated_session_id string, ts long"),
    }
    rows = lambda after: {k: df.count() for k, df in after.items()}
    now = 2 * retention.DAY_MS + 60
    assert rows(retention.prune(tables, now, 2)) == {"sessions": 1, "prompts": 1, "projects": 2, "hook_events": 1}
    assert rows(retention.prune(tables, now, 0)) == rows(tables)
    assert rows(retention.purge_project(tables, 1)) == {"sessions": 1, "prompts": 1, "projects": 1, "hook_events": 2}
    assert set(rows(retention.purge_all(tables)).values()) == {0}


def test_otlp(spark):
    body = {"resourceSpans": [{"resource": {"attributes": [{"key": "session_id", "value": {"intValue": "7"}}]}, "scopeSpans": [{"spans": [{"name": "run", "startTimeUnixNano": "1999999"}, "x"]}]}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "{broken"), (3, "{}")], "body_id int, body string")
    got = otlp.flatten(df, "trace").collect()
    assert [(r["body_id"], r["name"], r["ts"], r["session_id"]) for r in got] == [(1, "run", 1, "7")]


def found_in(findings):
    return {(r["slug"], r["subject"]) for r in findings.collect()}


def test_settings_audit(spark):
    body = {
        "hooks": {"PreToolUse": [{"hooks": [{"command": "x"}, {"command": "x", "timeout": 20_000}]}], "Stop": "no list"},
        "permissions": {"allow": ["Bash( * )", "Read(/a/.env)", "Bash(sudo x", "Bash(:(){ :|:& };:)", "Bash(chmod 755 /)", "Bash(wget *)", "Read(/b/id_rsa)", 7], "deny": ["Read(/b/id_rsa)"], "defaultMode": "bypassPermissions"},
        "mcpServers": {"a": {"command": "~/x", "env": {"GH-TOKEN": "1", "PATH": "2"}}, "b": {}}, "enabledPlugins": {"p": True, "q": "yes"},
    }
    df = spark.createDataFrame([(1, "project", "s.json", json.dumps(body)), (2, "user", "s.json", None), (3, "user", "s.json", "[1]")], "project_id int, scope string, path string, body string")
    assert {s for s, _ in found_in(audit.hook_findings(audit.settings_hooks(df)))} == {"duplicate-hook", "no-timeout", "slow-hook", "broad-matcher"}
    allowed = audit.settings_permissions(df)
    assert found_in(audit.permission_findings(allowed)) == {
        ("bypass-mode", "bypassPermissions"), ("wildcard-allow", "Bash( * )"), ("dangerous-shell", "Bash(sudo x"), ("dangerous-shell", "Bash(chmod 755 /)"), ("network-allow", "Bash(wget *)"), ("never-matches", "Bash(sudo x"),
        ("scope-conflict", "Read(/b/id_rsa)"), ("sensitive-not-denied", ".env"),
    }
    assert found_in(audit.server_findings(audit.servers(df))) == {("untrusted-command", "a"), ("env-secret-names", "a"), ("misconfigured", "b")}
    assert {(r["plugin"], r["enabled"]) for r in audit.settings_plugins(df).collect()} == {("p", True), ("q", False)}


def test_frontmatter_and_entries(spark):
    bodies = ["---\nname: a\ndescription: 'Generate it'\ntools: [Read, \"Bash\"]\nname: b\n---\nname: no", "---\nname: open", "name: none", "---\r\nname : c\r\ndescription:\r\n---", None]
    df = spark.createDataFrame([(1, "user", f"f{i}", b) for i, b in enumerate(bodies)], "project_id int, scope string, path string, body string")
    got = {r["path"]: (r["valid"], r["name"], r["description"], r["tools"]) for r in audit.entries(df).collect()}
    assert got == {"f0": (True, "b", "Generate it", ["Read", "Bash"]), "f1": (False, "open", "", []), "f2": (False, "", "", []), "f3": (False, "c", "", []), "f4": (False, "", "", [])}
    commands = spark.createDataFrame([(1, "x")], "project_id int, name string").limit(0)
    assert ("missing-validation", "f0") in found_in(audit.skill_findings(audit.entries(df), commands))
    lines = audit.instructions(df.withColumn("body", F.lit("---\na: b\n---\n\n  First line \nsecond"))).first()
    assert lines["first_line"] == "First line" and lines["lines"] == 6


def test_configuration_flags(spark):
    df = spark.createDataFrame([(1, "full-local", 400, ["*x", "ab", "/long/path", " "], "0.0.0.0", True, "local-model"), (2, "redacted-content", 30, [], "::1", True, "none")], "project_id int, mode string, retention_days int, excluded array<string>, host string, analysis boolean, provider string")
    assert [tuple(r) for r in audit.configuration(df).orderBy("project_id").collect()] == [(1, True, 400, 2, 4, True, True), (2, False, 30, 0, 0, False, False)]


def test_export(spark, tmp_path):
    got = report.export({"a": spark.range(3), "b": spark.range(1)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "a")).count() == 3
    assert {r["table"]: r["rows"] for r in got.collect()} == {"a": 3, "b": 1}


def test_ratios_and_scores_are_rounded_as_in_sql(spark):
    """323 / 80 is 4.0375 in digits, yet SQL's round takes the double times 1000, which lies just below the half."""
    found = spark.createDataFrame([(1, "s", 0, *(323.0 for _ in baselines.DIMENSIONS))], "project_id int, session_id string, started_at long, " + ", ".join(f"{d} double" for d in baselines.DIMENSIONS))
    base = spark.createDataFrame([("personal", None, "prompts", 80.0, 80.0), ("recent", None, "prompts", 0.0, 0.0)], "scope string, scope_key int, dimension string, median double, mad double")
    got = {r["scope"]: (r["ratio"], r["score"]) for r in baselines.compare(found, base).collect()}
    assert got == {"personal": (4.037, 3.038), "recent": (float("inf"), 1.0)}


def test_costs_are_summed_before_they_meet_prices(spark):
    """Requests are not dealt by their model, of which there are few; sums give what single costs do."""
    rows = [(f"{m}{i % 2 or ''}", i * 7, None if i % 3 else i, i, None, [None, 0.25, float("nan")][i % 3 if m == "north" else 0]) for m in ("north", "north-large", "unheard", "delta-mid") for i in range(30)]
    requests = spark.createDataFrame([*rows, (None, 1, 1, 1, 1, 0.5)], "model_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reported_usd double")
    prices = costs.price_list(spark)
    for asked in (requests, requests.drop("reported_usd")):
        got = costs.cost_by_model(asked, prices)
        single = costs.with_cost(asked, prices).groupBy("model_id").agg(F.count(F.lit(1)), F.count("cost_micro"), (F.sum("cost_micro") / 1_000_000).cast("decimal(30,6)"), F.min(F.when(F.col("cost_provenance") == "reported", "0reported").when(F.col("cost_provenance") == "registry", "1registry").otherwise("2unknown")))
        assert {tuple(r) for r in got.collect()} == {(*r[:4], r[4][1:]) for r in single.collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in costs.cost_by_model(requests, prices)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_settings_are_parsed_once_for_each_family(spark):
    """Not again for a filter on what was found, nor for each effect; what is no array, no text or blank gives no rule."""
    body = '{"permissions":{"allow":[" a ",7,""],"deny":{"x":1},"ask":["b"],"defaultMode":"m"},"hooks":{"E":[{"hooks":[{"command":"c"}]}]}}'
    settings = spark.createDataFrame([(1, "user", "p", body), (2, "user", "p", "{"), (3, "user", "p", '{"permissions":3}')], "project_id long, scope string, path string, body string")
    for found in (audit.settings_permissions(settings), audit.settings_hooks(settings), audit.settings_plugins(settings)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson(body") == 1
    assert sorted((r["project_id"], r["effect"], r["rule"]) for r in audit.settings_permissions(settings).collect()) == [(1, "allow", "a"), (1, "ask", "b"), (1, "mode", "m")]
    assert [(r["event"], r["matcher"], r["command"]) for r in audit.settings_hooks(settings).collect()] == [("E", "*", "c")]


def test_frontmatter_pairs_are_made_once(spark):
    """Pairs are a column before the search for a key's last one, which made them anew for each."""
    docs = spark.createDataFrame([("---\na: 1\nb: 'x'\na: 2\n---\nc: 3",), ("---\na: 1",), (None,)], "body string").coalesce(1)
    found = audit.frontmatter(docs)
    assert [(r["valid"], r["fields"]) for r in found.collect()] == [(True, {"b": "x", "a": "2"}), (False, {"a": "1"}), (False, {})]
    assert found.select("fields")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_sessions_are_summed_in_one_shuffle(spark):
    random.seed(7)
    kinds = {"signup": "prompt", "view": "read", "click": "edit", "purchase": "verify", "error": "verify"}
    rows = [(f"s{random.randrange(6)}", t // 2, t, kinds[e], e, e != "error", random.choice(["a", "b", "c", None])) for t in range(200) for e in [random.choice(list(kinds))]] + [("alone", 5, 900, "prompt", "signup", True, None)]
    rows = [(s, 1 if s == "alone" else int(s[1]) % 3, *rest) for s, *rest in rows]
    df = spark.createDataFrame(rows, "session_id string, project_id int, ts long, event_id long, kind string, event_type string, success boolean, path_hash string").repartition(5)
    out = metrics.session_workflow(df)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Expand" not in plan
    got = {r["session_id"]: r for r in out.collect()}
    assert len(got) == len({r[0] for r in rows})
    for s, r in got.items():
        own = sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[3]))
        edits, checks = [x for x in own if x[4] == "edit"], [x for x in own if x[4] == "verify"]
        last, failure = max((x[2] for x in edits), default=None), min((x[2] for x in checks if not x[6]), default=None)
        assert (r["started_at"], r["ended_at"], r["last_event"]) == (own[0][2], own[-1][2], own[-1][5])
        assert (r["written"], r["writes"], r["last_write"]) == (len({x[7] for x in edits} - {None}), len(edits), last)
        assert (r["verifications"], r["verify_kinds"], r["last_success"]) == (len(checks), len({x[5] for x in checks}), checks[-1][6] if checks else None)
        assert r["next_verify"] == min((x[2] for x in checks if last is not None and x[2] > last), default=None)
        assert r["corrective_prompts"] == sum(x[4] == "prompt" and failure is not None and x[2] > failure for x in own)
        assert (r["prompts"], r["tool_calls"], r["compactions"]) == (sum(x[4] == "prompt" for x in own), sum(x[4] != "prompt" for x in own), sum(x[5] == "error" for x in own))


def test_requests_are_read_once_for_a_snapshot(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = [(1, "north-large", 100, None), (1, "north-large-2", 50, 7), (1, "north-large", 1, 2), (2, "z", 5, 5), (None, "z", 9, 9)]
    schema = "project_id int, model_id string, input_tokens long, cache_read_tokens long"
    got = {r["project_id"]: tuple(r)[1:] for r in snapshot.models(spark, spark.createDataFrame(rows, schema).mapInPandas(counted, schema)).where("project_id is not null").select("project_id", "requests", "dominant_cost_tier", "dominant_capability", "input_tokens", "cache_read_tokens").collect()}
    assert got == {1: (3, 5, 5, 151, 9), 2: (1, 0, 0, 5, 5)} and seen.value == len(rows)


def test_commands_are_counted_before_they_are_classified(spark):
    rows = [(1, "npm test", True)] * 3 + [(1, "NPM  test", False)] * 2 + [(1, "npm run build", True), (2, "pytest test --all", False), (2, "ls", True)]
    df = spark.createDataFrame(rows, "project_id int, command string, success boolean")
    got = {r["project_id"]: (r["tests"], r["builds"], r["broad_tests"], r["repeated_command_top"], r["repeated_failed_top"]) for r in snapshot.commands(df).collect()}
    assert got == {1: (5, 1, 0, 5, 2), 2: (1, 0, 1, 1, 1)}


def test_things_of_all_kinds_are_counted_in_one_pass(spark):
    rows = [(1, "read", "a", True, 5)] * 3 + [(1, "read", "b", False, 9)] * 2 + [(1, "prompt", "a", True, 1)] * 4 + [(2, "verify", None, False, 2)] * 2
    got = {r["project_id"]: r.asDict() for r in snapshot.tools(spark.createDataFrame(rows, "project_id int, kind string, path_hash string, success boolean, size long")).collect()}
    one, two = got[1], got[2]
    assert (one["max_output"], one["failure_rate"], one["worst_tool_failures"], one["worst_tool_rate"]) == (9, 0.222222, 2, 0.4)
    assert (one["repeated_read_top"], one["sum_repeated_reads"], one["repeated_search_top"], one["sum_repeated_searches"]) == (3, 3, 4, 4)
    assert (two["worst_tool_failures"], two["worst_tool_rate"], two["repeated_read_top"]) == (2, 1.0, None)
