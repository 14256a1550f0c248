"""Hook events: parsing, modes, and two batches."""

import hashlib
import json

import pytest

from tracemill.streaming import analysis, correlating, hooks


def stored(spark, raw, mode="redacted-content"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, body string")
    return [r for r in hooks.redact(hooks.parse(df), mode).orderBy("id").collect()]


def test_envelopes_of_any_kind(spark):
    full = {"hook_event_name": "PreToolUse", "session_id": "s", "cwd": "/home/u/a/../b", "tool_name": "Bash", "tool_input": {"z": 1, "command": "curl -H 'Authorization: Bearer " + "a" * 20 + "'"}, "new": [1, None]}
    rows = stored(spark, [json.dumps(full), json.dumps({"hook_event_name": "Later", "session_id": 7}), "{broken password=abcdef", "[1]", "null", json.dumps({"session_id": "x"}), None, "é" * 5000])
    assert [(r["hook_event_name"], r["known"]) for r in rows] == [("PreToolUse", True), ("Later", False), *[("unknown", False)] * 6]
    assert [r["diagnostic"] for r in rows] == [None, 'unknown hook event "Later"', "hook payload is not valid JSON", "hook payload is not a JSON object", "hook payload is not a JSON object", "missing hook_event_name", "hook payload is not valid JSON", "hook payload is not valid JSON"]
    assert rows[0]["cwd_path"] == "[HOME]/b" and rows[1]["source_session_id"] is None
    kept = json.loads(rows[0]["payload_json"])
    assert "Bearer" not in rows[0]["payload_json"] and list(kept) == sorted(kept) and kept["tool_input"]["z"] == 1
    assert "[REDACTED:password]" in rows[2]["payload_json"] and len(json.loads(rows[7]["payload_json"])["_malformed"]) == 4096


def test_order_of_keys_and_time_of_receipt_do_not_count(spark):
    a, b = stored(spark, ['{"a": 1, "b": {"d": 2, "c": [3]}}', '{"b":{"c":[3],"d":2},"a":1}'])
    assert a["payload_hash"] == b["payload_hash"] == hashlib.sha256(b'{"a":1,"b":{"c":[3],"d":2}}').hexdigest()


def test_metadata_mode_states_lengths(spark):
    (row,) = stored(spark, [json.dumps({"prompt": "hé llo", "tool_input": {"x": 1}, "message": None, "other": "kept"})], "metadata-only")
    assert json.loads(row["payload_json"]) == {"message": "[metadata-only]", "other": "kept", "prompt": "[metadata-only: 6 chars]", "tool_input": "[metadata-only]"}


def test_spool_skips_what_is_no_envelope(spark, tmp_path):
    lines = ['{"v":1,"receivedAt":"b","payload":{"x":1}}', '{"v":2,"payload":{}}', '{"v":1}', "{", '{"v":1,"receivedAt":"a","payload":{"x":2}}']
    for i, x in enumerate(lines):
        (tmp_path / f"{i}.json").write_text(x)
    (tmp_path / ".5.json.tmp").write_text(lines[0])
    got = hooks.spooled(hooks.read_spool(spark, str(tmp_path)))
    assert sorted((r["received_at"], r["body"], r["delivery"]) for r in got.collect()) == [("a", '{"x":2}', "spool"), ("b", '{"x":1}', "spool")]
    assert hooks.backlog(spark, str(tmp_path), got).first()[0] == 3
    for _ in range(2):
        hooks.drain(spark, str(tmp_path), f"{tmp_path}/table", f"{tmp_path}/checkpoint")
        assert spark.read.parquet(f"{tmp_path}/table").count() == 2


def test_a_late_first_delivery_is_stored(spark, tmp_path):
    schema = "received_at timestamp, payload_hash string"
    for batch in ([("2026-01-01 10:00:00", "a"), ("2026-01-01 10:00:01", "a")], [("2026-01-01 12:00:00", "b")], [("2026-01-01 08:00:00", "late"), ("2026-01-01 07:00:00", "a")]):
        spark.createDataFrame(batch, "t string, payload_hash string").selectExpr("cast(t as timestamp) as received_at", "payload_hash").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        hooks.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    assert sorted(r["payload_hash"] for r in spark.read.parquet(f"{tmp_path}/table").collect()) == ["a", "b", "late"]


def test_a_batch_that_fails_is_tried_again(spark, tmp_path, monkeypatch):
    spool, table, log, dead, archive, checkpoint = (f"{tmp_path}/{n}" for n in ("spool", "table", "log", "dead", "archive", "checkpoint"))
    (tmp_path / "spool").mkdir()
    for i, line in enumerate(['{"v":1,"receivedAt":"b","payload":{"x":1}}', '{"v":1,"payload":{"x":1}}', "{ token=abcdefgh", '{"v":3,"payload":{}}', '{"v":1}']):
        (tmp_path / "spool" / f"{i}.json").write_text(line)
    drain = lambda: hooks.drain(spark, spool, table, checkpoint, log_path=log, dead_path=dead)
    whole = hooks.insert_new
    monkeypatch.setattr(hooks, "insert_new", lambda batch, path: (whole(batch, path), 1 / 0)[0])  # fails after the rows are in
    with pytest.raises(Exception, match="division"):
        drain()
    monkeypatch.setattr(hooks, "insert_new", whole)
    drain()
    assert spark.read.parquet(table).count() == 1
    counts = hooks.drained_counts(hooks.read_log(spark, log)).first()
    assert (counts["files"], counts["lines"], counts["events"], counts["broken"], counts["inserted"]) == (5, 5, 2, 3, 0)  # the first try had put them in
    letters = {r["wrong"]: r["line"] for r in spark.read.parquet(dead).collect()}
    assert set(letters) == {"not JSON", "another version", "no payload"} and "abcdefgh" not in letters["not JSON"]
    assert hooks.sweep(spark, hooks.read_log(spark, log), archive) == 5 and not list((tmp_path / "spool").glob("*.json")) and len(list((tmp_path / "archive").glob("*.json"))) == 5
    drain()
    assert spark.read.parquet(table).count() == 1


def test_bursts_are_waited_out(spark, tmp_path):
    """Two bursts of one project and one of another give a run each once it is quiet; what is still open is left."""
    rows = [(1, 0), (1, 900), (1, 2000), (2, 100), (1, 60_000), (1, 60_500), (3, 99_000)]
    events = spark.createDataFrame([(p, f"s{p}", i, t, "read", "view", True, "h", 5) for i, (p, t) in enumerate(rows)], "project_id long, session_id string, event_id long, ts long, kind string, event_type string, success boolean, path_hash string, size long")
    events.select("project_id", "ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("project_id long, ts long").parquet(f"{tmp_path}/in")
    analysis.observe(stream, lambda _: events, f"{tmp_path}/runs", f"{tmp_path}/checkpoint")
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/runs").collect()
    assert sorted((r["project_id"], r["first_ts"], r["events"], tuple(r["found"])) for r in found) == [(1, 0, 3, ("TOOLS-001",)), (1, 60_000, 2, ("TOOLS-001",)), (2, 100, 1, ())]


def test_events_before_with_and_after_their_session(spark, tmp_path):
    """Three runs: events come, then the sessions they are of, then more events; what was there is not read again."""
    hour = 3_600_000
    kinds = {"events": "event_id long, project_id long, source_session_id string, ts long", "sessions": "session_id string, project_id long, started_at long"}
    runs = [
        {"events": [(1, 7, "s1", hour), (2, 7, None, hour), (3, 8, None, hour), (4, None, "s9", hour)]},
        {"sessions": [("s1", 7, hour + 5), ("s0", 7, hour // 2)], "events": [(5, 7, None, hour + 1)]},
        {"events": [(6, 7, None, hour + hour // 2), (7, 7, "s1", 9 * hour), (8, 7, None, 9 * hour)], "sessions": [("s9", 9, 9 * hour)]},
    ]
    for name in kinds:
        (tmp_path / name).mkdir()
    for run in runs:
        for name, rows in run.items():
            spark.createDataFrame(rows, kinds[name]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        streams = [spark.readStream.schema(kinds[n]).parquet(f"{tmp_path}/{n}") for n in ("events", "sessions")]
        correlating.correlate(*streams, f"{tmp_path}/links", f"{tmp_path}/checkpoint")
    found = {r["event_id"]: (r["session_id"], r["confidence"]) for r in correlating.best(spark.read.parquet(f"{tmp_path}/links")).collect()}
    assert found == {1: ("s1", 1.0), 2: ("s0", 0.7), 4: ("s9", 1.0), 5: ("s0", 0.7), 6: ("s0", 0.7), 7: ("s1", 1.0)}


def test_an_event_among_many_sessions_has_one_link(spark, tmp_path):
    """Of many sessions within an hour only the first is linked, whatever stretch they lie in; an event without one is said to be left."""
    hour = 3_600_000
    events = spark.createDataFrame([(i, 7 if i else None, None, 100 * hour + i * hour // 4) for i in range(9)] + [(99, 7, None, 200 * hour), (100, 8, "far", 300 * hour)], "event_id long, project_id long, source_session_id string, ts long")
    sessions = [(f"s{i:03}", 7, 100 * hour + i * hour // 50) for i in range(100)] + [("far", 9, 300 * hour)]
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    spark.createDataFrame(sessions, "session_id string, project_id long, started_at long").coalesce(1).write.parquet(f"{tmp_path}/sessions")
    streams = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}") for n in ("events", "sessions")]
    correlating.correlate(*streams, f"{tmp_path}/links", f"{tmp_path}/checkpoint")
    events.where("event_id = 100").selectExpr("event_id + 1 as event_id", "project_id", "source_session_id", "ts").write.mode("append").parquet(f"{tmp_path}/events")  # the watermark holds from the next batch on
    correlating.correlate(*streams, f"{tmp_path}/links", f"{tmp_path}/checkpoint")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/links").select("event_id", "session_id").collect()]
    first = {i: min(s for s, _, t in sessions[:100] if abs(t - (100 * hour + i * hour // 4)) <= hour) for i in range(1, 9)}
    assert sorted((r for r in rows if r[1]), key=str) == sorted([*first.items(), (100, "far"), (101, "far")], key=str)
    assert {e for e, s in rows if s is None} == {0, 99}


def test_a_line_is_opened_once_and_what_came_is_not_stored(spark, tmp_path):
    """One parse of a line and none of its payload, before any filter; the raw body, with its secret, stays out of the table."""
    (tmp_path / "spool").mkdir()
    (tmp_path / "spool" / "a.json").write_text('{"v":1,"payload":{"hook_event_name":"Stop","prompt":"password=abcdefgh","n":1.50}}\n{"v":1,"payload":[1]}\n')
    plan = hooks.redact(hooks.parse(hooks.spooled(hooks.read_spool(spark, f"{tmp_path}/spool")), sent="sent"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(value") == 1 and "parseJson(body" not in plan
    hooks.drain(spark, f"{tmp_path}/spool", f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    table = spark.read.parquet(f"{tmp_path}/table")
    assert "body" not in table.columns and "abcdefgh" not in str(table.collect())
    spark.createDataFrame([('{"hook_event_name":"Stop","prompt":"password=abcdefgh","n":1.50}',)], "value string").coalesce(1).write.text(f"{tmp_path}/online")
    hooks.ingest(hooks.redact(hooks.parse(hooks.online(spark.readStream.text(f"{tmp_path}/online")))), f"{tmp_path}/table", f"{tmp_path}/other")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2


def test_lines_are_counted_in_one_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"v":1,"payload":{"x":1}}\n{"v":1,"payload":{"x":1}}\n{"v":1,"payload":null}\n{\n')
    out = hooks.counters(hooks.opened(hooks.read_spool(spark, str(tmp_path))), spark.range(1))
    assert tuple(out.first()) == (4, 1, 1, 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1


def test_a_large_batch_is_made_once_to_be_inserted(spark, tmp_path, monkeypatch):
    """A batch of many rows meets the whole table; one of few reads only the folders of its own hashes."""
    rows = lambda *ns: spark.createDataFrame([(f"{n:064x}",) for n in ns], "payload_hash string")
    far = lambda *ns: spark.createDataFrame([(f"{n:02x}" + "0" * 62,) for n in ns], "payload_hash string")
    table = f"{tmp_path}/table"
    assert hooks.insert_new(far(*range(20)), table) == 20
    assert hooks.stored(spark, table, far(3, 4)).count() == 2
    monkeypatch.setattr(hooks, "MANY", 5)
    assert hooks.stored(spark, table, far(*range(5))).count() == 20
    assert hooks.insert_new(far(*range(10, 30)), table) == 10 and hooks.insert_new(rows(1, 2, 1), table) == 2
