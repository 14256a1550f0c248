"""Transcript scenarios: deduplicated requests, paired tools, bad lines, interrupted sessions."""

import json

from tracemill.sources import adapters, load
from tracemill.sources import transcripts as tr

T = "2024-03-01T10:00:%02dZ"


def line(kind, second, message=None, **more):
    return json.dumps({"type": kind, "timestamp": None if second is None else T % second, "message": message, **more})


def write(tmp_path, files):
    for name, lines in files.items():
        p = tmp_path / "projects" / "x" / f"{name}.jsonl"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join(lines))
    return str(tmp_path / "projects")


def test_scenarios(spark, tmp_path):
    use = lambda i, name, **k: {"type": "tool_use", "id": i, "name": name, "input": k}
    result = lambda i, text, err=False: {"type": "tool_result", "tool_use_id": i, "content": text, "is_error": err}
    usage = lambda a, b: {"input_tokens": a, "output_tokens": b}
    root = write(tmp_path, {
        "full": [
            line("summary", 0), line("user", 1, {"content": "fix it"}, cwd="/repo"),
            line("assistant", 2, {"id": "m1", "model": "north-large", "usage": usage(5, 1), "content": [use("t1", "Read", file_path="/repo/a")]}),
            line("assistant", None, {"id": "m1", "usage": usage(5, 9), "content": [{"type": "text", "text": "x"}]}),
            line("user", 4, {"content": [result("t1", "héllo")]}),
            line("assistant", 5, {"id": "m2", "usage": usage(7, 2), "content": [use("t2", "Bash", command="npm test"), use("t3", "Edit", file_path="/repo/b"), use("t3", "Edit", file_path="/repo/c")]}),
            line("user", 6, {"content": [result("t2", "boom", True), result("zz", "lost")]}), line("user", 7, {"content": [result("t3", "ok")]}),
            "{bad", "[1]", line("other", 8), line("system", 8, subtype="compact_boundary"), '{"type": "user", "timestamp": "soon", "message": {"content": "dropped"}}', "",
            line("user", 9, {"content": [{"type": "text", "text": " next "}, {"type": "text", "text": "task"}]}), line("assistant", 10, {"id": "m3", "stop_reason": "end_turn", "content": []}),
        ],
        "cut": [line("user", 1, {"content": ""}), line("assistant", 3, {"model": "delta-mid", "content": [use("t1", "Grep")]}, isSidechain=True)],
        "only": [line("summary", 5)],
    })
    parsed = tr.parse(tr.read_lines(spark, root))
    placed = tr.place(parsed)
    assert {(r["session_id"], r["line_no"], r["level"]) for r in tr.diagnostics(parsed).collect()} == {("full", 7, "warn"), ("full", 9, "error"), ("full", 10, "warn"), ("full", 11, "info"), ("full", 13, "warn")}
    said = sorted((r["session_id"], r["sequence"], r["content"]) for r in tr.prompts(placed).collect())
    assert said == [("cut", 1, ""), ("full", 1, "fix it"), ("full", 2, "next \ntask")]
    requests = {(r["session_id"], r["message_id"]): r for r in tr.model_requests(placed).collect()}
    assert set(requests) == {("full", "m1"), ("full", "m2"), ("full", "m3"), ("cut", "noid-2")}
    assert requests["full", "m1"]["output_tokens"] == 9 and requests["full", "m2"]["model_id"] == "north-large"
    calls = sorted((r["session_id"], r["call_id"], r["state"], r["success"], r["operation"], r["path"], r["output_bytes"], r["duration_ms"]) for r in tr.tool_calls(placed).where("state <> 'orphan'").collect())
    assert calls[0] == ("cut", "t1", "partial", False, "search", None, None, None)
    assert ("full", "t1", "matched", True, "read", "/repo/a", 6, 2000) in calls
    assert {(c[1], c[2], c[3]) for c in calls if c[0] == "full"} == {("t1", "matched", True), ("t2", "matched", False), ("t3", "overwritten", False), ("t3", "matched", True)}
    assert [r["call_id"] for r in tr.tool_calls(placed).where("state = 'orphan'").collect()] == ["zz"]
    s = {r["session_id"]: r for r in tr.sessions(parsed).collect()}
    assert {k: r["completion"] for k, r in s.items()} == {"full": "completed", "cut": "interrupted", "only": "unknown"}
    assert s["full"]["duration_ms"] == 10_000 and s["full"]["cwd"] == "/repo" and s["full"]["compactions"] == 1
    assert {k: r["completeness"] for k, r in s.items()} == {"full": ["complete"], "cut": ["tail-missing", "metrics-missing"], "only": ["tail-missing", "prompts-missing"]}
    assert s["cut"]["entry_point"] == "unknown" and s["cut"]["subagent_calls"] == 1 and s["full"]["prompts"] == 2
    call = {r["call_id"]: r for r in tr.tool_calls(placed).where("session_id = 'full' and state = 'matched'").collect()}
    assert call["t2"]["failure_signature"] == "boom" and call["t2"]["failure_type"] == "error" and call["t1"]["prompt_id"] == "full:p:1"
    ran = tr.command_runs(tr.tool_calls(placed)).first()
    assert (ran["classification"], ran["success"], ran["commit_id"]) == ("test", False, None)
    assert [r["kind"] for r in tr.verification_runs(tr.command_runs(tr.tool_calls(placed))).collect()] == ["unit-test"]
    assert {(r["operation"], r["path"]) for r in tr.file_activity(tr.tool_calls(placed), "/home", "/repo").collect()} == {("read", "[REPO]/a"), ("edit", "[REPO]/b"), ("edit", "[REPO]/c")}


def test_import_decisions_and_idempotent_load(spark):
    files = spark.createDataFrame([("a", 5, 1, "h"), ("b", 5, 1, "h"), ("c", 4, 2, "h"), ("d", 9, 2, "x"), ("e", 9, 2, "h")], "uri string, size long, mtime long, head_hash string")
    state = spark.createDataFrame([("b", 5, 1, "h", 1), ("c", 5, 1, "h", 1), ("d", 5, 1, "h", 1), ("e", 5, 1, "h", 1)], "uri string, size long, mtime long, head_hash string, import_version int")
    assert {r["uri"]: r["action"] for r in tr.import_decisions(files, state).collect()} == {"a": "import", "b": "skip", "c": "delete and import", "d": "delete and import", "e": "append"}
    once = tr.load(files.limit(2), files, ["uri"])
    assert tr.load(once, files, ["uri"]).count() == once.count() == 5


def test_lines_of_files_that_spark_splits(spark, tmp_path):
    lines = [f'{{"type": "user", "n": {i}, "pad": "{"é" * (i % 90)}"}}' + ("\r" if i % 7 == 0 else "") for i in range(3000)]
    root = write(tmp_path, {"big": [*lines[:10], "", "  ", *lines[10:]]})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = tr.read_lines(spark, root).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in got] == lines and got[10]["line_no"] == 13
    raw = (tmp_path / "projects" / "x" / "big.jsonl").read_bytes()
    assert all(raw[r["offset"] :].startswith(r["value"].encode()) for r in got)


def test_scan_loads_what_changed(spark, tmp_path):
    said = lambda *texts: [line("user", i, {"content": t}) for i, t in enumerate(texts)]
    root, store = write(tmp_path, {"a": said("one"), "b": said("x", "y")}), str(tmp_path / "store")
    (tmp_path / "projects" / "-home-secret").mkdir()
    (tmp_path / "projects" / "-home-secret" / "c.jsonl").write_text("\n".join(said("hidden")))
    run = lambda **k: {r["session_id"]: (r["reason"], r["action"]) for r in load.scan(spark, root, store, excluded=["/home/secret"], **k).collect()}
    prompts = lambda: sorted((r["session_id"], r["content"]) for r in load.read(spark, store)["prompts"].collect())
    assert run() == {"a": ("first import", "import"), "b": ("first import", "import")}
    assert run() == {"a": ("unchanged", "skip"), "b": ("unchanged", "skip")} and prompts() == [("a", "one"), ("b", "x"), ("b", "y")]
    write(tmp_path, {"a": said("one", "two"), "b": said("z")})
    assert run() == {"a": ("head changed", "delete and import"), "b": ("shrank", "delete and import")}  # the head is all of so small a file
    assert prompts() == [("a", "one"), ("a", "two"), ("b", "z")]
    assert {r["session_id"]: r["prompts"] for r in load.read(spark, store)["sessions"].collect()} == {"a": 2, "b": 1}
    assert run(force=True)["a"] == ("forced", "delete and import") and len(prompts()) == 3
    assert run(force=True, mode="metadata-only")["a"][0] == "forced" and {c for _, c in prompts()} == {None}
    run(force=True, now_ms=10**13, retention_days=1)
    assert load.read(spark, store)["sessions"].count() == 0 and prompts() == []


def test_adapters_and_ranges(spark, tmp_path):
    root = write(tmp_path, {"a": [line("user", 1, {"content": "x"}), "{bad", line("user", 5, {"content": "y"})]})
    source = adapters.Transcripts()
    assert [r["session_id"] for r in source.discover(spark, root).collect()] == ["a"] and source.validate(spark, root).count() == 1
    done = adapters.scan_all(spark, [(source, root)], str(tmp_path / "stores"))
    assert [(r["source_id"], r["diagnostics"]) for r in done.collect()] == [("transcripts", 1)]
    said = tr.prompts(tr.place(tr.parse(tr.read_lines(spark, root))))
    first, last = sorted(r["ts"] for r in said.collect())
    assert [tr.within(said, *ends).count() for ends in ((first, last), (first + 1, None), (None, last - 1), (first + 1, last - 1))] == [2, 1, 1, 0]
