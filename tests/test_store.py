"""The scan job reads what changed and rewrites the buckets it has to; the store behind it."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracemill.sources import load
from tracemill.sources import transcripts as tr
from tracemill.sources.store import Store, bucket


def said(*texts):
    return "\n".join(json.dumps({"type": "user", "timestamp": f"2024-03-01T10:00:{i:02d}Z", "message": {"content": t}}) for i, t in enumerate(texts))


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "projects" / "-home-u-p"
    folder.mkdir(parents=True)
    for name, texts in {"a": ["one"], "b": ["x", "y"], "odd [name] 100% {é}": ["z"], "d": ["w" * 70_000, "", "v"]}.items():
        (folder / f"{name}.jsonl").write_text(said(*texts) + "\n\n")
    return str(tmp_path / "projects"), str(tmp_path / "store"), folder


def watched(monkeypatch):
    """Files that text is read of and files that are opened for their head, by name, of each scan."""
    read, opened = [], []
    lines, heads = tr.read_lines, tr.head_hashes
    monkeypatch.setattr(tr, "read_lines", lambda s, root, *a, **k: read.append(sorted(p.rsplit("/", 1)[1] for p in root)) or lines(s, root, *a, **k))
    monkeypatch.setattr(tr, "head_hashes", lambda files, *a: opened.append(sorted(r["session_id"] for r in files.collect())) or heads(files, *a))
    return read, opened


def test_a_scan_reads_what_changed_alone(spark, corpus, monkeypatch):
    root, store, folder = corpus
    read, opened = watched(monkeypatch)
    names = ["a", "b", "d", "odd [name] 100% {é}"]
    run = lambda **k: {r["session_id"]: r["reason"] for r in load.scan(spark, root, store, **k).collect()}
    assert run() == dict.fromkeys(names, "first import")
    assert opened == [names] and len(read[0]) == 4
    assert sorted(r["session_id"] for r in load.read(spark, store)["sessions"].collect()) == names
    before = load.open_store(spark, store)
    assert run() == dict.fromkeys(names, "unchanged")
    assert opened[1] == [] and len(read) == 1 and load.open_store(spark, store).versions == before.versions  # nothing opened, read or written
    with (folder / "d.jsonl").open("a") as f:
        f.write(said("more") + "\n")
    assert run()["d"] == "grew" and opened[2] == ["d"] and read[1] == ["d.jsonl"]
    after = load.open_store(spark, store)
    own = after.touched(spark.createDataFrame([("d",)], "session_id string"))
    assert {b for b, v in after.held["prompts"].items() if v == after.versions[-1]} == set(own)
    kept = {f for f in before.files()["prompts"] if f"bucket={own[0]}/" not in f}
    assert kept and kept < set(after.files()["prompts"])
    assert run(force=True) == dict.fromkeys(names, "forced")


def test_heads_are_of_raw_bytes(spark, corpus):
    root, store, folder = corpus
    (folder / "bom.jsonl").write_bytes(b"\xef\xbb\xbf{}\r\n\xff\n")
    (folder / "empty.jsonl").write_bytes(b"")
    got = {r["session_id"]: r["head_hash"] for r in load.decide(spark, root, store).collect()}
    assert got == {p.stem: hashlib.sha256(p.read_bytes()[:65536]).hexdigest() for p in folder.iterdir() if p.stat().st_size}  # Spark lists no empty files


def test_files_that_are_gone_or_replaced(spark, corpus):
    root, store, folder = corpus
    load.scan(spark, root, store)
    head = "w" * 70_000
    (folder / "d.jsonl").write_text(said("q" + head, "longer", "than", "before"))
    (folder / "b.jsonl").write_text(said("x"))
    decided = {r["session_id"]: (r["reason"], r["action"]) for r in load.scan(spark, root, store).collect()}
    assert decided["d"] == ("head changed", "delete and import") and decided["b"] == ("shrank", "delete and import")
    assert {r["session_id"]: r["prompts"] for r in load.read(spark, store)["sessions"].collect()} == {"a": 1, "b": 1, "d": 4, "odd [name] 100% {é}": 1}
    lost = spark.createDataFrame([("file:///nowhere/at/all.jsonl",)], "uri string")
    assert tr.head_hashes(lost).first()["head_hash"] is None


def test_extra_folders_ranges_and_retention(spark, corpus, tmp_path):
    root, store, folder = corpus
    more = tmp_path / "more" / "projects" / "p"
    more.mkdir(parents=True)
    (more / "e.jsonl").write_text(said("first", "second"))
    at = 1_709_287_200_000  # the first record of each file
    found = load.scan(spark, root, store, extra=[str(tmp_path / "more")], since_ms=at + 1000, until_ms=at + 1000)
    assert sorted(r["session_id"] for r in found.collect() if r["action"] == "import")[-2:] == ["e", "odd [name] 100% {é}"]
    assert sorted((r["session_id"], r["content"]) for r in load.read(spark, store)["prompts"].collect()) == [("b", "y"), ("d", ""), ("e", "second")]
    load.scan(spark, root, str(tmp_path / "other"), now_ms=at + 86_400_000 * 2 + 500, retention_days=2)
    left = load.read(spark, str(tmp_path / "other"))
    assert {r["session_id"] for r in left["sessions"].collect()} == {"b", "d"} and left["scan_state"].count() == 4
    again = load.scan(spark, root, str(tmp_path / "other"), now_ms=at + 86_400_000 * 9, retention_days=2)
    assert {r["reason"] for r in again.collect()} == {"unchanged"} and again.first()["pruned"] == 2 and load.read(spark, str(tmp_path / "other"))["sessions"].count() == 0


def test_purges_touch_their_buckets_alone(spark, corpus):
    root, store, _ = corpus
    load.scan(spark, root, store)
    before = load.open_store(spark, store)
    gone = {r["table"]: r["gone"] for r in load.purge(spark, store, spark.createDataFrame([("b",)], "session_id string")).collect()}
    assert gone["prompts"] == 2 and gone["sessions"] == 1 and "scan_state" not in gone
    after = load.open_store(spark, store)
    assert after.held["scan_state"] == before.held["scan_state"] and sum(v == after.versions[-1] for v in after.held["prompts"].values()) <= 1
    assert load.read(spark, store)["prompts"].where("session_id = 'b'").isEmpty() and load.read(spark, store)["prompts"].count() == 5
    old = set(before.files()["prompts"])
    assert after.vacuum() > 0 and load.read(spark, store)["prompts"].count() == 5 and set(after.files()["prompts"]) <= old
    load.purge(spark, store)
    assert all(load.read(spark, store)[t].isEmpty() for t in load.TABLES)


def test_sessions_end_where_their_file_ends(spark, tmp_path):
    """Expected values from the studied behaviour: records at 10:00 and then at 09:00 last minus an hour."""
    p = tmp_path / "projects" / "x" / "s.jsonl"
    p.parent.mkdir(parents=True)
    p.write_text("\n".join(json.dumps({"type": "user", "timestamp": f"2024-03-01T{h:02d}:00:00Z", "message": {"content": "x"}}) for h in (10, 9)))
    s = tr.sessions(tr.parse(tr.read_lines(spark, str(tmp_path / "projects")))).first()
    assert s["duration_ms"] == -3_600_000 and s["started_at"] == 1_709_287_200_000


def test_broken_commits_count_for_nothing(spark, tmp_path):
    path, keys = str(tmp_path / "s"), {"t": "k"}
    rows = lambda *ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "k string, v int")
    Store(spark, path, keys, 4).commit({"t": rows("a", "b", "c", None)})
    rows("z").withColumn("bucket", bucket(F.col("k"), 4)).write.partitionBy("bucket").parquet(f"{path}/t/v=2")  # written, never named by a manifest
    assert sorted(str(r["k"]) for r in Store(spark, path, keys).read("t").collect()) == ["None", "a", "b", "c"]
    held = Store(spark, path, keys)
    held.commit({"t": rows("a", "a")}, held.touched(spark.createDataFrame([("a",)], "k string"), "k"))
    assert held.buckets == 4 and {"a", "z"} & {r["k"] for r in Store(spark, path, keys).read("t").collect()} == {"a"}


def test_chosen_files_are_read_as_spark_reads_them_and_not_listed_again(spark, corpus):
    root, _, folder = corpus
    (folder / "bom.jsonl").write_bytes(b"\xef\xbb\xbf{}\r\n\n  \n" + "é".encode() * 700_000 + b"\nlast")
    files = tr.discover(spark, root)
    assert files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    names = ["uri", "session_id", "line_no", "value"]
    got = tr.read_lines(spark, tr.Chosen(files.select("uri", "size")))
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, tr.read_lines(spark, root).select(names).collect()))
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString().replace("FileScan binaryFile", "")
    raw = (folder / "bom.jsonl").read_bytes()
    assert [raw[r["offset"] :].lstrip(b"\xef\xbb\xbf").startswith(r["value"].encode()) for r in got.where("session_id = 'bom'").collect()] == [True] * 3


def test_transcripts_are_files_of_one_folder_for_each_project(spark, sf, tmp_path):
    from tracemill.plans import load_queries

    turns, root = load_queries.conversations(spark, sf), str(tmp_path)
    for _ in range(2):  # again: files are replaced
        load_queries.write_transcripts(turns, root)
    assert {p.name for p in (tmp_path / "projects").iterdir()} == {f"-home-u-p{i}" for i in range(5)}
    assert {int(p.stem) for p in (tmp_path / "projects").glob("*/*") if p.name[0] != "."} == {r[0] for r in turns.select("conv_id").distinct().collect()}
    assert not list((tmp_path / "projects").glob("*/.[!.]*[!c]"))  # no unfinished file is left
    lines = load_queries.transcript_lines(turns)
    assert sorted(r[0] for r in tr.read_lines(spark, root).select("value").collect()) == sorted(r[0] for r in lines.select("value").collect())
