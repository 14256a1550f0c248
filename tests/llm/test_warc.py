"""Archives: round trip, revisits, and the order of the merged index."""

import gzip
import hashlib
import random

import duckdb
import pytest

from tracemill.llm import warc


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted(rnd.randrange(30) for _ in range(rnd.randrange(9))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs], key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("https://User@WWW.Example.com:443/A/b?q=1#top") == "com,example)/a/b?q=1"
    assert warc.url_key("http://m.a.org:8080") == "org,a,m:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\né " + "x" * 100
    rows = [(3, "http://b.com/", tricky), (1, "http://a.com/x", tricky), (2, "http://a.com/x", "tiny"), (9, None, "tiny"), (4, "http://a.com/\r\ny", None), (7, "u", "long " * 200_000), (None, "http://a.com/", tricky), (1, "http://a.com/x", tricky)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, run string")
    path = str(tmp_path / "archives")
    out = warc.archive_and_index(df, path).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted(((i, len((t or "").encode()), sha(t), *(("revisit", 1) if t == tricky and i != 1 else ("response", None))) for i, _, t in rows), key=str)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str) == want
    order = [(r["url_key"], r["captured_at"], r["page_id"] or -1) for r in sorted(out, key=lambda r: (r["range_no"], r["place"]))]
    assert order == sorted(order)
    texts = {t or "" for _, _, t in rows}
    for p in (tmp_path / "archives").glob("part-*"):
        raw = gzip.decompress(p.read_bytes())
        for fields, block, at, n in warc.read_records(p.read_bytes()):
            assert raw[at : at + n].startswith(b"WARC/1.1\r\n") and raw[at + n : at + n + 4] == b"\r\n\r\n"
            if fields["warc-type"] == "response":
                assert block.partition(b"\r\n\r\n")[2].decode() in texts
    assert warc.archive_and_index(df.limit(0)).count() == 0


def test_ranges_follow_each_other(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = warc.fresh_path(spark, "t")
    warc.write_archives(pages, path)
    runs = warc.capture_runs(spark, path)
    out = warc.merged_index(runs, range_entries=7).collect()
    assert len(out) == pages.count() and len({r["range_no"] for r in out}) > 3
    order = [(r["url_key"], r["captured_at"], r["page_id"]) for r in sorted(out, key=lambda r: (r["range_no"], r["place"]))]
    assert order == sorted(order)


def test_query_against_sql(spark, sf):
    got = set(map(tuple, warc.op9_warc(spark, sf).collect()))
    duckdb.execute(f"create or replace view pages as select * from '{sf}/pages.parquet'")
    assert got == set(duckdb.execute(warc.SQL).fetchall())
