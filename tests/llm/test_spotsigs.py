"""Spot signatures, and each document's next one, against plain loops."""

import hashlib

import pytest

from tracemill.llm import spotsigs as ss


def slow_signatures(text):
    words, out = ss.TOKEN.findall(text.lower()), set()
    for i, w in enumerate(words):
        if w in ss.ANCHORS:
            after = [x for x in words[i + 1 :] if x not in ss.ANCHORS][:2]
            if after:
                out.add((w, *after))
    return out


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (slow_signatures(x) for x in (t, edited, nxt))
        near = [len(a & x) / len(a | x) if a and x else None for x in (b, c)]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *near)
    return out


@pytest.mark.parametrize("range_bytes", [1 << 14, 1 << 30])
def test_query_against_brute_force(spark, sf, range_bytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = ss.edited_fingerprints(docs, range_bytes=range_bytes).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(rows) == len(want)
    of = {r["doc_id"]: r["fingerprint"] for r in rows}
    for r in rows:
        n, sha, near_edited, near_next = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert near_edited is None or r["near_edited"] == pytest.approx(near_edited)
        assert near_next is None or r["near_next"] == pytest.approx(near_next)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, of[i]) == of[i]


def test_odd_rows(spark):
    long = "the " + "word of many things " * 20_000
    rows = [(3, "the red house"), (2, None), (2, ""), (9, long), (9, long), (None, "x y z"), (-4, "…"), (5, "the red house")]
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, bucket string, th int")
    out = ss.edited_fingerprints(df, range_bytes=64).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
    by = {r["doc_id"]: r for r in out}
    assert by[3]["fingerprint"] == by[5]["fingerprint"] and by[5]["near_next"] == 1.0
    assert by[None]["edited_sha256"] == hashlib.sha256(("x y" + " z"[:0] + "the"[:0] + long[:2]).encode()).hexdigest()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert ss.edited_fingerprints(df.limit(0)).count() == 0
    one = ss.edited_fingerprints(df.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_pruning_never_hides_a_like_pair():
    for n in range(1, 60):
        for m in range(n, 80):
            a, b = frozenset(range(m)), frozenset(range(n))
            exact = ss.likeness(a, b)
            assert ss.likeness(a, b, 0.8) == (exact if exact >= 0.8 else 0.0)
    assert ss.likeness(frozenset(), frozenset()) == 1.0
