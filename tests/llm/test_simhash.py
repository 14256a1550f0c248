"""SimHash groups against fingerprints and links worked out one by one."""

import random

import pytest
import xxhash

from tracemill.llm import simhash
from tracemill.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Component of each index, by comparing all."""
    at = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(fps):
            for j, y in enumerate(fps):
                if bin(x ^ y).count("1") <= 2 and at[j] < at[i]:
                    at[i], changed = at[j], True
    return at


def test_fingerprints_equal_the_definition():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rnd.choice(["A", "bé", "Éc", "d x", "e\u0085", "\x1cf"]) + rnd.choice(["\n", "", "\t"]) for _ in range(n))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("limit", [1, 48])
def test_links_keep_what_is_reachable(spark, limit):
    rnd = random.Random(limit)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            x ^= 1 << rnd.randrange(64) if rnd.random() < 0.4 else (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), list_limit=limit)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    want, got = groups(fps), [found.get(x, x) for x in signed]
    assert len({*zip(want, got)}) == len(set(want)) == len(set(got))


def test_rows_nulls_copies_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "a b c d"), (3, "A b c d"), (9, None), (7, " "), (2, long), (2, long), (1, long + " x"), (None, "a b c d"), (None, "lone words here")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    ids = {(r["doc_id"], r["component_id"]) for r in out}
    assert ids == {(5, 3), (3, 3), (9, 7), (7, 7), (2, 1), (1, 1), (None, 3), (None, None)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [slow_fingerprint(r["text"]) for r in docs]
    at = groups(fps)
    out = {r["doc_id"]: r for r in simhash.op7_simhash(spark, sf).collect()}
    for i, r in enumerate(docs):
        assert out[r["doc_id"]]["fingerprint"] == f"{fps[i]:016x}"
        assert out[r["doc_id"]]["component_id"] == docs[at[i]]["doc_id"]
