"""Ranked lexical search against plain loops, and what the bounds skip."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def expected(docs, items, top=50):
    found = [(i, c) for i, t in docs if (c := terms(t))]
    n, total, df = len(found), sum(c.total() for _, c in found), Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in found:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms(text) if c[t])
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(str(item), k + 1, str(None if void else i), -s) for k, (s, void, i) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def got(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, "mine", 3) for r in docs], "doc_id long, text string, n string, terms int").repartition(3)
    q = spark.createDataFrame([(*r, "mine") for r in items], "item_id long, text string, rank string")
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in lexical.ranked(d, q, **how).collect())


def made(rnd, size, words):
    return " ".join(f"w{min(int(rnd.paretovariate(0.6)), words)}" for _ in range(size))


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"top": 3, "block_docs": 7}), (3, {"top": 5, "block_docs": 50, "query_bytes": 100})])
def test_against_loops(spark, seed, how):
    rnd = random.Random(seed)
    docs = [(i, made(rnd, rnd.choice([1, 5, 40, 200]), 300)) for i in range(400)]
    items = [(i, made(rnd, rnd.choice([1, 2, 7, 30]), 300)) for i in range(12)]
    assert got(spark, docs, items, **how) == expected(docs, items, how.get("top", 50))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "red house"), (None, "red house"), (5, "red house"), (5, "red house"), (-(1 << 63), "red house"), ((1 << 63) - 1, "RED É house"), (7, "É é ＲＥＤ 1st"), (8, "?!"), (9, "word " * 100_000 + "red"), (10, "x" * 3000)]
    items = [(1, "red, House red"), (1, "red, House red"), (2, None), (3, ""), (4, "é É 1ST"), (None, "house"), (5, "nowhere"), (6, "x" * 3000)]
    assert got(spark, docs, items) == expected(docs, items)
    assert got(spark, docs, items, top=2, block_docs=1) == expected(docs, items, 2)


def test_equal_scores_go_by_id(spark):
    docs = [(i, "red house") for i in range(500)]
    assert got(spark, docs, [(1, "red"), (2, "blue")], block_docs=20) == expected(docs, [(1, "red")])


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert got(spark, docs, items) == []


def test_invalid_bytes_are_part_of_a_term(spark):
    df = spark.range(2).select(F.col("id").alias("doc_id"), F.expr("if(id = 0, cast(X'61ff62' as string), 'a b')").alias("text"))
    items = spark.range(1).select(F.lit(1).alias("item_id"), F.expr("cast(X'41ff62' as string)").alias("text"))
    assert [r["doc_id"] for r in lexical.ranked(df, items).collect()] == [0]


def test_long_texts_are_cut_between_terms(monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["ab", " ", "É", "x" * 30, ", ", "Q1"]) for _ in range(2000)).encode()
    whole = lexical.terms(text)
    for stretch in (1, 10, 64, 1000):
        monkeypatch.setattr(lexical, "STRETCH", stretch)
        assert lexical.terms(text) == whole


def block(rnd, docs, words):
    rows = sorted({(rnd.randrange(words), rnd.randrange(docs)) for _ in range(docs * 6)})
    ids, places = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return lexical.Block(ids, places, np.array([rnd.randrange(1, 1000) for _ in rows], np.int64), docs)


def test_pairs_tighten_the_bounds_and_lose_nothing():
    """The same results with and without pair lists at every floor, and fewer documents scored with them."""
    rnd = random.Random(9)
    tried = Counter()
    for _ in range(20):
        b = block(rnd, 300, 30)
        query = rnd.sample(range(30), 8)
        units, single = lexical.paired(query, [0] * 30), [(t,) for t in query]
        b.index_pairs({u for u in units if len(u) == 2})
        truth = np.zeros(300, np.int64)
        for t in query:
            docs, impacts = b.postings(t)
            truth[docs] += impacts
        for floor in (1, 500, 1500, 2000, 2500, 4000):
            want = [(i, s) for i, s in enumerate(truth.tolist()) if s >= floor]
            for name, us in (("pairs", units), ("single", single)):
                places, scores, n = lexical.search(b, us, floor)
                assert sorted(zip(places.tolist(), scores.tolist(), strict=True)) == want
                tried[name] += n if floor > 1000 else 0  # below, no bound is low enough to skip anything
    assert tried["pairs"] < tried["single"]
