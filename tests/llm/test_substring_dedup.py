"""Repeated lines: which go, and where they were."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from tracemill.llm import substring_dedup as sd

L1, L2 = " ".join(f"a{i}" for i in range(12)), " ".join(f"Bé{i}" for i in range(10))


def brute(rows, separator="\n", least=1, run=None):
    """Texts and places, going through the documents in rank order, word by word."""
    seen, first, out = set(), {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        norm = [t[a:b].lower() for a, b in words]
        gone, at = [False] * len(words), 0
        for unit in t.split(separator):
            inside = [k for k, (a, b) in enumerate(words) if at <= a and b <= at + len(unit)]
            at += len(unit) + len(separator)
            said = " ".join(norm[k] for k in inside)
            if len(inside) >= least and inside:
                for k in inside if said in seen else []:
                    gone[k] = True
                seen.add(said)
        for k in range(len(words) - run + 1) if run else []:
            where = first.setdefault(tuple(norm[k : k + run]), (i, k))
            if where[0] != i or k - where[1] >= run:
                gone[k : k + run] = [True] * run
        spans, text, left = [], "", None
        for k, (a, b) in enumerate(words):
            if gone[k]:
                spans = [*spans[:-1], (spans[-1][0], b)] if k and gone[k - 1] else [*spans, (a, b)]
                continue
            before = t[words[k - 1][1] if k else 0 : a]
            if left is None:
                text += before if k == 0 else ""
            elif left == k - 1:
                text += before
            else:
                after = t[words[left][1] : words[left + 1][0]]
                text += before if before.count("\n") > after.count("\n") else after
            text, left = text + t[a:b], k
        text += t[words[left][1] :] if left is not None and left == len(words) - 1 else ""
        out[i] = (text if spans else t, spans)
    return out


@pytest.mark.parametrize(("unit", "least"), [("line", 1), ("line", 10), ("paragraph", 1)])
def test_cuts_and_offsets(spark, unit, least):
    s = sd.SEPARATORS[unit]
    rows = [(4, s.join([L1, "short line", L2])), (2, s.join(["short line", " " + L2.upper() + "  ", L2, ""])), (7, L1), (1, s.join(["ü", "", L1.replace(" ", "\t"), ""])), (9, s.join(f"{L1} {i % 900}" for i in range(2000))), (11, "Then " + L2 + ". " + L1 + "! " + L2 + " and more? Yes."), (12, f"ü{s}{s}{s}new\v{s}short  LINE{s}{s}end {s}")]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, rank int, removed string")
    out = {r["doc_id"]: (r["text"], [tuple(x) for x in r["removed"]]) for r in sd.dedup(df, unit, least).collect()}
    assert out == brute(rows, s, least)
    assert any(p for _, p in out.values())


@pytest.mark.parametrize("passage_words", [None, 6])
def test_nulls_ties_clashes_and_empty_tables(spark, passage_words):
    inner = "row rank th gone runs hit cut digest first n again anchor word nth start end whole".split()
    rows = [(1, None), (2, ""), (3, L1), (3, L1), (None, L1), (4, f"{L1}\n{L1}"), (4, L1), (-(1 << 63), "low\nlow"), ((1 << 63) - 1, "low\nhigh")]
    df = spark.createDataFrame([(i, t, *(f"mine {c}" for c in inner)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in inner))
    got = sd.dedup(df, passage_words=passage_words)
    out = sorted(((r["doc_id"], r["text"], len(r["removed"])) for r in got.collect()), key=str)
    assert out == sorted([(1, None, 0), (2, "", 0), (3, L1, 0), (3, L1, 0), (None, "", 1), (4, "", 1), (4, "", 1), (-(1 << 63), "low", 1), ((1 << 63) - 1, "high", 1)], key=str)
    assert got.columns == ["doc_id", "text", *inner, "removed"]
    assert all(r[c] == f"mine {c}" for r in got.collect() for c in inner)
    assert sd.dedup(df.limit(0), passage_words=passage_words).count() == 0


def test_very_long_text(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "first\n" + long)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in sd.dedup(df, passage_words=50).collect()}
    assert out[1]["text"] == long and out[2]["text"] == "first" and len(out[2]["removed"]) == 1


def test_query_against_sql(spark, sf):
    got = {tuple(r) for r in sd.op2_substring_dedup(spark, sf).select("doc_id", "text", "n_removed", "removed").collect()}
    duckdb.execute(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    assert got == set(duckdb.execute(sd.SQL).fetchall())


def test_passages_go_whole_wherever_they_lie(spark):
    rnd = random.Random(5)
    say = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    p, q = say(25) + " " + say(6) + ". " + say(22), say(60)
    rows = [(1, f"{say(30)} {p} {say(9)}"), (2, f"{say(5)} {p.upper()} {say(3)}\n{say(2)}"), (3, f"{say(20)}\n\n{q}"), (4, f"{say(4)} {q[:200]}"), (5, q + "\n" + say(4)), (6, f"İ {say(7)}\n\n{q} {p}  {say(9)}"), (7, "a b c " * 60), (8, say(70_000) + " " + p + " " + say(3)), (9, say(49)), (10, q + "\\n" + "end"), (11, q + "\\n" + "end"), (12, "u " * 49), (13, "u " * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in sd.dedup(df, passage_words=50).collect()}
    assert {i: (r["text"], [tuple(x) for x in r["removed"]]) for i, r in out.items()} == brute(rows, run=50)
    assert p.split()[0].upper() not in out[2]["text"] and out[2]["text"].count("\n") == 1
    assert sd.dedup(df.limit(0), passage_words=50).count() == 0


def test_pipeline_stage_cuts_passages(spark, sf):
    p = " ".join(f"p{i}" for i in range(55))
    df = spark.createDataFrame([(1, f"one {p} end", "x"), (2, f"two {p} stop", "y")], "doc_id long, text string, source string")
    assert sorted(map(tuple, corpus_pipeline.substring(spark, df, sf).collect())) == [(1, f"one {p} end", "x"), (2, "two stop", "y")]
