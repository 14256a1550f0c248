"""Preference pairs against a plain comparison of turn lists."""

import random

import duckdb

from tracemill.llm import preferences as pf

SCHEMA = "pair_id long, turn long, role string, text string, part string"


def brute(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[:k], a[k:], b[k:]


def test_against_turn_lists(spark):
    rnd = random.Random(6)
    pairs = {}
    for i in range(60):
        a = [(rnd.choice(["user", "assistant"]), rnd.choice(["x", "yé", ""])) for _ in range(rnd.randrange(6))]
        b = a[: rnd.randrange(len(a) + 1)] + [(rnd.choice(["user", "assistant"]), rnd.choice(["x", "yé"])) for _ in range(rnd.randrange(4))]
        pairs[i] = (a, b)
    sides = [spark.createDataFrame([(i, t, *x, "junk") for i, p in pairs.items() for t, x in enumerate(p[k])], SCHEMA) for k in (0, 1)]
    rows = pf.format_pairs(*sides).collect()
    for i, (a, b) in pairs.items():
        got = {part: [(r["role"], r["rendered"], r["train_start"], r["train_end"]) for r in sorted(rows, key=lambda r: r["place"]) if r["pair_id"] == i and r["part"] == part] for part in ("prompt", "chosen", "rejected")}
        for part, turns in zip(("prompt", "chosen", "rejected"), brute(a, b)):
            assert [(r, f"<|im_start|>{r}\n{t}<|im_end|>\n") for r, t in turns] == [x[:2] for x in got[part]]
            for role, text, lo, hi in got[part]:
                trained = part != "prompt" and role == "assistant"
                assert text[lo:hi] == (text.split("\n", 1)[1] if trained else "")


def test_odd_rows(spark):
    long = "w " * 200_000
    a = [(1, 0, "user", "q"), (1, 1, None, None), (1, 2, "assistant", long), (2, None, "user", "n"), (None, 0, "user", "lost"), (3, 0, "user", "t"), (3, 0, "system", "t"), (3, 0, "user", "t")]
    b = [(1, 0, "user", "q"), (1, 1, None, None), (1, 2, "assistant", "no"), (2, None, "user", "n"), (3, 0, "system", "t"), (3, 0, "user", "t"), (4, 5, "assistant", "alone")]
    left, right = (spark.createDataFrame([(*r, "x") for r in side], SCHEMA) for side in (a, b))
    out = sorted((r["pair_id"], r["part"], r["role"], len(r["rendered"])) for r in pf.format_pairs(left, right).collect())
    assert [x[:3] for x in out] == [
        (1, "chosen", "assistant"), (1, "prompt", "unknown"), (1, "prompt", "user"), (1, "rejected", "assistant"), (2, "prompt", "user"),
        (3, "chosen", "system"), (3, "chosen", "user"), (3, "chosen", "user"), (3, "rejected", "system"), (3, "rejected", "user"), (4, "rejected", "assistant"),
    ]
    assert pf.format_pairs(left.limit(0), right.limit(0)).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    columns = ["pair_id", "part", "place", "role", "rendered", "train_start", "train_end"]
    got = sorted(map(tuple, pf.op8_preferences(spark, sf).select(*columns).collect()))
    duckdb.execute(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    assert got == sorted(duckdb.execute(pf.SQL).fetchall())


def test_null_turn_is_in_both_conversations(spark, tmp_path):
    rows = [(c, t, "user", f"{c if t else 0} {t}") for c in (0, 1) for t in (None, 1, 2, 3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from tracemill.llm.preferences import op8_preferences

    got = [r["part"] for r in op8_preferences(spark, str(tmp_path)).where("place is null or place < 0").collect()]
    assert got == ["prompt", "prompt"]


def test_a_row_for_each_pair(spark):
    sides = [[(1, 0, "user", "q"), (1, 1, "assistant", t), (1, 2, "user", "then"), (1, 3, "assistant", "é" + t)] for t in ("yes", "no")]
    big = [[(2, 0, "user", "q"), (2, 1, "assistant", t * 300)] for t in "ab"]
    left, right = (spark.createDataFrame([(*r, "x") for r in sides[k] + big[k]], SCHEMA) for k in (0, 1))
    rows = {r["pair_id"]: r for r in pf.paired_rows(pf.format_pairs(left, right), most_chars=500).collect()}
    assert rows[1]["prompt"] == "<|im_start|>user\nq<|im_end|>\n" and rows[1]["whole"]
    for part, answer in (("chosen", "yes"), ("rejected", "no")):
        assert [rows[1][part][x["start"] : x["end"]] for x in rows[1][f"{part}_train"]] == [f"{answer}<|im_end|>\n", f"é{answer}<|im_end|>\n"]
    assert (rows[2]["whole"], rows[2]["chosen"], rows[2]["chosen_train"]) == (False, None, None)
    assert pf.paired_rows(pf.format_pairs(left.limit(0), right.limit(0))).count() == 0


def test_pairs_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    columns = ["pair_id", "prompt", "chosen", "rejected", "chosen_train", "rejected_train", "whole"]
    got = sorted(map(tuple, pf.preference_pairs(spark, sf).select(*columns).collect()))
    duckdb.execute(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    assert got == sorted(duckdb.execute(pf.PAIRS_SQL).fetchall())
