"""Token counts against the library's on whole texts; chunks small enough that all seams are met."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm import token_counts as tc

WHOLE = Tokenizer.from_file(tc.default_tokenizer())


def expected(texts):
    return sorted((str(i), len((t or "").encode()), n := len(WHOLE.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in texts)


def got(spark, texts, **how):
    df = spark.createDataFrame([(i, t, "clash", 5, "k") for i, t in texts], "doc_id long, text string, n_tokens string, n_bytes int, key string")
    return sorted((str(r["doc_id"]), *r[1:]) for r in tc.token_counts(df, **how).collect())


def odd_text(rnd, size):
    parts = ["<|endoftext|>", "<|endof", "|>", "  ", "   \n\n", "\t", "'s", "'ll ", "don't", " héé", "ñandú", "日本語", "🙂🙂", "é", "12345", " 7", "!!", " ...", "word ", " ", "　x", "a" * 30, "\x00", "\r\n"]
    out = []
    while sum(map(len, out)) < size:
        out.append(rnd.choice(parts) * rnd.choice([1, 1, 1, 2, 9]))
    return "".join(out)


@pytest.mark.parametrize("chunk,overlap", [(200, 40), (1000, 100)])
def test_chunks_count_as_the_whole(spark, chunk, overlap):
    rnd = random.Random(chunk)
    texts = [(i, odd_text(rnd, rnd.choice([3, 150, 700, 3000, 9000]))) for i in range(30)]
    assert got(spark, texts, chunk=chunk, overlap=overlap) == expected(texts)


def test_overlaps_are_widened_until_they_align(spark):
    texts = [(1, "x" * 5000), (2, "a b " * 500 + "y" * 3000 + " c d" * 500), (3, " " * 4000 + "z"), (4, "\n" * 2500), (5, "é" * 3000), (6, "1" * 999 + "<|endoftext|>" * 200)]
    assert got(spark, texts, chunk=128, overlap=40) == expected(texts)


def test_odd_rows(spark):
    long = "many words of one text, " * 40_000
    texts = [(1, None), (None, ""), (2, "x"), (2, "x"), (-(1 << 63), "<|endoftext|>"), ((1 << 63) - 1, "  "), (3, long), (3, long), (None, long), (4, "q" * 300_000)]
    assert got(spark, texts) == expected(texts)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_invalid_bytes_are_replaced(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'ff41206220632064' as string)").alias("text"))
    r = tc.token_counts(df).first()
    assert r["n_bytes"] == 10 and r["n_tokens"] == len(WHOLE.encode("�A b c d", add_special_tokens=False).ids)


def test_marks_are_those_of_the_whole_text():
    rnd = random.Random(3)
    with open(tc.default_tokenizer(), encoding="utf-8") as f:
        counter = tc.Counter(f.read())
    for _ in range(300):
        data = odd_text(rnd, 400).encode()
        at, before, n = counter.marks(data, 0)
        whole = dict(zip(at.tolist(), before.tolist(), strict=True))
        assert n == len(WHOLE.encode(data.decode(), add_special_tokens=False).ids)
        start = rnd.randrange(1, len(data) - 60)
        cut = data[start : start + rnd.randrange(60, 200)]
        places, tokens, _ = counter.marks(cut, start)
        sure = [(p, k) for p, k in zip(places.tolist(), tokens.tolist(), strict=True) if p <= start + len(cut) - counter.guard]
        common = next((i for i, (p, _) in enumerate(sure) if p in whole), None)
        if common is not None:  # from the first common boundary on all are common, and so are the tokens between them
            base = whole[sure[common][0]] - sure[common][1]
            assert all(whole.get(p) == k + base for p, k in sure[common:])


def test_tokenizers_without_a_bound_are_not_cut():
    assert tc.lookahead('{"pre_tokenizer": {"type": "Whitespace"}, "added_tokens": []}') is None
    assert tc.lookahead('{"pre_tokenizer": {"type": "ByteLevel", "use_regex": true, "add_prefix_space": true}, "added_tokens": []}') is None


def test_the_query(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((str(r[0]), *r[1:]) for r in tc.op12_token_counts(spark, sf).collect()) == expected(texts)
