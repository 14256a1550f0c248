"""Both quality operators: statistics by brute force, verdicts by held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import boosting, cotraining, quality_rules, textstats

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for r in runs:
        count[r] = count.get(r, 0) + 1
    inside = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_statistics():
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x\x1cy z é  <#>\n<#>\n \n \n"]
    texts += [" ".join(rnd.choice(["a", "bü", "c|", "d\n", "\ne"]) for _ in range(n)) for n in (3, 9, 30, 300)]
    for t in texts:
        assert textstats.base_statistics(t) == brute(t) == textstats.statistics(t)[0]


def test_trees_are_monotone_and_fit():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(4000, 3))
    y = (x[:, 0] - np.sin(3 * x[:, 1]) + 0.3 * rnd.normal(size=4000) > 0).astype(float)
    trees = boosting.fit(x[:3000], y[:3000], np.array([1, 0, -1]))
    assert ((trees.probability(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.88
    for j, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:200], 40, axis=0)
        grid[:, j] = np.tile(np.linspace(-4, 4, 40), 200)
        steps = np.diff(trees.score(grid).reshape(200, 40), axis=1)
        assert (sign * steps >= -1e-9).all()
    none = boosting.fit(np.zeros((0, 2)), np.zeros(0), np.array([0, 0]))
    assert (none.probability(np.ones((3, 2))) == 0.5).all()


def split(spark, sf=SF):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")


@pytest.mark.parametrize("module", [quality_rules, cotraining])
def test_held_out_accuracy(spark, module):
    docs, some, others = split(spark, "/root/testdata/sf0.1")
    model = module.train(docs, some)
    judged = module.judge(docs, model).where("not base_failed") if module is quality_rules else module.score(docs, model)
    judged = judged.join(others, "doc_id").select("kept", F.col("quality").alias("q")).collect()
    good = [r["kept"] for r in judged if r["q"] == 1]
    bad = [r["kept"] for r in judged if r["q"] == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.15 * len(bad)


def test_rules_on_odd_rows(spark):
    docs, some, _ = split(spark)
    trees = quality_rules.train(docs, some)
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "a b"), (4, long), (4, long), (5, "one two three four five " * 30)]
    df = spark.createDataFrame([(i, t, "c", 9) for i, t in rows], "doc_id long, text string, kept string, n_words int")
    out = quality_rules.judge(df, trees).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and got[4]["n_words"] == 60_000 and not got[4]["base_failed"]
    assert [got[i]["base_failed"] for i in (1, 2, None, 5)] == [True] * 4 and not got[5]["kept"]
    assert quality_rules.judge(df.limit(0), trees).count() == 0
    assert quality_rules.passes(df, trees).columns == df.columns
    assert quality_rules.passes(df, trees).count() == sum(r["kept"] for r in out)
    empty = quality_rules.train(docs.limit(0), some)
    assert quality_rules.judge(df, empty).where("kept").count() == 2


def test_cotraining_on_odd_rows(spark):
    docs, some, _ = split(spark)
    views = cotraining.train(docs, some)
    rows = [(1, None, None, None, None), (None, "", "src0", "en", 0), (3, "a " * 50_000, "new", "xx", -4), (3, "a " * 50_000, "new", "xx", -4)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, score double")
    out = cotraining.score(df, views).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert cotraining.passes(df, views).columns == df.columns
    assert cotraining.passes(df, views).count() == sum(r["kept"] for r in out)
    assert cotraining.score(df.limit(0), views).count() == 0
    assert cotraining.score(df.select("doc_id", "text"), cotraining.train(docs, some.limit(0))).where("kept").count() == 4


def test_queries_return_every_row(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality_rules.op4_quality_rules(spark, sf).collect()
    for r in rows:
        n, chars, symbols, dup, repeat = brute(docs[r["doc_id"]])
        assert tuple(r)[1:6] == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    assert len(rows) == len(docs) == cotraining.op3_cotraining(spark, sf).count()


def numpy_surest(text, metadata, handed):
    """What cotraining.fit() asks Spark for, over arrays; handed gets every row that a view is surest of."""
    order = np.arange(len(text), dtype=np.int64)

    def surest(views, good, bad, taken):
        free = np.array([i for i in order if i not in taken], np.int64)
        p = views.scores(text[free], metadata[free])
        out = {}
        for v, label, at in cotraining.top(p, order[free], good, bad):
            out[(v, label)] = (free[at], text[free[at]], metadata[free[at]])
            handed.append((v, label, free[at]))
        return out

    return surest


def two_views(n, labelled, seed=4):
    """Rows of which both views tell the class: the text by two statistics, the metadata by source and length; labels for some."""
    rnd = np.random.default_rng(seed)
    y = (rnd.random(n) < 0.5).astype(float)
    text = np.zeros((n, cotraining.STATISTICS + cotraining.WORD_BUCKETS))
    text[:, 0] = y + rnd.normal(0, 0.6, n)
    text[:, 1] = -y + rnd.normal(0, 0.6, n)
    source = np.where(rnd.random(n) < 0.8, y, 1 - y) * 8 + rnd.integers(0, 8, n)
    metadata = cotraining.metadata_features(source, np.zeros(n), 50 + 400 * y + rnd.normal(0, 180, n))
    return text, metadata, y, rnd.random(labelled) < 0.5


def test_both_views_hand_rows_over_and_gain():
    k, gains, rounds = 120, [], 0
    for seed in range(6):
        text, metadata, y, held = two_views(4000, k, seed)
        handed = []
        alone, _ = cotraining.co_train(text[:k], metadata[:k], y[:k], held, numpy_surest(text[k:3000], metadata[k:3000], []), rounds=0)
        views, log = cotraining.co_train(text[:k], metadata[:k], y[:k], held, numpy_surest(text[k:3000], metadata[k:3000], handed), handed=100)
        given = [x for each in log for x in each]
        assert {v for v, _ in given} == {0, 1} and {label for _, label in given} == {0, 1}
        rounds = max(rounds, len(log))
        right = lambda m, i: ((m.scores(text[3000:], metadata[3000:])[:, i] > 0.5) == (y[3000:] > 0.5)).mean()  # noqa: B023, E731
        gains.append([right(views, i) - right(alone, i) for i in range(3)])
    assert rounds > 1 and (np.mean(gains, axis=0) > 0).all(), gains


def test_no_row_is_handed_over_twice_and_a_view_that_cannot_tell_hands_nothing():
    text, metadata, y, held = two_views(3000, 1000)
    metadata = np.random.default_rng(0).permutation(metadata)
    handed = []
    _, log = cotraining.co_train(text[:1000], metadata[:1000], y[:1000], held, numpy_surest(text[1000:], metadata[1000:], handed), handed=50)
    assert log and all(v == 0 for each in log for v, _ in each)
    taken = [i for v, _, rows in handed[: 4 * len(log)] if v == 0 for i in rows.tolist()]
    assert len(taken) == len(set(taken))


def test_columns_named_as_its_own_and_ids_at_both_ends(spark):
    docs, some, _ = split(spark)
    own = "y x order view label away size doc score kept text_score known".split()
    ends = [(-(1 << 63), "a b"), ((1 << 63) - 1, "c d")]
    df = docs.select("doc_id", "text", "source", "lang", "n_chars", *(F.lit(f"mine {c}").alias(c) for c in own if c != "size"), F.lit("mine size").alias("size"))
    df = df.unionByName(spark.createDataFrame(ends, "doc_id long, text string"), allowMissingColumns=True)
    for module in (cotraining, quality_rules):
        model = module.train(df, some)
        kept = module.passes(df, model)
        assert kept.columns == df.columns and {r["y"] for r in kept.where("y is not null").collect()} == {"mine y"}
    assert {-(1 << 63), (1 << 63) - 1} <= {r["doc_id"] for r in cotraining.score(df, cotraining.train(df, some)).collect()}
