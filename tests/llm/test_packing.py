"""Packing: every id once, no gaps, and near the fewest sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracemill.llm import packing


def filled(planned):
    """bin -> [(offset, length)] of a plan."""
    bins = defaultdict(list)
    for length, _, count, first, offset in planned.rows:
        for b in range(first, first + count):
            bins[b].append((offset, length))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([64, 512, 4096])
    counts = Counter(min(capacity, 1 + int(rnd.lognormvariate(np.log(capacity / 5), 1))) for _ in range(rnd.choice([1, 50, 5000])))
    planned = packing.plan(dict(counts), capacity, groups=rnd.choice([1, 7, 256]))
    bins = filled(planned)
    assert Counter(n for b in bins.values() for _, n in b) == counts
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == planned.bins
    ranks = defaultdict(int)
    for length, rank, count, _, _ in planned.rows:
        assert rank == ranks[length]
        ranks[length] += count


def test_plan_is_near_the_lower_bound():
    rnd = random.Random(7)
    counts = Counter(min(4096, 5 + int(rnd.lognormvariate(6.6, 0.9))) for _ in range(50_000))
    planned = packing.plan(dict(counts))
    assert planned.bins <= 1.002 * sum(n * c for n, c in counts.items()) / 4096 + 1


def test_empty_plan():
    assert packing.plan({}).bins == 0


def check(rows, texts):
    """rows against ids made text by text."""
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at : at + 4096]
            want[(i, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096


def test_hard_texts(spark):
    odd = ["", None, "  ", "Don't STOP,. we're <|endoftext|> é É é ΣΑΣ x y a\x1cb 12,5. İ", "w" * 9000, "a, " * 6000, "x.", "ﬁ ﬀ. Ǆ,", "İ, İ. a", "İ\u0327. e\u0301, E\u0301. \u0301x y\u00a0z \u00a0 \u2028 ŉ. ſ, K. ß! don't!! l'an's 's x's,", "a<|endoftext|>b <|startoftext|>, <|endoftext|>.", "\n\n \t\x0b\x0c\r"]
    texts = [*enumerate(odd), (0, ""), (3, odd[3]), (None, "null id")]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in texts], "doc_id long, text string, length string, part int")
    check(packing.pack_documents(df).collect(), texts)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = packing.op6_packing(spark, sf).collect()
    check(rows, docs)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * sum(r["length"] for r in rows) / 4096 + 1
