"""Merkle manifests against plain loops: every height, slot and run length, odd rows, and what tampering is found."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracemill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, d string, up string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return h(*(value(v) for v in row[:4]), value(text))


def climbed(nodes):
    """Root of nodes, and for each the (left, right) of every level."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                step = ("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i))
                for m in members[i]:
                    paths[m].append(step)
        nodes, members = [h(*(nodes[i] for i in run)) for run in runs], [[m for i in run for m in members[i]] for run in runs]
    return nodes[0], paths


def expected(rows):
    rows = [(r, leaf(r, r[4])) for r in rows]
    sources = sorted({r[1] for r, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted(((r, d) for r, d in rows if r[1] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for s in sources]
    made = [climbed([d for _, d in t]) for t in trees]
    root, over = climbed([m[0] for m in made])
    out = []
    for t, (subroot, paths), above in zip(trees, made, over, strict=True):
        for (r, d), path in zip(t, paths, strict=True):
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(r, r[4].replace("\n", "")) if tampered else d
            for left, right in path + above:
                folded = h(left, folded, right)
            out.append((str(r[0]), d, subroot, root, h(*(x for step in path + above for x in step)), folded, folded == root))
    return sorted(out)


def got(spark, rows, levels):
    df = spark.createDataFrame([(*r, *["mine"] * 1, 7, "x", "y", "z") for r in rows], SCHEMA)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.verified(merkle.manifest(df, F.when(even, F.translate("text", "\n", "")), levels))
    return sorted((str(r["doc_id"]), *r[1:]) for r in found.collect())


@pytest.mark.parametrize("levels", [2, merkle.LEVELS])
def test_against_loops(spark, levels):
    rows = [(i, "big", "en", i * 3, f"text {i}\nmore é\n") for i in range(-5, 41)]
    for k in range(1, 12):  # trees of 1 to 11 leaves: every length of the last run, more than one height
        rows += [(100 * k + i, f"s{k:02d}é", None, None, "a\nb") for i in range(k)]
    rows += [(3, None, "de", 0, None), (None, None, None, None, None), (None, "", "", 5, ""), (7, "", "x", 1, "\n")]
    rows += [(9, "again", "en", 1, "same\n")] * 5 + [(9, "again", "en", 1, "other")] + [(-(1 << 63), "again", "en", 2, "low"), ((1 << 63) - 1, "again", "en", 2, "high\n")]
    assert got(spark, rows, levels) == expected(rows)


def test_one_document_is_its_own_root(spark):
    rows = [(1, "s", "en", 3, "a\nb")]
    assert got(spark, rows, 2) == expected(rows)


def test_empty_table(spark):
    assert got(spark, [], 2) == []


def test_long_text_and_bad_bytes_are_taken_as_they_are(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "w " * 500_000), (2, "s", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumn("text", F.when(F.col("doc_id") == 2, F.expr("cast(X'ff4120' as string)")).otherwise(F.col("text")))
    found = {r["doc_id"]: r for r in merkle.verified(merkle.manifest(df)).collect()}
    assert found[1]["leaf"] == leaf((1, "s", "en", 1), "w " * 500_000)
    assert found[2]["leaf"] == hashlib.sha256(b"1:21:s2:en1:13:\xffA ").hexdigest() and all(r["verified"] for r in found.values())


def test_changed_line_ends_are_found(spark, sf):
    found = merkle.op11_merkle(spark, sf)
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in found.join(texts, "doc_id").select("doc_id", "text", "verified").collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1 or "\n" not in r["text"])
