"""Every operator on columns named as those it makes, ids at both ends of long, nulls, and repeated rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import cotraining, html_text, lexical, merkle, packing, pieces, preferences, quality_rules, simhash, spotsigs, substring_dedup, token_counts, warc

LOW, HIGH = -(1 << 63), (1 << 63) - 1
IDS = [LOW, HIGH, 0, None, HIGH]
TEXTS = ["the red house of many words", "", None, "x y z", ""]
NAMES = "row rank th key void id k fp root first component_id positions bytes size shared near a b m node length part nth piece start ids_crc32 n before range_no edge fingerprint n_chars ids n_ids round_trip payload payload_bytes payload_digest least run seq url_key captured_at place offset record_type refers_to n_blocks pair rendered train_start cut cell whole".split()


def made(spark, key, **columns):
    names = [n for n in NAMES if n not in columns and n != key]
    rows = [(i, *values, *(f"mine {n}" for n in names)) for i, *values in zip(IDS, *columns.values(), strict=True)]
    return spark.createDataFrame(rows, f"{key} long, " + ", ".join(f"{c} string" for c in columns) + ", " + ", ".join(f"`{n}` string" for n in names))


OPERATORS = {
    "op1": lambda s: pieces.encode(made(s, "doc_id", text=TEXTS)), "op6": lambda s: packing.pack_documents(made(s, "doc_id", text=TEXTS)), "op7": lambda s: simhash.near_duplicates(made(s, "doc_id", text=TEXTS)),
    "op10": lambda s: spotsigs.edited_fingerprints(made(s, "doc_id", text=TEXTS)), "op5": lambda s: html_text.extract(made(s, "page_id", url=TEXTS, html=TEXTS)), "op9": lambda s: warc.archive_and_index(made(s, "page_id", url=TEXTS, html=TEXTS)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_keeps_its_id(spark, name):
    out = OPERATORS[name](spark)
    key = "page_id" if "page_id" in out.columns else "doc_id"
    assert sorted(str(r[key]) for r in out.collect()) == sorted(map(str, IDS))


def bad(spark, key, *columns):
    """Rows of which the first holds bytes that are no UTF-8, the second a million words."""
    raw = "cast(X'ff41206220632064' as string)"
    return spark.range(3).select(F.col("id").alias(key), *(F.expr(f"case id when 0 then {raw} when 1 then repeat('word many ', 500000) else 'a plain text of some words' end").alias(c) for c in columns), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))


BAD = {
    "op1": lambda s: pieces.encode(bad(s, "doc_id", "text")), "op2": lambda s: substring_dedup.dedup(bad(s, "doc_id", "text")), "op4": lambda s: quality_rules.judge(bad(s, "doc_id", "text"), quality_rules.train(bad(s, "doc_id", "text"), s.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int"))), "op6": lambda s: packing.pack_documents(bad(s, "doc_id", "text")),
    "op3": lambda s: cotraining.features(bad(s, "doc_id", "text")), "op7": lambda s: simhash.near_duplicates(bad(s, "doc_id", "text")), "op10": lambda s: spotsigs.edited_fingerprints(bad(s, "doc_id", "text")), "op5": lambda s: html_text.extract(bad(s, "page_id", "url", "html")),
    "op9": lambda s: warc.archive_and_index(bad(s, "page_id", "url", "html")), "op11": lambda s: merkle.manifest(bad(s, "doc_id", "text")), "op12": lambda s: token_counts.token_counts(bad(s, "doc_id", "text")),
    "op13": lambda s: lexical.ranked(bad(s, "doc_id", "text"), bad(s, "item_id", "text").where("item_id = 2")).select("doc_id"),
}


@pytest.mark.parametrize("name", sorted(BAD))
def test_bad_bytes_and_long_texts_are_read(spark, name):
    out = BAD[name](spark)
    found = {r[0] for r in out.select("page_id" if "page_id" in out.columns else "doc_id" if "doc_id" in out.columns else out.columns[0]).collect()}
    assert found == ({2} if name == "op13" else {0, 1, 2})


def test_pairs(spark):
    df = made(spark, "pair_id", role=["user"] * 5, text=TEXTS).withColumnRenamed("n", "turn").selectExpr("* except (turn)", "cast(null as long) as turn")
    out = preferences.format_pairs(df, df).collect()
    assert sorted(r["pair_id"] for r in out) == [LOW, 0, HIGH, HIGH] and {r["part"] for r in out} == {"prompt"}


@pytest.mark.parametrize("stage", range(1, 4))
def test_stages_return_the_columns_as_they_came(spark, stage):
    own = [n for n in NAMES if n != "n_chars"]
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{text} {t}", "en", "s", 5, *(f"mine {n}" for n in own)) for i, t in zip(IDS, TEXTS, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in own))
    out = corpus_pipeline.STAGES[stage][1](spark, df, "/root/testdata/sf0.001")
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(r[n] == f"mine {n}" for r in got for n in own)
