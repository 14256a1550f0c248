"""The pipeline, stage by stage, against plain loops over what each stage got."""

import pytest

import corpus_pipeline
from tests.llm.test_packing import check
from tests.llm.test_simhash import groups, slow_fingerprint
from tests.llm.test_substring_dedup import brute
from tracemill.llm import cotraining, quality_rules, substring_dedup, textstats

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = [rows_of(docs)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            kept.append(rows_of(docs))
        if k == 0:
            views = cotraining.train(before, labels)
            assert {r["doc_id"] for r in cotraining.score(before, views).where("kept").collect()} == set(kept[1])
        if k == 1:
            judged = quality_rules.judge(before, quality_rules.train(before, labels)).collect()
            assert {r["doc_id"] for r in judged if r["kept"]} == set(kept[2])
            for i in kept[2]:
                n, _, _, _, repeat = textstats.base_statistics(kept[2][i]["text"])
                assert n >= 10 and 100 * repeat <= 20 * n
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(good & set(kept[1])) >= 0.97 * len(good & set(kept[0]))
    assert len(bad & set(kept[2])) <= 0.1 * len(bad & set(kept[0]))
    order = sorted(kept[2])
    at = groups([slow_fingerprint(kept[2][i]["text"]) for i in order])
    assert {order[i] for i in at} == set(kept[3])
    cut = brute([(i, kept[3][i]["text"]) for i in kept[3]], least=substring_dedup.LINE_WORDS, run=substring_dedup.PASSAGE_WORDS)
    assert {i: r["text"] for i, r in kept[4].items()} == {i: t for i, (t, _) in cut.items()}
    check(docs.collect(), [(i, r["text"]) for i, r in kept[4].items()])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "a b " * 40, None, "s", 4), (1, "a b " * 40, None, "s", 4)]])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
    again = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert len(again) == len({(r[0], r[1]) for r in rows if r[1]}) + (1 if rows else 0)


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
