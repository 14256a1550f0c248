"""Quality rules: boosted trees over document statistics (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import samples, textstats
from tracemill.llm.boosting import Trees, fit
from tracemill.llm.common import materialise, readable, sliced, table, text_hash

#: Most labelled rows that the trees are fitted on.
FIT_ROWS = 20_000
MIN_WORDS, MAX_REPEAT, THRESHOLD = 10, 20, 0.5
#: More symbols, repeated lines, repeated words or exclamation marks never raise a score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "mark_share")
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    """Trees that tell good documents (label 1) from bad, fitted on at most fit_rows labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [textstats.statistics(t)[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "order"])

    known = materialise(samples.labels(labels, target), "rules-labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), readable("text").alias("text"), F.xxhash64("doc_id", text_hash()).alias("order"))
    taken = rows.join(samples.some(known, fit_rows), "doc_id").select("text", "y", "order").mapInArrow(run, "x array<double>, y int, order long")
    got = samples.bounded(taken, fit_rows).collect()
    found = np.array([r["x"] for r in got], np.float64).reshape(-1, len(textstats.FEATURES))
    monotone = np.array([-(f in FALLING) for f in textstats.FEATURES], np.int64)
    return fit(found, np.array([r["y"] for r in got], np.float64), monotone)


def verdicts(texts: list[str | None], trees: Trees, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics, whether the base rules fail, whether a text is kept, and its score."""
    both = [textstats.statistics(t) for t in texts]
    base = np.array([x for x, _ in both], np.int64).reshape(-1, 5)
    score = trees.probability(np.array([f for _, f in both], np.float64).reshape(-1, len(textstats.FEATURES)))
    failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT * base[:, 0])
    return base, failed, ~failed & (score >= threshold), score


def judge(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Statistics and verdict of every row of docs (doc_id, text); see COLUMNS.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT percent of the
    words in repeated five-word runs. kept is false if base_failed, else the score
    has to reach threshold. A null, empty or blank text has no words and fails.
    Repeated rows each get a row, a null doc_id stays null, other columns are
    ignored, an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            base, failed, kept, score = verdicts(b.column(1).to_pylist(), model.value, threshold)
            columns = [b.column(0), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *textstats.BASE, "base_failed", "kept", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), readable("text").alias("text")).mapInArrow(run, COLUMNS)


def passes(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(verdicts(list(texts), model.value, threshold)[2])

    return docs.where(kept(readable("text")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
