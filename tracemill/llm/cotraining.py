"""Quality classifier by co-training of a text view and a metadata view (operator 3)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import samples, textstats
from tracemill.llm.common import materialise, readable, sliced, table, text_hash

#: Most labelled rows that the views are fitted on; a quarter of them are held out.
FIT_ROWS, HELD_OUT = 10_000, 0.25
#: Rounds at most; rows that a view hands over in the first (twice as many in the second, and so on).
ROUNDS, HANDED = 4, 200
#: A view hands over rows of a class if so many of its surest held-out rows (that share of all, that number at least) are of the class.
PRECISE, SUREST, LEAST_SUREST = 0.8, 0.05, 20
#: The exchange ends when the loss on held-out rows is so much above the least so far.
TOLERANCE = 0.005
THRESHOLD = 0.5
BINS, WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 12, 128, 64, 16
METADATA = ("source", "lang", "n_chars")
STATISTICS = len(textstats.FEATURES)
#: A row for the fits: order is a hash of the row, x its text features, the rest its metadata features.
FEATURES = "doc_id long, order long, x binary, source int, lang int, size long"


@dataclass(frozen=True)
class Logistic:
    """Weights over columns scaled by their mean and spread; the last weight is the constant."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
    """Ridge logistic regression by Newton's method; without both classes, the classes' share alone."""
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    spread = np.where(spread < 1e-5, 1.0, spread)
    weights = np.zeros(x.shape[1] + 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    weights[-1] = math.log(share / (1 - share))
    if len(y) and 0 < y.sum() < len(y):
        z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-5)
            step = np.linalg.solve((z * w[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * weights)
            weights = weights + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-4:
                break
    return Logistic(mean, spread, weights)


def text_features(text: str | None) -> np.ndarray:
    """Statistics of the text, and the shares of its distinct words by hashed bucket, in half precision."""
    _, stats = textstats.statistics(text)
    distinct = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    buckets = np.bincount(np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) % WORD_BUCKETS, minlength=WORD_BUCKETS)
    return np.concatenate([np.array(stats, np.float32), (buckets / max(1, len(distinct))).astype(np.float16).astype(np.float32)])


def _pack(row: np.ndarray) -> bytes:
    return row[:STATISTICS].tobytes() + row[STATISTICS:].astype(np.float16).tobytes()


def _unpack(rows: list[bytes]) -> np.ndarray:
    """The text features of rows, as packed."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 4 * STATISTICS + 2 * WORD_BUCKETS)
    stats, shares = (np.ascontiguousarray(x) for x in (raw[:, : 4 * STATISTICS], raw[:, 4 * STATISTICS :]))
    return np.hstack([stats.view(np.float32), shares.view(np.float16)]).astype(np.float64)


def _bucket(value: str | None, buckets: int) -> int:
    return zlib.crc32(repr(value).encode("utf-8", "surrogatepass")) % buckets


def metadata_features(source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Source and language buckets as columns, and the stated length; a null length (NaN) has its own column."""
    n = len(size)
    out, every, stated = np.zeros((n, SOURCE_BUCKETS + LANG_BUCKETS + 4)), np.arange(n), np.nan_to_num(size)
    out[every, source.astype(np.int64)] = 1
    out[every, SOURCE_BUCKETS + lang.astype(np.int64)] = 1
    log = np.log1p(np.maximum(0, stated))
    out[:, -4:] = np.stack([log, log * log, np.isnan(size), stated <= 0], axis=1)
    return out


@dataclass(frozen=True)
class Views:
    """Bounds that cut the text statistics into bins, a classifier for each view, and their combination."""

    edges: np.ndarray
    text: Logistic
    metadata: Logistic
    scales: np.ndarray
    combined: Logistic

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Calibrated probabilities: of the text view, of the metadata view, of both."""
        logits = np.stack([self.text.logit(binned(text, self.edges)), self.metadata.logit(metadata)], axis=1)
        calibrated = logits * self.scales[:, 0] + self.scales[:, 1]
        all_three = np.column_stack([calibrated, self.combined.logit(calibrated)])
        return 1 / (1 + np.exp(-np.clip(all_three, -40, 40)))


def bounds(values: np.ndarray) -> np.ndarray:
    """Half of the bounds share out the rows evenly, half the distinct values: most rows may have the same one."""
    if not len(values):
        return np.zeros(BINS)
    steps = np.linspace(0, 1, BINS // 2 + 2)[1:-1]
    return np.concatenate([np.quantile(values, steps), np.quantile(np.unique(values), steps)])


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The statistics as steps (at or above each bound), then the other columns as they are."""
    n = STATISTICS
    steps = (x[:, :n, None] >= edges[None]).reshape(len(x), edges.size)
    return np.hstack([steps.astype(np.float64), x[:, n:]])


#: (view, label) -> the view's surest rows for that label: order, text features, metadata features.
Surest = dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def co_train(text: np.ndarray, metadata: np.ndarray, y: np.ndarray, held: np.ndarray, surest: Callable[["Views", int, int, set[int]], Surest], rounds: int = ROUNDS, handed: int = HANDED) -> tuple["Views", list[dict[tuple[int, int], int]]]:
    """Views fitted on the labelled rows and on what each view hands to the other; and what was handed over by round.

    In each round both views are fitted and calibrated on the held-out labelled
    rows. surest(views, good, bad, taken) then gives the rows of all unlabelled
    ones, but for those taken before, that each view is surest of: as many of
    each class as its share among the labelled rows, more with each round. They
    become training rows of the other view under that label, if the view is
    precise for it. The rounds end when nothing is handed over or the loss on the
    held-out rows rises; the views of the round before are kept then.
    """
    edges = np.stack([bounds(text[:, j]) for j in range(STATISTICS)])
    known, share = [binned(text, edges), metadata], float(y.mean()) if len(y) else 0.5
    given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    taken: set[int] = set()
    kept, least, log = None, math.inf, []
    for turn in range(max(0, rounds) + 1):
        models, scales = [], []
        for v in range(2):
            rows = [(known[v][~held], y[~held]), *given[v]]
            models.append(fit_logistic(np.vstack([x for x, _ in rows]), np.concatenate([c for _, c in rows])))
            scales.append(calibration(models[v].logit(known[v][held]), y[held]))
        scale = np.array(scales)
        logits = np.stack([m.logit(x[held]) for m, x in zip(models, known, strict=True)], axis=1) * scale[:, 0] + scale[:, 1]
        views = Views(edges, models[0], models[1], scale, fit_logistic(logits, y[held]))
        p = views.scores(text[held], metadata[held])
        loss = float(-np.log(np.maximum(1e-9, np.where(y[held] > 0, p[:, 2], 1 - p[:, 2]))).mean()) if held.any() else 0.0
        if kept and loss > least + TOLERANCE:
            break
        kept, least = views, min(least, loss)
        if turn == rounds or not 0 < share < 1:
            break
        good = max(1, round(handed * (turn + 1) * share))
        log.append({})
        for (v, label), (order, more_text, more_metadata) in surest(views, good, max(1, handed * (turn + 1) - good), taken).items():
            if precision(p[:, v], y[held], label) >= PRECISE and len(order):
                rows = (binned(more_text, edges), more_metadata)[1 - v]
                given[1 - v].append((rows, np.full(len(rows), float(label))))
                taken.update(order.tolist())
                log[-1][(v, label)] = len(order)
        if not log[-1]:
            break
    return kept, log


def precision(p: np.ndarray, y: np.ndarray, label: int) -> float:
    """Of the rows that a view is surest of for a label, the share that has it."""
    n = min(len(p), max(LEAST_SUREST, math.ceil(SUREST * len(p))))
    order = np.argsort(-p if label else p, kind="stable")[:n]
    return float((y[order] == label).mean()) if n else 0.0


def top(p: np.ndarray, order: np.ndarray, good: int, bad: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(view, label, rows): the surest rows of both views (columns of p), ties by order."""
    for v in range(2):
        for label, n in ((1, good), (0, bad)):
            yield v, label, np.lexsort((order, -p[:, v] if label else p[:, v]))[:n]


def calibration(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: factor and constant that make logits fit labels; a view that runs against them gets factor 0."""
    m = fit_logistic(logits[:, None], y)
    factor = float(m.weights[0] / m.spread[0])
    if factor < 0:
        return 0.0, float(fit_logistic(np.zeros((len(y), 0)), y).weights[-1])
    return factor, float(m.weights[1] - m.mean[0] * factor)


def features(docs: DataFrame) -> DataFrame:
    """The columns of FEATURES for every row of docs, in a few hundred bytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            text, source, lang = (b.column(i).to_pylist() for i in (2, 3, 4))
            columns = [pa.array([_pack(text_features(t)) for t in text], pa.binary()), pa.array([_bucket(v, SOURCE_BUCKETS) for v in source], pa.int32()), pa.array([_bucket(v, LANG_BUCKETS) for v in lang], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, b.column(5)], [c.split()[0] for c in FEATURES.split(", ")])

    order = F.xxhash64("doc_id", text_hash())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), order.alias("order"), *_inputs(docs)).mapInArrow(run, FEATURES)


def _inputs(docs: DataFrame) -> list:
    """text and the metadata columns; one that docs lacks is null."""
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    there = lambda c, t: readable(c) if t == "string" else F.col(c).cast(t)
    return [(there(c, t) if c in docs.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()]


def _matrices(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Text and metadata features of rows (x, source, lang, size)."""
    x, source, lang, size = zip(*rows, strict=True) if rows else [[]] * 4
    return _unpack(list(x)), metadata_features(np.array(source), np.array(lang), np.array([math.nan if n is None else n for n in size]))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS) -> Views:
    """fit() over the features of docs, written first, for every round reads them."""
    return fit(materialise(features(docs), "cotraining-features"), labels, target, fit_rows)


def fit(found: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, handed: int = HANDED) -> Views:
    """Views fitted on at most fit_rows labelled rows, and on rows handed over from all unlabelled ones.

    found has the columns of FEATURES, and should be written. Every round scores
    every unlabelled row; a task keeps its surest, and the driver gets the
    surest of all, some hundreds.
    """
    known = materialise(samples.labels(labels, target), "cotraining-labels")
    sample = samples.bounded(found.join(samples.some(known, fit_rows), "doc_id"), fit_rows).select("x", "source", "lang", "size", "y").collect()
    pool = materialise(found.join(known, "doc_id", "left_anti"), "cotraining-pool")
    text, metadata = _matrices([tuple(r)[:4] for r in sample])
    held = np.arange(len(sample)) < HELD_OUT * len(sample)  # rows come in the order of a hash

    def surest(views: Views, good: int, bad: int, taken: set[int]) -> Surest:
        model, gone = views, np.array(sorted(taken), np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                free = np.flatnonzero(~np.isin(b.column("order").to_numpy(), gone))
                b = b.take(pa.array(free))
                order = b.column("order").to_numpy()
                x, m = _matrices(list(zip(*(b.column(c).to_pylist() for c in ("x", "source", "lang", "size")), strict=True)))
                p = model.scores(x, m)
                for v, label, at in top(p, order, good, bad):
                    away = 1 - p[at, v] if label else p[at, v]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v), pa.int32()), pa.array(np.full(len(at), label), pa.int32()), pa.array(away), *(b.column(c).take(pa.array(at)) for c in ("order", "x", "source", "lang", "size"))], ["view", "label", "away", "order", "x", "source", "lang", "size"])

        each = pool.mapInArrow(run, "view int, label int, away double, order long, x binary, source int, lang int, size long")
        place = F.row_number().over(Window.partitionBy("view", "label").orderBy("away", "order"))
        best = each.withColumn("place", place).where(F.col("place") <= max(good, bad)).where(F.col("place") <= F.when(F.col("label") == 1, good).otherwise(bad)).collect()
        out: Surest = {}
        for v in range(2):
            for label in (1, 0):
                rows = [r for r in best if (r["view"], r["label"]) == (v, label)]
                out[(v, label)] = (np.array([r["order"] for r in rows], np.int64), *_matrices([(r["x"], r["source"], r["lang"], r["size"]) for r in rows]))
        return out

    views, _ = co_train(text, metadata, np.array([r["y"] for r in sample], np.float64), held, surest, rounds, handed)
    return views


def score(docs: DataFrame, views: Views, threshold: float = THRESHOLD) -> DataFrame:
    """score_features() of docs' features."""
    return score_features(features(docs), views, threshold)


def score_features(found: DataFrame, views: Views, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, metadata_score, score and kept (score >= threshold) of every row of found (see FEATURES).

    Null, empty and blank texts have statistics of zero and are judged by them;
    null or missing metadata is a value of its own. Repeated rows each get a row;
    a null doc_id stays null; columns of the documents other than doc_id, text,
    source, lang and n_chars are ignored; an empty table gives no rows. Without
    labels every score is the share of good ones, a half where there are none.
    """
    model = found.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = _matrices(list(zip(*(b.column(c).to_pylist() for c in ("x", "source", "lang", "size")), strict=True)))
            p = model.value.scores(x, m)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, i]) for i in range(3)), pa.array(p[:, 2] >= threshold)], ["doc_id", "text_score", "metadata_score", "score", "kept"])

    return found.mapInArrow(run, "doc_id long, text_score double, metadata_score double, score double, kept boolean")


def passes(docs: DataFrame, views: Views, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches threshold; odd rows as in score()."""
    model = docs.sparkSession.sparkContext.broadcast(views)

    @F.pandas_udf("boolean")
    def kept(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        x = _unpack([_pack(text_features(t)) for t in text])
        buckets = (np.array([_bucket(v, n) for v in c], np.int64) for c, n in ((source, SOURCE_BUCKETS), (lang, LANG_BUCKETS)))
        return pd.Series(model.value.scores(x, metadata_features(*buckets, n_chars.to_numpy(np.float64, na_value=np.nan)))[:, 2] >= threshold)

    return docs.where(kept(*_inputs(docs)))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(features(table(spark, sf_dir, "documents")), "cotraining-features")
    return score_features(found, fit(found, table(spark, sf_dir, "labels")))
