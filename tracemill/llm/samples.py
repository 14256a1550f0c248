"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import unit_interval

#: Of the bound, what is asked for: the number that a hash takes varies a little.
AIM = 0.9


def labels(table: DataFrame, target: str) -> DataFrame:
    """(doc_id, y): one label, 0 or 1, for each doc_id.

    A doc_id with several gets the more frequent one (1 in a tie); null labels
    and null ids are no labels.
    """
    known = table.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("y"))


def some(known: DataFrame, bound: int) -> DataFrame:
    """About bound labels of known, taken by a hash of their doc_id; few enough to be broadcast."""
    return F.broadcast(known.where(unit_interval("doc_id") < AIM * bound / max(known.count(), 1)))


def bounded(rows: DataFrame, bound: int) -> DataFrame:
    """At most bound rows, those first by their column order: a doc_id may have any number of rows. Rows should be small."""
    return rows.orderBy("order").limit(bound)
