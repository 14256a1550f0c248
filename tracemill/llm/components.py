"""Connected components of a graph given as an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import discard, materialise


def _large_star(edges: DataFrame, label: str) -> DataFrame:
    """Every node sends its larger neighbours to the least node it knows."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), label)
    joined = both.join(least, "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, label: str) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), label)
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node that it reaches.

    edges has columns a and b of one orderable type. Rounds of large-star and
    small-star end when every node points at its root: about log(n) rounds. Each
    round is written to the shared folder, so its lineage stays short. Minima are
    aggregated before the shuffle, and the joins have one row per node on one
    side, so that a hub's rows can be split among tasks. Self-loops and repeated
    edges are harmless; no edges give no rows.
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        size, total = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if size == 0 or (size, total) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen, before = (size, total), now
        half = materialise(_large_star(now, label), label)
        now = materialise(_small_star(half, label), label)
        discard(before)
        discard(half)
