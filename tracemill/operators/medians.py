"""Exact medians of groups of any size and any spread of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Of the quantile sketch: a rank is off by one in so many rows at most; and how many such errors the bracket keeps from the middle on both sides.
ACCURACY, MARGIN = 10_000, 8


def bracketed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, value): keys, value and times for the values near each group's middle, one row of -infinity for all below them, and n, the group's values.

    A quantile sketch of each group, merged from those of the tasks, says between
    which two values the middle ranks lie for certain. So many rows lie between
    them as the sketch's error allows, wherever they are: an outlier moves no
    bound. Equal values are one row.
    """
    ends = [0.5 - MARGIN / ACCURACY, 0.5 + MARGIN / ACCURACY]
    bounds = rows.groupBy(*keys).agg(F.percentile_approx("value", ends, ACCURACY).alias("_ends"), F.count(F.lit(1)).alias("n"))
    low, high = F.col("_ends")[0], F.col("_ends")[1]
    near = _join(rows, bounds, keys).where(F.col("value") <= high).withColumn("value", F.when(F.col("value") < low, F.lit(float("-inf"))).otherwise(F.col("value")))
    return near.groupBy(*keys, "n", "value").agg(F.count(F.lit(1)).alias("times"))


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median", upper: bool = False) -> DataFrame:
    """keys, the exact median of value and n, the number of values, of each group; nulls are no values.

    Of an even number the two middle values' mean is taken, or with upper the
    larger one. Only the values near the middle (see bracketed) are put in order.
    Null keys are groups too.
    """
    near = bracketed(rows.select(*keys, F.col(value).cast("double").alias("value")).where("value is not null"), keys)
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = near.withColumn("last", F.sum("times").over(upto))
    low, high = F.floor((F.col("n") + (2 if upper else 1)) / 2), F.floor(F.col("n") / 2) + 1
    first = F.col("last") - F.col("times") + 1
    at = lambda rank: F.max(F.when((first <= rank) & (F.col("last") >= rank), F.col("value")))
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name), F.max("n").alias("n"))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(r, met).drop(*(f"__{k}" for k in keys))


def attach(groups: DataFrame, rows: DataFrame, key: str, **names: str) -> DataFrame:
    """groups (by key, null for all) with the exact medians of rows' columns: name=column. All columns, of groups and of all rows, take one pass."""
    own, every = F.col(key), F.lit(None).cast(rows.schema[key].dataType)
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value")) for name, c in names.items()))
    long = rows.select(F.when(own.isNull(), F.array(every)).otherwise(F.array(own, every)).alias("ks"), F.explode(each).alias("r"))
    found = medians(long.select(F.explode("ks").alias("_k"), F.col("r.name").alias("_name"), "r.value"), ["_k", "_name"], "value")
    wide = found.groupBy("_k").agg(*(F.max(F.when(F.col("_name") == name, F.col("median"))).alias(name) for name in names))
    return groups.join(wide, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
