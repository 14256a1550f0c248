"""Figures with what they rest on: struct<value, provenance, note, confidence>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("exact", "reported", "inferred", "estimated", "heuristic", "unknown")


def figure(value: Column, provenance: str | Column, note: Column | str | None = None, confidence: float | None = None) -> Column:
    """A figure; where the value is null its provenance is unknown."""
    if isinstance(provenance, str) and provenance not in KINDS:
        raise ValueError(f"provenance is one of {KINDS}")
    kind = F.lit(provenance) if isinstance(provenance, str) else provenance
    return F.struct(value.cast("double").alias("value"), F.when(value.isNull(), "unknown").otherwise(kind).alias("provenance"), (F.lit(note) if note is None or isinstance(note, str) else note).cast("string").alias("note"), F.lit(confidence).cast("double").alias("confidence"))


def by_coverage(value: Column, known: Column, all_of: Column, of: str) -> Column:
    """A figure over the rows that state something: exact if all do, inferred with a note if some do, unknown if none."""
    kind = F.when(known == 0, "unknown").when(known < all_of, "inferred").otherwise("exact")
    note = F.when((known > 0) & (known < all_of), F.concat(known.cast("string"), F.lit(" of "), all_of.cast("string"), F.lit(f" {of}")))
    return figure(F.when(known > 0, value), kind, note)
