"""What a source of sessions has to offer, and the one over transcript files."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources import load, transcripts


class SourceAdapter(Protocol):
    """A source: its id, what of sessions it can tell, and jobs over its files."""

    id: str
    capabilities: frozenset[str]

    def discover(self, spark: SparkSession, root: str) -> DataFrame:
        """Files below root: uri, project, session_id, size, mtime."""

    def scan(self, spark: SparkSession, root: str, store: str) -> DataFrame:
        """Load what changed into store; what was done with each file."""

    def validate(self, spark: SparkSession, root: str) -> DataFrame:
        """What is wrong below root: session_id, line_no, level, note."""


@dataclass(frozen=True)
class Transcripts:
    id: str = "transcripts"
    capabilities: frozenset[str] = frozenset({"prompts", "model_requests", "tool_calls", "file_activity", "command_runs", "verification_runs", "compactions"})
    excluded: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    def discover(self, spark: SparkSession, root: str) -> DataFrame:
        return transcripts.discover(spark, root, excluded=list(self.excluded))

    def scan(self, spark: SparkSession, root: str, store: str) -> DataFrame:
        return load.scan(spark, root, store, excluded=list(self.excluded), **self.options)

    def validate(self, spark: SparkSession, root: str) -> DataFrame:
        return transcripts.diagnostics(transcripts.parse(transcripts.read_lines(spark, root)))


def scan_all(spark: SparkSession, sources: list[tuple[SourceAdapter, str]], store: str) -> DataFrame:
    """Every source (adapter and root) into a store of its own below store; what was done with each file, by source_id."""
    out = None
    for adapter, root in sources:
        done = adapter.scan(spark, root, f"{store}/{adapter.id}").withColumn("source_id", F.lit(adapter.id))
        out = done if out is None else out.unionByName(done)
    return out
