"""Which columns hold content, and tables without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a table of metadata only has no values in; hashes, sizes and classes stay.
CONTENT = {
    "prompts": ("content",), "tool_calls": ("path", "command", "failure_signature"), "file_activity": ("path",), "command_runs": ("command", "failure_signature"), "hook_events": ("payload_json",), "sessions": ("cwd",),
}


def gate(df: DataFrame, table: str, mode: str | Column = "metadata-only") -> DataFrame:
    """df without content where mode (one for all, or a column) is metadata-only."""
    hidden = (F.lit(mode) if isinstance(mode, str) else mode) == "metadata-only"
    return df.withColumns({c: F.when(~hidden, F.col(c)) for c in CONTENT.get(table, ()) if c in df.columns})
