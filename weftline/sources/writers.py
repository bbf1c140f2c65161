"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Export format names and their Spark writers.
WRITERS = {"csv": "csv", "jsonl": "json", "parquet": "parquet"}


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error", compression: str | None = None) -> str:
    """Write the whole result below ``path``, one file per partition."""
    if fmt not in WRITERS:
        raise ValueError(f"unknown export format {fmt!r}; one of {', '.join(WRITERS)}")
    writer = df.write.format(WRITERS[fmt]).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
        # else values lose the blanks at their ends
        writer = writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    if compression:
        writer = writer.option("compression", compression)
    writer.save(path)
    return path
