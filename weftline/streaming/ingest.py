"""Incremental file ingest and windowed counts on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Ingested:
    """Progress of one run: rows of every non-empty batch."""

    batches: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(self.batches)


_KEPT = "spark.sql.streaming.numRecentProgressUpdates"


def _drain(spark: SparkSession, start: Callable[[], StreamingQuery]) -> Ingested:
    """Runs a query to its end, with the progress of every batch kept meanwhile."""
    before = spark.conf.get(_KEPT)
    spark.conf.set(_KEPT, str(2**31 - 1))
    try:
        query = start()
        query.awaitTermination()
    finally:
        spark.conf.set(_KEPT, before)
    return Ingested(tuple(p["numInputRows"] for p in query.recentProgress if p["numInputRows"]))


def into_incremental(
    spark: SparkSession,
    table: str,
    directory: str,
    schema: str | T.StructType,
    *,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    location: str | None = None,
    options: dict | None = None,
) -> Ingested:
    """Append the files that arrived in ``directory`` since the last run, once.

    ``checkpoint`` remembers what was read; running again with no new file adds
    nothing.  ``location`` puts the table's files at a path of your choice.
    """
    reader = spark.readStream.format(fmt).schema(schema).options(**(options or {}))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = (
        reader.load(directory)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if location:
        writer = writer.option("path", location)
    return _drain(spark, lambda: writer.toTable(table))


def stream_bucket_counts(
    stream: DataFrame, ts: str, width: str, keys: Sequence[str] = (), lateness: str = "0 seconds"
) -> DataFrame:
    """(bucket, keys, n): tumbling counts that close once the watermark passes.

    Rows later than ``lateness`` behind the newest time seen are dropped.  The
    state holds one count per open window and key, not the rows.
    """
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", lateness)
    counts = timed.groupBy(F.window("_at", width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), *keys, "n")


def drain_to(stream: DataFrame, path: str, checkpoint: str) -> Ingested:
    """Run a streaming result over everything available into Parquet files."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    return _drain(stream.sparkSession, writer.start)
