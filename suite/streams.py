"""Incremental ingest and streaming counts, fed from files of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import register
from weftline.session import load, scratch_path
from weftline.streaming.ingest import drain_to, into_incremental, stream_bucket_counts


@register(
    "str01_incremental",
    "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type",
)
def str01(spark, folder):
    events = load(spark, folder, "events")
    arriving, state = scratch_path(spark, "arriving"), scratch_path(spark, "state")
    table = "weftline_" + state.rsplit("-", 1)[1]
    put = {"table": table, "directory": arriving, "schema": events.schema, "checkpoint": state, "location": scratch_path(spark, "tables")}
    # two deliveries, then a run with nothing new
    for late in (0, 1):
        events.where(F.col("event_id") % 2 == late).repartition(2).write.mode("append").parquet(arriving)
        into_incremental(spark, **put)
    if into_incremental(spark, **put).rows:
        raise AssertionError("a run without new files must add nothing")
    return spark.table(table).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@register(
    "str02_bucket_counts",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2
       HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""",
)
def str02(spark, folder):
    events = load(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    counts = stream_bucket_counts(stream, "ts", "1 hour", ["event_type"], "30 minutes")
    out = scratch_path(spark, "closed")
    drain_to(counts, out, scratch_path(spark, "state"))
    return spark.read.schema(counts.schema).parquet(out)
