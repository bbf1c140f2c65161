"""End-to-end analyst queries on stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import register, register_sql
from weftline import Workspace
from weftline.functions import dialect
from weftline.operators import relational as rel
from weftline.operators import stats
from weftline.operators.timeseries import bucket_start
from weftline.session import load, load_views, scratch_path
from weftline.sources.readers import parse_regex


@register(
    "rcp01_top_sources",
    """SELECT user_id AS source, count(*) AS attempts, count(DISTINCT event_type) AS kinds
       FROM events GROUP BY user_id ORDER BY attempts DESC, source LIMIT 20""",
)
def rcp01(spark, folder):
    ws = Workspace(spark)
    load(spark, folder, "events").createOrReplaceTempView("events")
    return ws.sql(
        """SELECT user_id AS source, count(*) AS attempts, count(DISTINCT event_type) AS kinds
           FROM events GROUP BY user_id ORDER BY attempts DESC, source LIMIT 20""",
        name="top_sources",
    )


register_sql(
    "rcp02_top_kinds",
    "events",
    """SELECT event_type, count(*) AS attempts, count(DISTINCT user_id) AS sources
       FROM events GROUP BY event_type ORDER BY attempts DESC, event_type LIMIT 20""",
)


@register(
    "rcp03_hourly_attempts",
    "SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(*) AS attempts FROM events GROUP BY 1 ORDER BY 1",
)
def rcp03(spark, folder):
    dialect.install(spark)
    load_views(spark, folder, "events")
    return spark.sql("SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(*) AS attempts FROM events GROUP BY 1 ORDER BY 1")


register_sql(
    "rcp04_folder_sizes",
    "documents",
    """SELECT source AS folder, count(*) AS files, cast(sum(cast(n_chars AS BIGINT)) AS BIGINT) AS chars,
              round(cast(sum(n_chars) AS DOUBLE) / cast(1048576 AS DOUBLE), 1) AS size_mb
       FROM documents GROUP BY source ORDER BY chars DESC, folder LIMIT 20""",
)
register_sql(
    "rcp05_size_ladder",
    "documents",
    # fixed values: the size ladder of the recipe
    """SELECT CASE WHEN n_chars < 1024 THEN '<1KB' WHEN n_chars < 10240 THEN '1-10KB'
                   WHEN n_chars < 102400 THEN '10-100KB' WHEN n_chars < 1048576 THEN '100KB-1MB'
                   WHEN n_chars < 10485760 THEN '1-10MB' ELSE '>10MB' END AS size_bucket,
              count(*) AS files, min(n_chars) AS least
       FROM documents GROUP BY 1 ORDER BY min(n_chars)""",
)


@register(
    "rcp06_recent",
    """SELECT event_id, event_type, ts, round(value / 1024.0, 6) AS kb FROM events
       WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY ts DESC, event_id LIMIT 50""",
)
def rcp06(spark, folder):
    events = load(spark, folder, "events")
    as_of = events.agg(F.max("ts")).head()[0]
    recent = events.where(F.col("ts") > F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAY"))
    return recent.orderBy(F.desc("ts"), "event_id").limit(50).select(
        "event_id", "event_type", "ts", F.round(F.col("value") / F.lit(1024.0), 6).alias("kb")
    )


register_sql(
    "rcp07_states",
    "orders",
    "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY state ORDER BY n DESC, state",
)
register_sql(
    "rcp08_remote_hosts",
    "pages",
    """SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS pages FROM pages
       WHERE url LIKE 'http%' GROUP BY 1 ORDER BY pages DESC, host LIMIT 20""",
)
register_sql(
    "rcp09_open_orders",
    "orders",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey",
)
register_sql(
    "rcp10_by_prefix",
    "customer",
    """SELECT split_part(c_name, '#', 1) || ':' || c_mktsegment AS source, count(*) AS n FROM customer
       GROUP BY 1 ORDER BY n DESC, source LIMIT 20""",
)
register_sql(
    "rcp11_errors",
    "documents",
    # fixed values: the patterns of the recipe
    """SELECT doc_id, source, n_chars FROM documents
       WHERE lower(text) LIKE '%error%' OR lower(text) LIKE '%fail%' OR lower(text) LIKE '%crit%'
       ORDER BY doc_id DESC LIMIT 100""",
)


@register(
    "rcp12_incident",
    """SELECT 'by_minute' AS part, cast(date_trunc('minute', ts) AS VARCHAR) AS label, count(*) AS n
       FROM events WHERE event_type = 'error' GROUP BY 2
       UNION ALL
       SELECT * FROM (SELECT 'top_users', cast(user_id AS VARCHAR) AS label, count(*) AS n FROM events
                      WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, label LIMIT 10) t""",
)
def rcp12(spark, folder):
    ws = Workspace(spark)
    load_views(spark, folder, "events")
    ws.sql("SELECT * FROM events WHERE event_type = 'error'", name="errors")
    minutes = ws.sql("SELECT date_trunc('minute', ts) AS at, count(*) AS n FROM errors GROUP BY 1", name="by_minute")
    users = rel.top_n(
        ws.table("errors").withColumn("label", F.col("user_id").cast("string")), "label", F.count(F.lit(1)), 10, "n"
    )
    return minutes.select(
        F.lit("by_minute").alias("part"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("label"), "n"
    ).union(users.select(F.lit("top_users"), "label", "n"))


@register(
    "rcp13_latency",
    """SELECT date_trunc('hour', ts) AS hour, round(quantile_cont(value, 0.50), 6) AS p50,
              round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
       FROM events GROUP BY 1""",
)
def rcp13(spark, folder):
    events = load(spark, folder, "events").select(bucket_start("ts", "1 hour").alias("hour"), "value")
    named = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    out = stats.percentile_columns(events, "value", named, ["hour"])
    return out.select("hour", *[F.round(c, 6).alias(c) for c in named])


@register(
    "rcp14_log_import",
    """SELECT 'source' AS part, cast(user_id AS VARCHAR) AS label, n FROM (
         SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id) a
       UNION ALL
       SELECT 'hour', strftime(ts, '%H'), count(*) FROM events WHERE event_type IN ('error', 'click') GROUP BY 2""",
)
def rcp14(spark, folder):
    # log lines written to files, then read back through a pattern
    path = scratch_path(spark, "log")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit(" host kernel: SRC="), F.col("user_id").cast("string"),
        F.lit(" KIND="), F.col("event_type"), F.lit(" VAL="), F.col("value").cast("string"),
    )
    load(spark, folder, "events").select(line.alias("value")).write.text(path)
    table, _ = parse_regex(
        spark.read.text(path), "value", r"^(\S+) .*SRC=([0-9]+).*KIND=(error|click)\b", ["ts", "src", "kind"]
    )
    by_source = table.groupBy(F.col("src").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    by_hour = table.groupBy(F.substring("ts", 12, 2).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return by_source.select(F.lit("source").alias("part"), "label", "n").union(
        by_hour.select(F.lit("hour"), "label", "n")
    )
