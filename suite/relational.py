"""Projection, filters, joins, aggregation, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from suite.registry import register, register_sql
from weftline.operators import relational as rel
from weftline.functions.names import micros
from weftline.functions.times import epoch_micros
from weftline.operators import sketches, stats, windows
from weftline.plans.ordered import framed, trailing_totals
from weftline.session import load, scratch_path

# --- projection ------------------------------------------------------------------

register_sql(
    "prj01_select_alias",
    "customer",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment FROM customer",
)
register_sql(
    "prj02_computed_literals",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS next_line, 'line' AS kind,
              round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem""",
)
register_sql(
    "prj03_case_ladder",
    "part",
    """SELECT CASE WHEN p_size < 5 THEN 'tiny' WHEN p_size < 15 THEN 'small'
                   WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
              count(*) AS parts, min(p_size) AS least
       FROM part GROUP BY 1 ORDER BY min(p_size)""",
)
register_sql(
    "prj04_safe_cast",
    "part",
    """SELECT p_partkey, CAST(p_size AS BIGINT) AS size_big,
              TRY_CAST(split_part(p_brand, '#', 2) AS INT) AS brand_no, TRY_CAST(p_type AS DOUBLE) AS never
       FROM part""",
)
register_sql(
    "prj05_cte_derived",
    "orders customer",
    """WITH spend AS (SELECT o_custkey, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
                      FROM orders GROUP BY o_custkey)
       SELECT c_mktsegment, count(*) AS customers, max(total) AS best
       FROM (SELECT c_mktsegment, s.total FROM customer JOIN spend s ON s.o_custkey = c_custkey) x
       GROUP BY c_mktsegment""",
)

# --- filters ------------------------------------------------------------------------

register_sql(
    "flt01_compare",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE (l_quantity >= 45 AND l_discount < 0.03) OR (l_returnflag = 'R' AND l_quantity = 1)""",
)
register_sql(
    "flt02_like",
    "part",
    """SELECT p_partkey, p_name FROM part
       WHERE p_name LIKE 'red%' OR lower(p_name) LIKE '%bolt' OR p_type ILIKE 'eco%'""",
)
register_sql(
    "flt03_relative_time",
    "events",
    """SELECT event_id, ts FROM events
       WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY""",
    """SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY""",
)
register_sql(
    "flt04_regex",
    "pages",
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages
        WHERE url RLIKE '^https?://'""",
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages
        WHERE regexp_matches(url, '^https?://')""",
)
register_sql(
    "flt05_in_exists",
    "customer orders nation",
    """SELECT c_custkey FROM customer
       WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))
         AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
         AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)""",
)

# --- joins ----------------------------------------------------------------------------

register_sql(
    "joi01_inner",
    "customer orders",
    "SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey",
)
register_sql(
    "joi02_outer",
    "customer orders",
    """SELECT c.c_custkey, o.o_orderkey, 'left' AS side
       FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c.c_custkey = o.o_custkey
       UNION ALL
       SELECT c.c_custkey, o.o_orderkey, 'right'
       FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey
       UNION ALL
       SELECT c.c_custkey, o.o_orderkey, 'full'
       FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c
       FULL OUTER JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c.c_custkey = o.o_custkey""",
)


@register(
    "joi03_semi_anti",
    """SELECT c_custkey, 'has' AS orders FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
       UNION ALL
       SELECT c_custkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
)
def joi03(spark, folder):
    customer, orders = load(spark, folder, "customer"), load(spark, folder, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    has = customer.join(orders, on, "left_semi").select("c_custkey", F.lit("has").alias("orders"))
    none = customer.join(orders, on, "left_anti").select("c_custkey", F.lit("none").alias("orders"))
    return has.union(none)


# the operator itself is the product of two lists; both are fixed dimensions here
register_sql(
    "joi04_cross",
    "region nation",
    """SELECT a.r_name, b.n_name, a.r_regionkey = b.n_regionkey AS own
       FROM region a CROSS JOIN nation b
       UNION ALL
       SELECT a.r_name, b.n_name, a.r_regionkey = b.n_regionkey FROM region a, nation b""",
)


@register(
    "joi05_range",
    """SELECT e.event_id, o.o_orderkey
       FROM (SELECT event_id, cast(floor(value * 1000) AS BIGINT) AS at FROM events) e
       JOIN (SELECT o_orderkey, cast(floor(o_totalprice) AS BIGINT) AS lo,
                    cast(floor(o_totalprice) AS BIGINT) + (o_orderkey % 7) * (o_orderkey % 5) AS hi FROM orders) o
         ON e.at BETWEEN o.lo AND o.hi""",
)
def joi05(spark, folder):
    points = load(spark, folder, "events").selectExpr("event_id", "cast(floor(value * 1000) AS BIGINT) AS at")
    ranges = load(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "cast(floor(o_totalprice) AS BIGINT) AS lo",
        "cast(floor(o_totalprice) AS BIGINT) + (o_orderkey % 7) * (o_orderkey % 5) AS hi",
    )
    return rel.range_join(points, ranges, "at", "lo", "hi").select("event_id", "o_orderkey")


@register(
    "joi05_fine",
    """SELECT e.event_id, o.o_orderkey
       FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE value - floor(value) END AS at FROM events) e
       JOIN (SELECT o_orderkey, lo, lo + (o_orderkey % 5) * 0.00001 AS hi
             FROM (SELECT o_orderkey, o_totalprice / 1000 - floor(o_totalprice / 1000) AS lo FROM orders)) o
         ON e.at BETWEEN o.lo AND o.hi""",
)
def joi05_fine(spark, folder):
    """Fractions, half of the points in one place."""
    points = load(spark, folder, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 2 = 0 THEN cast(0.5 AS DOUBLE) ELSE value - floor(value) END AS at"
    )
    ranges = load(spark, folder, "orders").selectExpr("o_orderkey", "o_totalprice / 1000 - floor(o_totalprice / 1000) AS lo")
    ranges = ranges.selectExpr("o_orderkey", "lo", "lo + (o_orderkey % 5) * cast(0.00001 AS DOUBLE) AS hi")
    return rel.range_join(points, ranges, "at", "lo", "hi").select("event_id", "o_orderkey")


_ASOF = """
    SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, v.value AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
      ON p.user_id = v.user_id AND p.ts >= v.ts"""


def _views_and_purchases(spark, folder):
    events = load(spark, folder, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.where("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value")
    )
    return bought, viewed


@register("joi06_asof", _ASOF)
def joi06(spark, folder):
    bought, viewed = _views_and_purchases(spark, folder)
    return rel.asof_join(bought, viewed, "ts", ["user_id"], right_on="view_ts")


@register(
    "joi06_asof_tolerance",
    f"""SELECT event_id, user_id, ts,
               CASE WHEN epoch_us(ts) - epoch_us(view_ts) <= 86400000000 THEN view_ts END AS view_ts,
               CASE WHEN epoch_us(ts) - epoch_us(view_ts) <= 86400000000 THEN view_value END AS view_value
        FROM ({_ASOF}) x""",
)
def joi06_tolerance(spark, folder):
    bought, viewed = _views_and_purchases(spark, folder)
    return rel.asof_join(bought, viewed, "ts", ["user_id"], right_on="view_ts", tolerance="1 day")


register_sql(
    "joi07_nested_lateral",
    "customer nation region orders",
    """SELECT c.c_custkey, g.r_name, t.n, t.top
       FROM (customer c JOIN (nation n JOIN region g ON n.n_regionkey = g.r_regionkey) ON c.c_nationkey = n.n_nationkey),
            LATERAL (SELECT count(*) AS n, max(o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) t""",
)

# --- aggregation --------------------------------------------------------------------------

register_sql(
    "agg01_group_count",
    "events",
    """SELECT event_type AS kind, count(*) AS n, 'ordinal' AS how FROM events GROUP BY 1
       UNION ALL SELECT event_type AS kind, count(*) AS n, 'by name' AS how FROM events GROUP BY kind
       UNION ALL SELECT event_type AS kind, count(*) AS n, 'rest' AS how FROM events GROUP BY ALL""",
)
register_sql(
    "agg02_sum_avg_min_max",
    "lineitem",
    """SELECT l_returnflag, l_linestatus,
              cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
              cast(sum(l_linenumber) AS BIGINT) AS line_sum, round(avg(l_quantity), 6) AS avg_qty,
              min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
register_sql(
    "agg03_count_distinct",
    "events",
    """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT cast(ts AS DATE)) AS days
       FROM events GROUP BY event_type""",
)


@register("agg03_approx_distinct")
def agg03_approx(spark, folder):
    return load(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.01).alias("orders")
    )


@register(
    "agg03_distinct_sketches",
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT cast(l_shipdate AS DATE)) AS days,
              true AS unions_agree, true AS within_bound FROM lineitem GROUP BY l_returnflag""",
)
def agg03_sketches(spark, folder):
    """Sketches kept per day, their union against that of the whole and the exact count."""
    items = load(spark, folder, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    path = scratch_path(spark, "distinct-sketches")
    sketches.distinct_sketches(items, "l_orderkey", ["l_returnflag", "day"]).write.parquet(path)
    daily = spark.read.parquet(path)
    union = sketches.merge_distinct_sketches(daily, ["l_returnflag"]).withColumnRenamed("sketch", "of_days")
    whole = sketches.distinct_sketches(items, "l_orderkey", ["l_returnflag"])
    exact = items.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("day").alias("days"))
    return exact.join(union, "l_returnflag").join(whole, "l_returnflag").select(
        "l_returnflag", "orders", "days", sketches.alike("of_days", "sketch").alias("unions_agree"),
        (F.abs(sketches.distinct_estimate("of_days") - F.col("orders")) <= sketches.DISTINCT_ERROR * F.col("orders")).alias("within_bound"),
    )


@register(
    "agg04_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
              round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
)
def agg04(spark, folder):
    named = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    out = stats.percentile_columns(load(spark, folder, "events"), "value", named, ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in named])


register_sql(
    "agg05_having_filter",
    "orders",
    """SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished
       FROM orders GROUP BY o_custkey HAVING count(*) > 8""",
)
register_sql(
    "agg06_rollup_cube",
    "lineitem",
    """SELECT 'rollup' AS how, l_returnflag, l_linestatus, cast(grouping(l_returnflag) AS INT) AS gf,
              cast(grouping(l_linestatus) AS INT) AS gs, count(*) AS n
       FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
       UNION ALL
       SELECT 'cube', l_returnflag, l_linestatus, cast(grouping(l_returnflag) AS INT),
              cast(grouping(l_linestatus) AS INT), count(*) FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
       UNION ALL
       SELECT 'sets', l_returnflag, l_linestatus, cast(grouping(l_returnflag) AS INT),
              cast(grouping(l_linestatus) AS INT), count(*) FROM lineitem
       GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
)


@register(
    "agg07_pivot",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click,
              count(*) FILTER (WHERE event_type = 'error') AS error,
              count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
              count(*) FILTER (WHERE event_type = 'signup') AS signup,
              count(*) FILTER (WHERE event_type = 'view') AS "view"
       FROM events GROUP BY user_id""",
)
def agg07(spark, folder):
    wide = rel.pivot(load(spark, folder, "events"), ["user_id"], "event_type", F.count(F.lit(1)))
    return wide.na.fill(0)


@register(
    "agg08_top_n",
    """SELECT p_brand, cast(sum(cast(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM part GROUP BY p_brand ORDER BY total DESC, p_brand LIMIT 10""",
)
def agg08(spark, folder):
    total = F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double")
    return rel.top_n(load(spark, folder, "part"), "p_brand", total, 10, "total")


@register(
    "agg09_top_n_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, cast(rn AS INT) AS rn FROM (
         SELECT o_custkey, o_orderkey, o_totalprice,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x
       WHERE rn <= 3""",
)
def agg09(spark, folder):
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.top_n_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


_SPREAD = """count(*) AS n, count(*) - count(x) AS nulls, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd,
             min(x) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median,
             round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max"""


@register(
    "agg10_group_stats",
    f"""SELECT event_type, {_SPREAD}
        FROM (SELECT event_type, CASE WHEN event_id % 10 <> 3 THEN value END AS x FROM events) e GROUP BY event_type""",
)
def agg10(spark, folder):
    events = load(spark, folder, "events").selectExpr(
        "event_type", "CASE WHEN event_id % 10 <> 3 THEN value END AS x"
    )
    out = stats.group_stats(events, ["event_type"], "x")
    rounded = ("mean", "sd", "q25", "median", "q75")
    return out.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in out.columns])


# --- windows --------------------------------------------------------------------------------

_RANKS = """SELECT o_orderkey, cast(row_number() OVER w AS BIGINT) AS row_number, cast(rank() OVER p AS BIGINT) AS rank,
              cast(dense_rank() OVER p AS BIGINT) AS dense_rank, round(percent_rank() OVER p, 9) AS percent_rank,
              round(cume_dist() OVER p, 9) AS cume_dist, cast(ntile(4) OVER w AS BIGINT) AS ntile
       FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey),
              p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)"""


@register("win01_ranks", _RANKS)
def win01(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out = windows.ranks(orders, ["o_custkey"], ["o_orderpriority"], ["o_orderkey"], ntile=4)
    return out.select(
        "o_orderkey", "row_number", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"),
        F.round("cume_dist", 9).alias("cume_dist"), "ntile",
    )


@register(
    "win02_neighbours_ends",
    """SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2) OVER w AS next2,
              first_value(o_orderkey) OVER v AS first_value, last_value(o_orderkey) OVER v AS last_value,
              nth_value(o_orderkey, 2) OVER v AS nth_value
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
            v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def win02(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    order = ["o_orderdate", "o_orderkey"]
    near = windows.neighbours(orders, ["o_custkey"], order, {"prev": ("o_totalprice", -1), "next2": ("o_totalprice", 2)})
    out = windows.ends(near, ["o_custkey"], order, "o_orderkey", nth=2)
    return out.select("o_orderkey", "prev", "next2", "first_value", "last_value", "nth_value")


@register(
    "win03_framed",
    """SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS ma,
              max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead,
              count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n
       FROM events""",
)
def win03(spark, folder):
    events = load(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    near = framed(
        events,
        ["event_type"],
        ["ts", "event_id"],
        lambda w: {"ma": F.avg("value").over(w.rowsBetween(-4, 0)), "ahead": F.max("value").over(w.rowsBetween(1, 3))},
        back=4,
        ahead=3,
    )
    ticked = near.withColumn("_tick", epoch_micros("ts"))
    out = trailing_totals(ticked, ["event_type"], "_tick", "event_id", back=micros("1 day"))
    return out.select("event_id", F.round("ma", 6).alias("ma"), "ahead", F.col("frame_count").alias("day_n"))


register_sql(
    "win01_ranking",
    "orders",
    """SELECT o_orderkey, cast(row_number() OVER w AS BIGINT) AS rn, cast(rank() OVER p AS BIGINT) AS rk,
              cast(dense_rank() OVER p AS BIGINT) AS dr, cast(ntile(4) OVER w AS BIGINT) AS quarter,
              round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd
       FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
              p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
)
register_sql(
    "win02_analytic",
    "orders",
    """SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2) OVER w AS next2,
              first_value(o_orderkey) OVER w AS first_key,
              last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key,
              nth_value(o_orderkey, 2) OVER w AS second_key
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
register_sql(
    "win03_frames",
    "events",
    """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS ma,
              count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n,
              max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead
       FROM events""",
)


@register(
    "win04_qualify",
    """SELECT event_id, user_id, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2""",
)
def win04(spark, folder):
    events = load(spark, folder, "events").select("event_id", "user_id", "value")
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return rel.qualify(events, F.row_number().over(order), "_q <= 2")


# --- sorting and limits ------------------------------------------------------------------------

register_sql(
    "srt01_order_by",
    "orders",
    """SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus
       ORDER BY sum(o_orderkey) DESC NULLS LAST, 2 ASC NULLS FIRST, status""",
)
register_sql(
    "srt02_top_k",
    "orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
)


@register(
    "srt03_preview",
    "SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id LIMIT 1000",
)
def srt03(spark, folder):
    from weftline import Workspace

    ws = Workspace(spark)
    load(spark, folder, "events").createOrReplaceTempView("events")
    ws.sql("SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id", name="ordered_events")
    return ws.preview("ordered_events", 1000)


# --- set operations ------------------------------------------------------------------------------

register_sql(
    "set01_union_all",
    "customer supplier",
    "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
)
register_sql(
    "set02_union",
    "lineitem orders",
    "SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 40 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
)
register_sql(
    "set03_intersect",
    "lineitem orders",
    """SELECT k, 'distinct' AS how FROM (SELECT l_orderkey AS k FROM lineitem INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') a
       UNION ALL
       SELECT k, 'all' FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45
                             INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_discount > 0.08) b""",
)
register_sql(
    "set04_except",
    "lineitem orders",
    """SELECT k, 'distinct' AS how FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') a
       UNION ALL
       SELECT k, 'all' FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 25
                             EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_discount > 0.05) b""",
)
