"""Chart series and layouts, over hourly and daily counts of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import register
from weftline import Workspace
from weftline.operators import plotdata
from weftline.session import load, load_views


def _daily(spark, folder):
    load_views(spark, folder, "events")
    return spark.sql(
        """SELECT date_format(ts, 'yyyy-MM-dd') AS day, count(*) AS n, cast(sum(cast(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
                  count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1"""
    )


_DAILY = """d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, cast(sum(cast(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
                         count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1),
     s AS (SELECT 0 AS series_no, 'n' AS series, row_number() OVER (ORDER BY day) - 1 AS ord, day AS x, cast(n AS DOUBLE) AS y FROM d
           UNION ALL SELECT 1, 'errors', row_number() OVER (ORDER BY day) - 1, day, cast(errors AS DOUBLE) FROM d)"""


@register("plt01_series", f"WITH {_DAILY} SELECT cast(series_no AS INT) AS series_no, series, ord, x, y FROM s")
def plt01(spark, folder):
    return plotdata.plot_series(_daily(spark, folder), "day", ["n", "errors"], order=["day"])


@register(
    "plt01_series_expression",
    """SELECT series, ord, x, y FROM (
         SELECT 'scaled' AS series, row_number() OVER (ORDER BY event_id) - 1 AS ord, cast(event_id AS VARCHAR) AS x, value * 2 AS y FROM events
         UNION ALL SELECT 'kind', row_number() OVER (ORDER BY event_id) - 1, cast(event_id AS VARCHAR), 0.0 FROM events
         UNION ALL SELECT 'hole', row_number() OVER (ORDER BY event_id) - 1, cast(event_id AS VARCHAR), CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END FROM events) t""",
)
def plt01_expression(spark, folder):
    events = load(spark, folder, "events")
    ys = ["value * 2 AS scaled", "event_type AS kind", "CASE WHEN event_id % 2 = 0 THEN value END AS hole"]
    return plotdata.plot_series(events, "event_id", ys, limit=None, order=["event_id"]).drop("series_no")


@register(
    "plt02_bar_layout",
    f"""WITH {_DAILY}, m AS (SELECT greatest(max(y), 0) AS top, least(max(strlen(x)), 20) AS w FROM s)
        SELECT series, ord, substr(x, 1, w) AS label, cast(floor(greatest(y / top * greatest(80 - w - 12, 0), 0)) AS INT) AS len,
               round(y, 1) AS value FROM s, m""",
)
def plt02(spark, folder):
    series = plotdata.plot_series(_daily(spark, folder), "day", ["n", "errors"], order=["day"])
    return plotdata.bar_layout(series, 80)


@register(
    "plt03_line_layout",
    f"""WITH {_DAILY}, m AS (SELECT min(y) AS lo, max(y) - min(y) AS spread FROM s), k AS (SELECT series_no, count(*) AS n FROM s GROUP BY 1),
            c AS (SELECT cast(17 - least(floor((y - lo) / spread * 17), 17) AS INT) AS "row", cast(ord * 71 // (n - 1) AS INT) AS col, s.series_no, ord
                  FROM s JOIN k ON s.series_no = k.series_no, m)
        SELECT "row", col, CASE WHEN max(series_no) = 0 THEN '●' ELSE '○' END AS marker FROM c GROUP BY "row", col""",
)
def plt03(spark, folder):
    series = plotdata.plot_series(_daily(spark, folder), "day", ["n", "errors"], order=["day"])
    return plotdata.line_layout(series, 80, 20)


@register(
    "plt03_line_all_points",
    """WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS ord, value AS y FROM events),
            m AS (SELECT min(y) AS lo, max(y) - min(y) AS spread, count(*) AS n FROM s)
       SELECT DISTINCT cast(17 - least(floor((y - lo) / spread * 17), 17) AS INT) AS "row", cast(ord * 71 // (n - 1) AS INT) AS col, '●' AS marker FROM s, m""",
)
def plt03_all(spark, folder):
    series = plotdata.plot_series(load(spark, folder, "events"), "event_id", ["value"], limit=None, order=["event_id"])
    return plotdata.line_layout(series, 80, 20)


@register(
    "plt03_line_axis",
    f"""WITH {_DAILY}, m AS (SELECT min(y) AS lo, max(y) AS hi FROM s)
        SELECT cast(i AS INT) AS "row", round(hi - (i / 17.0) * (hi - lo), 1) AS label FROM range(18) AS r(i), m""",
)
def plt03_axis(spark, folder):
    series = plotdata.plot_series(_daily(spark, folder), "day", ["n", "errors"], order=["day"])
    return plotdata.line_axis(series, 20)


@register(
    "plt04_multi_axis",
    f"""WITH {_DAILY} SELECT series, ord, round((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w), 9) AS scaled FROM s WINDOW w AS (PARTITION BY series)""",
)
def plt04(spark, folder):
    series = plotdata.plot_series(_daily(spark, folder), "day", ["n", "errors"], order=["day"])
    return plotdata.scaled_series(series).select("series", "ord", F.round("scaled", 9).alias("scaled"))


@register("plt_node_chart", f"WITH {_DAILY} SELECT cast(series_no AS INT) AS series_no, series, ord, x, y FROM s")
def plt_node(spark, folder):
    ws = Workspace(spark)
    load_views(spark, folder, "events")
    ws.sql(
        """SELECT date_format(ts, 'yyyy-MM-dd') AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors
           FROM events GROUP BY 1 ORDER BY 1""",
        name="daily",
    )
    return ws.plot("line", "daily", "day", "n", "errors", order=["day"])
