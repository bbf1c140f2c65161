"""Scalar function families."""

from __future__ import annotations

from suite.registry import register, register_sql
from weftline.functions import dialect
from weftline.session import load_views

register_sql(
    "scl01_split_part",
    "part customer",
    """SELECT p_partkey AS k, split_part(p_brand, '#', 2) AS a, split_part(p_name, ' ', -1) AS b,
              split_part(p_name, ' ', 9) AS c FROM part
       UNION ALL SELECT c_custkey, split_part(c_name, '#', 1), split_part(c_name, '#', -2), '' FROM customer""",
)
register_sql(
    "scl02_text",
    "customer documents",
    """SELECT c_custkey AS k, lower(c_name) AS a, upper(substr(c_name, 3, 6)) AS b, c_mktsegment || '/' || c_name AS c,
              cast(length(c_name) AS BIGINT) AS n FROM customer
       UNION ALL
       SELECT doc_id, lower(text), substr(text, 12, 2), trim(lang) || '-' || source, cast(length(text) AS BIGINT) FROM documents""",
)
register_sql(
    "scl03_round",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, round(cast(l_linenumber AS DOUBLE) / 3, 2) AS third,
              round(l_extendedprice / 1048576.0, 4) AS mb, round(cast(l_orderkey AS DOUBLE) / 7) AS whole FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, round(cast(l_linenumber AS DOUBLE) / 3, 2) AS third,
              round(l_extendedprice / cast(1048576.0 AS DOUBLE), 4) AS mb, round(cast(l_orderkey AS DOUBLE) / 7) AS whole FROM lineitem""",
)


@register(
    "scl04_strftime",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:00') AS hour, strftime(ts, '%Y/%j %H:%M:%S') AS stamp,
              strftime(ts, '%H') AS h FROM events""",
)
def scl04(spark, folder):
    dialect.install(spark)
    load_views(spark, folder, "events")
    return spark.sql(
        """SELECT event_id, strftime(ts, '%Y-%m-%d %H:00') AS hour, strftime(ts, '%Y/%j %H:%M:%S') AS stamp,
                  strftime(ts, '%H') AS h FROM events"""
    )


@register(
    "scl05_trunc_epoch",
    """SELECT event_id, date_trunc('minute', ts) AS minute, date_trunc('hour', ts) AS hour, date_trunc('month', ts) AS month,
              epoch(ts) AS seconds, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter FROM events""",
)
def scl05(spark, folder):
    dialect.install(spark)
    load_views(spark, folder, "events")
    return spark.sql(
        """SELECT event_id, date_trunc('minute', ts) AS minute, date_trunc('hour', ts) AS hour,
                  date_trunc('month', ts) AS month, epoch(ts) AS seconds, time_bucket(900, ts) AS quarter FROM events"""
    )


register_sql(
    "scl06_regexp_extract",
    "pages customer",
    r"""SELECT page_id AS k, regexp_extract(url, '^([a-z]+)://([^/]+)/?(.*)$', 2) AS a,
               regexp_extract(url, '([0-9]+)', 1) AS b FROM pages
        UNION ALL SELECT c_custkey, regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1), regexp_extract(c_name, 'x(y)z', 1) FROM customer""",
)
register_sql(
    "scl07_math",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, cast(ceil(l_quantity / 7) AS BIGINT) AS c,
              cast(floor(l_extendedprice / 1000) AS BIGINT) AS f, round(sqrt(l_extendedprice), 6) AS s,
              round(power(l_quantity, 1.5), 4) AS p, round(ln(l_extendedprice), 8) AS l, round(log2(l_quantity), 8) AS l2,
              round(log10(l_quantity), 8) AS l10, l_orderkey % 13 AS m, greatest(l_quantity, l_linenumber * 10) AS g,
              least(l_quantity, l_linenumber * 10) AS e, try_divide(l_quantity, l_discount) AS d
       FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, cast(ceil(l_quantity / 7) AS BIGINT) AS c,
              cast(floor(l_extendedprice / 1000) AS BIGINT) AS f, round(sqrt(l_extendedprice), 6) AS s,
              round(power(l_quantity, 1.5), 4) AS p, round(ln(l_extendedprice), 8) AS l, round(log2(l_quantity), 8) AS l2,
              round(log10(l_quantity), 8) AS l10, l_orderkey % 13 AS m, greatest(l_quantity, l_linenumber * 10) AS g,
              least(l_quantity, l_linenumber * 10) AS e, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS d
       FROM lineitem""",
)
register_sql(
    "scl08_dates",
    "orders",
    """SELECT o_orderkey, cast(datediff(day, TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS BIGINT) AS days,
              o_orderdate + INTERVAL 10 DAY AS due, cast(dayofweek(o_orderdate) - 1 AS BIGINT) AS dow,
              cast(hour(o_orderdate) AS BIGINT) AS h, cast(year(o_orderdate) AS BIGINT) AS y,
              cast(month(o_orderdate) AS BIGINT) AS m, cast(last_day(o_orderdate) AS DATE) AS month_end FROM orders""",
    """SELECT o_orderkey, cast(date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS BIGINT) AS days,
              o_orderdate + INTERVAL 10 DAY AS due, cast(dayofweek(o_orderdate) AS BIGINT) AS dow,
              cast(hour(o_orderdate) AS BIGINT) AS h, cast(year(o_orderdate) AS BIGINT) AS y,
              cast(month(o_orderdate) AS BIGINT) AS m, cast(last_day(o_orderdate) AS DATE) AS month_end FROM orders""",
)
register_sql(
    "scl09_json",
    "events",
    """SELECT event_id, cast(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k AS k2,
              array_join(json_object_keys(props), ',') AS ks, get_json_object(props, '$.absent') AS absent FROM events""",
    """SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k,
              (from_json(props, '{"k":"BIGINT"}')).k AS k2, array_to_string(json_keys(props), ',') AS ks,
              json_extract_string(props, '$.absent') AS absent FROM events""",
)
register_sql(
    "scl10_arrays",
    "embeddings",
    """SELECT vec_id, 'all' AS what, cast(size(embedding) AS BIGINT) AS n, round(cast(array_max(embedding) AS DOUBLE), 6) AS v,
              array_contains(transform(embedding, x -> x > 0), true) AS flag FROM embeddings
       UNION ALL
       SELECT vec_id, 'each', pos, round(cast(x AS DOUBLE), 6), x > 0
       FROM (SELECT vec_id, posexplode(sort_array(embedding)) AS (pos, x) FROM embeddings)""",
    """SELECT vec_id, 'all' AS what, cast(len(embedding) AS BIGINT) AS n, round(cast(list_max(embedding) AS DOUBLE), 6) AS v,
              list_contains(list_transform(embedding, lambda x: x > 0), true) AS flag FROM embeddings
       UNION ALL
       SELECT vec_id, 'each', pos - 1, round(cast(x AS DOUBLE), 6), x > 0
       FROM (SELECT vec_id, unnest(list_sort(embedding)) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) t""",
)
register_sql(
    "scl11_map_struct",
    "events",
    """SELECT event_id, s.kind AS kind, s.user.id AS user_id, element_at(m, 'value') AS value, try_element_at(m, 'none') AS absent
       FROM (SELECT event_id, named_struct('kind', event_type, 'user', named_struct('id', user_id)) AS s,
                    map_from_entries(array(struct('value' AS k, value AS v), struct('double' AS k, value * 2 AS v))) AS m FROM events)""",
    """SELECT event_id, s.kind AS kind, s."user".id AS user_id, m['value'] AS value, m['none'] AS absent
       FROM (SELECT event_id, {'kind': event_type, 'user': {'id': user_id}} AS s,
                    map_from_entries([('value', value), ('double', value * 2)]) AS m FROM events) t""",
)
