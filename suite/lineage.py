"""Workspace verbs and lineage over a graph derived from ``part``:
every part key points at its half, so key 1 is the root of a binary tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import register
from weftline import Workspace
from weftline.plans import lineage
from weftline.session import load, load_views, scratch_path


def _graph(spark, folder):
    keys = load(spark, folder, "part").where("p_partkey >= 1").select("p_partkey", "p_name")
    nodes = keys.select(
        F.col("p_partkey").alias("name"),
        F.lit("query").alias("kind"),
        F.lit("UpToDate").alias("status"),
        F.concat(F.lit("SELECT * FROM n"), F.expr("p_partkey div 2")).alias("command"),
    )
    edges = keys.where("p_partkey >= 2").select(
        F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent")
    )
    return nodes, edges


_WALK = """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey >= 2),
     d AS (SELECT CAST({root} AS BIGINT) AS node, 0 AS depth
           UNION ALL SELECT e.{to}, depth + 1 FROM e JOIN d ON e.{frm} = d.node)"""
_DOWN = _WALK.format(root="{root}", to="child", frm="parent")


@register("lin04_descendants", _DOWN.format(root=3) + " SELECT node, cast(depth AS INT) AS depth FROM d WHERE depth > 0")
def lin04(spark, folder):
    return lineage.descendants(_graph(spark, folder)[1], 3)


@register(
    "lin04_ancestors",
    _WALK.format(root="(SELECT max(p_partkey) FROM part)", to="parent", frm="child")
    + " SELECT node, cast(depth AS INT) AS depth FROM d WHERE depth > 0",
)
def lin04_up(spark, folder):
    edges = _graph(spark, folder)[1]
    last = load(spark, folder, "part").agg(F.max("p_partkey")).head()[0]
    return lineage.ancestors(edges, last)


@register(
    "lin05_mark_dirty",
    _DOWN.format(root=2)
    + """ SELECT p_partkey AS name, CASE WHEN p_partkey IN (SELECT node FROM d WHERE depth > 0) THEN 'Dirty' ELSE 'UpToDate' END AS status
          FROM part WHERE p_partkey >= 1""",
)
def lin05(spark, folder):
    nodes, edges = _graph(spark, folder)
    return lineage.mark_dirty(nodes, edges, 2).select("name", "status")


@register(
    "lin06_remove_subtree",
    _DOWN.format(root=5)
    + """ SELECT 'node' AS what, p_partkey AS a, NULL::BIGINT AS b FROM part WHERE p_partkey >= 1 AND p_partkey NOT IN (SELECT node FROM d)
          UNION ALL SELECT 'edge', child, parent FROM e WHERE child NOT IN (SELECT node FROM d)
          UNION ALL SELECT 'removed', node, NULL FROM d""",
)
def lin06(spark, folder):
    nodes, edges, removed = lineage.remove_subtree(*_graph(spark, folder), 5)
    none = F.lit(None).cast("bigint").alias("b")
    return (
        nodes.select(F.lit("node").alias("what"), F.col("name").alias("a"), none)
        .union(edges.select(F.lit("edge"), "child", "parent"))
        .union(removed.select(F.lit("removed"), "name", none))
    )


@register(
    "lin04_deep_chain",
    """SELECT p_partkey AS node, cast(p_partkey - (SELECT min(p_partkey) FROM part) AS INT) AS depth
       FROM part WHERE p_partkey > (SELECT min(p_partkey) FROM part)""",
)
def lin04_deep(spark, folder):
    """A lineage as deep as the table is long: every key stands on the one before."""
    keys = load(spark, folder, "part").select(F.col("p_partkey").alias("child"))
    chain = keys.withColumn("parent", F.col("child") - 1)
    return lineage.descendants(chain, keys.agg(F.min("child")).head()[0])


# commands that name the parent as a table, in a literal, as an alias and before a column
_COMMAND = "'SELECT ' || chr(39) || {old} || chr(39) || ' AS ' || {old} || ', ' || {new} || '.x FROM ' || {new} || ' -- ' || {old}"


@register(
    "lin07_clone_subtree",
    _DOWN.format(root=4)
    + """, named AS (SELECT 'n' || node AS name, 'n' || (node // 2) AS old, CASE WHEN node = 4 THEN 'n2' ELSE 'n' || (node // 2) || '_copy' END AS new FROM d)
        SELECT 'node' AS what, name || '_copy' AS a, """
    + _COMMAND.format(old="old", new="new")
    + """ AS b FROM named
          UNION ALL SELECT 'edge', name || '_copy', new FROM named""",
)
def lin07(spark, folder):
    nodes, edges = _graph(spark, folder)
    parent = "'n' || (name div 2)"
    nodes = nodes.withColumn("command", F.expr(_COMMAND.format(old=parent, new=parent)))
    nodes = nodes.withColumn("name", F.expr("'n' || name"))
    edges = edges.selectExpr("'n' || child AS child", "'n' || parent AS parent")
    nodes, edges = lineage.clone_subtree(nodes, edges, "n4")
    return nodes.select(F.lit("node").alias("what"), F.col("name").alias("a"), F.col("command").alias("b")).union(
        edges.select(F.lit("edge"), "child", "parent")
    )


@register(
    "lin08_tree",
    """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey >= 2),
          d AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth, '1' AS path
                UNION ALL SELECT e.child, depth + 1, path || ' / ' || e.child FROM e JOIN d ON e.parent = d.node)
       SELECT path, node, cast(depth AS INT) AS depth, '' AS note FROM d""",
)
def lin08(spark, folder):
    return lineage.tree(*_graph(spark, folder))


# every node k is made from k / 2 and from (k + 1) / 2, so diamonds stand on diamonds: the
# ways down double with the depth, the compact list does not
@register(
    "lin08_compact_tree",
    """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey >= 2
                            UNION SELECT p_partkey, least((p_partkey + 1) // 2, p_partkey - 1) FROM part WHERE p_partkey >= 2),
          lev AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.child, depth + 1 FROM e JOIN lev ON e.parent = lev.node),
          least AS (SELECT node, min(depth) AS depth FROM lev GROUP BY node)
       SELECT e.child AS node, cast(p.depth + 1 AS INT) AS depth,
              p.depth + 1 = c.depth AND e.parent = min(e.parent) FILTER (p.depth + 1 = c.depth) OVER (PARTITION BY e.child) AS listed
       FROM e JOIN least p ON e.parent = p.node JOIN least c ON e.child = c.node
       UNION ALL SELECT 1, 0, true""",
)
def lin08_compact(spark, folder):
    nodes, edges = _graph(spark, folder)
    second = edges.selectExpr("child", "least((child + 1) div 2, child - 1) AS parent")
    listed = lineage.tree(nodes, edges.union(second).distinct(), compact=True)
    return listed.select("node", "depth", (F.col("note") == "").alias("listed"))


# --- query texts ------------------------------------------------------------------------

# six shapes of text over tables numbered from the order, so refs are known
_TEXT = """CASE o_orderkey % 6
    WHEN 0 THEN 'SELECT * FROM a' || o_custkey || ' WHERE x > 1 -- from nowhere'
    WHEN 1 THEN 'SELECT count(*) FROM a' || o_custkey || ' LEFT JOIN b' || o_custkey || ' ON x = y'
    WHEN 2 THEN 'SELECT ''from c'' FROM a' || o_custkey || ' t, b' || o_custkey || ' u WHERE t.x IN (1, 2)'
    WHEN 3 THEN 'SELECT * FROM (SELECT * FROM a' || o_custkey || ') s WHERE EXISTS (SELECT 1 FROM b' || o_custkey || ')'
    WHEN 4 THEN 'WITH w AS (SELECT * FROM a' || o_custkey || ') SELECT * FROM w UNION SELECT * FROM b' || o_custkey
    ELSE 'INSERT INTO a' || o_custkey || ' SELECT * FROM read_csv(''f.csv'') r, b' || o_custkey END"""


def _texts(spark, folder):
    return load(spark, folder, "orders").selectExpr("o_orderkey AS id", f"{_TEXT} AS sql", "o_custkey")


@register(
    "lin01_table_refs",
    """SELECT o_orderkey AS id, 'a' || o_custkey AS ref FROM orders
       UNION ALL SELECT o_orderkey, 'b' || o_custkey FROM orders WHERE o_orderkey % 6 <> 0""",
)
def lin01(spark, folder):
    return lineage.table_refs(_texts(spark, folder), "id", "sql")


@register(
    "lin02_created_table",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'db.' ELSE '' END || 't' || o_custkey AS created
       FROM orders WHERE o_orderkey % 3 <> 0""",
)
def lin02(spark, folder):
    text = """CASE WHEN o_orderkey % 3 = 0 THEN 'SELECT 1 AS x'
                   WHEN o_orderkey % 2 = 0 THEN 'CREATE OR REPLACE TABLE db.t' || o_custkey || ' AS SELECT 1'
                   ELSE 'create table IF NOT EXISTS "t' || o_custkey || '" (x INT)' END"""
    queries = load(spark, folder, "orders").selectExpr("o_orderkey AS id", f"{text} AS sql")
    return lineage.created_table(queries, "id", "sql")


@register(
    "lin03_unknown_refs",
    """SELECT o_orderkey AS id, 'b' || o_custkey AS ref FROM orders WHERE o_orderkey % 6 <> 0
       UNION ALL SELECT o_orderkey, 'a' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def lin03(spark, folder):
    known = load(spark, folder, "customer").where("c_acctbal > 0").selectExpr("'A' || c_custkey AS name")
    return lineage.unknown_refs(lineage.table_refs(_texts(spark, folder), "id", "sql"), known)


# --- workspace ---------------------------------------------------------------------------


@register("wsp01_sql", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def wsp01(spark, folder):
    load_views(spark, folder, "nation")
    return Workspace(spark).sql("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")


def _flow(spark, folder) -> Workspace:
    """orders -> big -> {by_status, by_customer -> best}, on a saved table."""
    ws = Workspace(spark, scratch_path(spark, "tables"))
    load_views(spark, folder, "orders")
    ws.sql("CREATE OR REPLACE TABLE weftline_orders AS SELECT * FROM orders")
    ws.sql("SELECT * FROM weftline_orders WHERE o_totalprice > 200000", name="big")
    ws.sql("SELECT o_orderstatus, count(*) AS n FROM big GROUP BY 1", name="by_status")
    ws.sql("CREATE OR REPLACE TABLE weftline_buyers AS SELECT o_custkey, count(*) AS n FROM big GROUP BY 1")
    ws.derive("best", "SELECT max(n) AS most FROM weftline_buyers")
    return ws


_COUNTS = """SELECT 'big' AS name, count(*) AS n FROM orders WHERE o_totalprice > 200000
             UNION ALL SELECT 'by_status', count(DISTINCT o_orderstatus) FROM orders WHERE o_totalprice > 200000
             UNION ALL SELECT 'weftline_buyers', count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 200000
             UNION ALL SELECT 'weftline_orders', count(*) FROM orders"""


def _sizes(ws: Workspace):
    out = None
    for name in ("big", "by_status", "weftline_buyers", "weftline_orders"):
        part = ws.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@register("wsp02_named_query", _COUNTS)
def wsp02(spark, folder):
    return _sizes(_flow(spark, folder))


@register(
    "wsp03_derive",
    "SELECT max(n) AS most FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey) x",
)
def wsp03(spark, folder):
    return _flow(spark, folder).table("best")


@register(
    "wsp04_run",
    """SELECT 'weftline_orders' AS name, 'UpToDate' AS status, (SELECT count(*) FROM orders) AS rows
       UNION ALL SELECT 'big', 'UpToDate', (SELECT count(*) FROM orders WHERE o_totalprice > 200000)
       UNION ALL SELECT 'by_status', 'UpToDate', (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_totalprice > 200000)
       UNION ALL SELECT 'weftline_buyers', 'UpToDate', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 200000)
       UNION ALL SELECT 'best', 'UpToDate', 1""",
)
def wsp04(spark, folder):
    ws = _flow(spark, folder)
    ws.mark_dirty("weftline_orders")
    ws.run()
    return ws.nodes().select("name", "status", "rows")


@register(
    "wsp05_freeze_trim",
    """SELECT 'big' AS name, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS rows, true AS frozen, 'UpToDate' AS status
       UNION ALL SELECT 'weftline_buyers', NULL, false, 'Empty'""",
)
def wsp05(spark, folder):
    ws = _flow(spark, folder)
    ws.freeze("big")
    ws.trim("weftline_buyers")
    return ws.nodes().where("name IN ('big', 'weftline_buyers')").select("name", "rows", "frozen", "status")


@register("wsp06_replay", _COUNTS)
def wsp06(spark, folder):
    ws = _flow(spark, folder)
    steps = ws.steps()
    ws.remove("weftline_orders")
    again = Workspace(spark, scratch_path(spark, "tables"))
    again.replay(steps)
    return _sizes(again)


@register(
    "wsp06_saved",
    _COUNTS + " UNION ALL SELECT 'steps', 7",
)
def wsp06_saved(spark, folder):
    """Saved, then loaded by a session that knows none of the views."""
    ws = _flow(spark, folder)
    ws.freeze("big")
    ws.mark_dirty("weftline_buyers")
    path = scratch_path(spark, "workspace")
    ws.save(path)
    other = spark.newSession()
    load_views(other, folder, "orders")
    again = Workspace.load(other, path)
    steps = again.steps().agg(F.count(F.lit(1)).alias("n")).select(F.lit("steps").alias("name"), "n")
    return _sizes(again).union(steps)


@register(
    "wsp07_catalog",
    """SELECT column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int'
              WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS column_type
       FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem')""",
)
def wsp07(spark, folder):
    load_views(spark, folder, "orders", "lineitem")
    ws = Workspace(spark)
    listed = [r["name"] for r in ws.tables().where("name IN ('orders', 'lineitem')").collect()]
    out = None
    for name in listed:
        part = ws.columns(name).select("column_name", "column_type")
        out = part if out is None else out.union(part)
    return out


@register(
    "lin09_nodes",
    """SELECT * FROM (VALUES ('weftline_orders', 'table', ''), ('big', 'query', 'weftline_orders'), ('by_status', 'query', 'big'),
                             ('weftline_buyers', 'table', 'big'), ('best', 'query', 'weftline_buyers')) AS t(name, kind, parents)""",
)
def lin09(spark, folder):
    return _flow(spark, folder).nodes().select("name", "kind", F.array_join("parents", ",").alias("parents"))


@register(
    "udf01_template",
    """SELECT event_type AS key, cast(sum(cast(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY event_type
       ORDER BY total DESC, key LIMIT 3""",
)
def udf01(spark, folder):
    ws = Workspace(spark)
    load_views(spark, folder, "events")
    ws.template(
        "top_talkers",
        """SELECT IDENTIFIER(:column) AS key, cast(sum(cast(IDENTIFIER(:measure) AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM IDENTIFIER(:table) GROUP BY 1 ORDER BY total DESC, key LIMIT :n""",
        ["table", "column", "measure", "n"],
    )
    return ws.run_template("top_talkers", table="events", column="event_type", measure="value", n=3)
