"""Workspace verbs on the small inline tables of an analyst's session."""

import pytest
from pyspark.sql import functions as F

from weftline import Workspace
from weftline.plans import lineage
from weftline.plans.references import references, split_ctas


@pytest.fixture
def ws(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "tables"))
    yield work
    for name in list(work._nodes):
        if name in work:
            work.remove(name)


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_table_query_and_parents(ws):
    ws.sql(
        """CREATE TABLE auth AS SELECT * FROM VALUES
           ('2024-01-01', 'root', '192.168.1.100', 'failed'), ('2024-01-01', 'admin', '10.0.0.5', 'failed')
           AS t(ts, username, src_ip, status)"""
    )
    assert ws["auth"].rows == 2 and ws["auth"].status == "UpToDate"
    out = ws.sql("SELECT username, count(*) AS n FROM auth GROUP BY username", name="by_user")
    assert values(out) == [("admin", 1), ("root", 1)]
    assert ws["by_user"].parents == ["auth"]
    assert values(ws.edges()) == [("by_user", "auth")]


def test_parent_child_and_two_children(ws):
    ws.sql("SELECT 1 AS x, 2 AS y", name="data")
    ws.sql("SELECT x FROM data", name="left_child")
    ws.sql("SELECT y FROM data", name="right_child")
    assert values(lineage.descendants(ws.edges(), "data")) == [("left_child", 1), ("right_child", 1)]
    assert ws.sql("SELECT x + 1 AS z FROM left_child").head()[0] == 2


def test_unnamed_query_makes_no_node(ws):
    ws.sql("SELECT 1 AS x")
    assert ws.nodes().count() == 0


def test_create_table_keeps_parents_and_readding_replaces(ws):
    ws.sql("SELECT 1 AS id, 'click' AS kind", name="events_tiny")
    ws.sql("CREATE OR REPLACE TABLE clicks AS SELECT * FROM events_tiny WHERE kind = 'click'")
    assert ws["clicks"].parents == ["events_tiny"]
    ws.sql("SELECT 2 AS id, 'view' AS kind", name="events_tiny")
    assert ws["clicks"].status == "Dirty"
    assert ws.run() == ["clicks"]
    assert ws["clicks"].rows == 0 and ws["clicks"].status == "UpToDate"


def test_join_has_both_parents(ws):
    ws.sql("SELECT 1 AS id, 'alice' AS name", name="users")
    ws.sql("SELECT 1 AS user_id, 'book' AS item", name="purchases")
    out = ws.sql("SELECT name, item FROM users JOIN purchases ON users.id = purchases.user_id", name="joined")
    assert values(out) == [("alice", "book")]
    assert sorted(ws["joined"].parents) == ["purchases", "users"]


def test_derive_is_empty_until_run(ws):
    ws.sql("SELECT 1 AS x", name="src")
    ws.derive("later", "SELECT x + 1 AS y FROM src")
    assert ws["later"].status == "Empty"
    assert ws.table("later").head()[0] == 2
    ws.run("later")
    assert ws["later"].status == "UpToDate" and ws["later"].rows == 1


def test_failure_leaves_downstream_dirty(ws, spark, tmp_path):
    path = str(tmp_path / "in.csv")
    spark.createDataFrame([(1,)], "x int").write.option("header", "true").csv(path)
    ws.into("source_t", path, "csv")
    ws.sql("CREATE TABLE below_t AS SELECT x FROM source_t")
    ws["source_t"].step["file"] = str(tmp_path / "gone.csv")
    ws["source_t"].status = "Dirty"
    ws.mark_dirty("source_t")
    assert ws.run() == []
    assert ws["source_t"].status == "Error" and ws["source_t"].error
    assert ws["below_t"].status == "Dirty"


def test_freeze_and_trim(ws):
    ws.sql("CREATE TABLE base_t AS SELECT 1 AS x")
    ws.sql("SELECT x FROM base_t", name="kept")
    ws.freeze("kept")
    ws.sql("INSERT INTO base_t SELECT 2")
    assert ws.table("kept").count() == 1
    ws.run()
    assert ws.table("kept").count() == 1
    ws.trim("kept")
    assert ws.table("kept").count() == 2 and ws["kept"].status == "Empty"
    ws.trim("base_t")
    assert not ws.spark.catalog.tableExists("base_t")
    ws.run("base_t")
    assert ws.table("base_t").count() == 1


def test_remove_drops_subtree_and_data(ws, spark):
    ws.sql("CREATE TABLE top_t AS SELECT 1 AS x")
    ws.sql("SELECT x FROM top_t", name="mid_q")
    ws.sql("SELECT x FROM mid_q", name="leaf_q")
    ws.sql("SELECT 5 AS x", name="other_q")
    assert ws.remove("mid_q") == ["mid_q", "leaf_q"]
    assert "leaf_q" not in ws and "other_q" in ws
    assert not spark.catalog.tableExists("leaf_q")


def test_clone_runs_on_its_own_copies(ws):
    ws.sql("CREATE TABLE num AS SELECT 1 AS x")
    ws.sql("SELECT x + 1 AS y FROM num", name="plus")
    ws.sql("SELECT num.x, plus.y FROM num, plus", name="both")
    assert ws.clone("num") == ["num_copy", "plus_copy", "both_copy"]
    assert ws["plus_copy"].parents == ["num_copy"] and ws["plus_copy"].status == "Empty"
    assert sorted(ws["both_copy"].parents) == ["num_copy", "plus_copy"]
    ws.run()
    ws.sql("INSERT INTO num_copy SELECT 10")
    assert ws.table("both_copy").count() == 4 and ws.table("both").count() == 1
    before = ws.nodes().count()
    ws.remove("num_copy")
    assert ws.nodes().count() == before - 3


def test_plot_node_replaces_and_reads_series(ws):
    ws.sql("SELECT * FROM VALUES ('a', 3), ('b', 7), ('c', 2) AS t(x, y)", name="nums")
    series = ws.plot("bar", "nums", "x", "y", order=["x"])
    assert [(r.x, r.y) for r in series.orderBy("ord").collect()] == [("a", 3.0), ("b", 7.0), ("c", 2.0)]
    ws.plot("line", "nums", "x", "y * 2")
    assert ws["plot:nums"].step["kind"] == "line" and ws["plot:nums"].parents == ["nums"]
    assert ws.nodes().where("kind = 'plot'").count() == 1


def test_replay_rebuilds_nodes_and_edges(ws, spark, tmp_path):
    ws.sql("CREATE OR REPLACE TABLE first_t AS SELECT 1 AS x")
    ws.sql("SELECT x FROM first_t", name="second_q")
    ws.plot("bar", "second_q", "x", "x")
    steps, nodes, edges = ws.steps(), values(ws.nodes().select("name", "kind")), values(ws.edges())
    again = Workspace(spark, str(tmp_path / "again"))
    again.replay(steps)
    assert values(again.nodes().select("name", "kind")) == nodes and values(again.edges()) == edges


def test_into_many_and_catalog(ws, spark):
    df = spark.range(3).toDF("n")
    assert ws.into_many("wl_auth.", {"templates": df, "records": df.limit(2)}) == {"wl_auth.templates": 3, "wl_auth.records": 2}
    assert ws.sql("SELECT count(*) FROM wl_auth.records").head()[0] == 2
    assert values(ws.columns("wl_auth.templates")) == [(0, "n", "bigint", True)]


def test_template_binds_names_safely(ws):
    ws.sql("SELECT * FROM VALUES ('a', 1), ('b', 5), ('b', 2) AS t(ip, bytes)", name="flows")
    ws.template(
        "top", "SELECT IDENTIFIER(:column) AS k, sum(bytes) AS total FROM IDENTIFIER(:table) GROUP BY 1 ORDER BY total DESC LIMIT :n",
        ["table", "column", "n"],
    )
    assert values(ws.run_template("top", table="flows", column="ip", n=1)) == [("b", 7)]
    with pytest.raises(Exception):
        ws.run_template("top", table="flows; DROP TABLE flows", column="ip", n=1)
    with pytest.raises(ValueError):
        ws.run_template("top", table="flows")


def test_awkward_names(ws):
    ws.sql("SELECT 1 AS `odd col`", name="odd name")
    assert ws.table("odd name").head()[0] == 1
    assert ws.preview("odd name", 5).count() == 1


@pytest.mark.parametrize(
    "sql, refs",
    [
        ("SELECT host, count(*) FROM flows GROUP BY host", ["flows"]),
        ("SELECT f.host FROM flows f LEFT JOIN hosts h ON f.host = h.name", ["flows", "hosts"]),
        ("SELECT avg(n) FROM (SELECT count(*) AS n FROM flows GROUP BY host) AS counted", ["flows"]),
        ("WITH big AS (SELECT * FROM flows WHERE bytes > 9) SELECT max(bytes) FROM big", ["flows"]),
        ("SELECT 1 FROM a, b c WHERE EXISTS (SELECT 1 FROM d) UNION SELECT 1 FROM e", ["a", "b", "d", "e"]),
        ("INSERT INTO archive SELECT * FROM flows", ["archive", "flows"]),
        ("SELECT * FROM a JOIN (b JOIN c ON b.x = c.x) ON a.x = b.x", ["a", "b", "c"]),
        ("SELECT (SELECT max(bytes) FROM flows) AS most FROM range(3)", ["flows"]),
        ("SELECT ' FROM nowhere' AS x -- FROM nowhere\nFROM db.flows /* JOIN no */", ["db.flows"]),
        ("WITH p AS (SELECT * FROM x), q AS (SELECT * FROM p) SELECT * FROM q LEFT JOIN y ON true", ["x", "y"]),
        ("SELECT 1 -- it's here\nFROM flows WHERE y = 'a'", ["flows"]),
        ("SELECT extract(year FROM ts), trim(both 'x' FROM name) FROM flows WHERE a IS DISTINCT FROM b", ["flows"]),
        ("SELECT '" + "it''s long " * 20_000 + "' AS x FROM flows", ["flows"]),
    ],
)
def test_references_by_parser_and_by_text(spark, sql, refs):
    assert sorted(references(spark, sql)) == refs
    frame = spark.createDataFrame([(1, sql)], "id int, sql string")
    assert sorted(r["ref"] for r in lineage.table_refs(frame, "id", "sql").collect()) == refs


def test_created_table_texts(spark):
    texts = [
        ("CREATE TABLE kept AS SELECT host FROM flows", "kept"),
        ("-- daily\nCREATE OR REPLACE TABLE daily AS SELECT 1 AS x FROM flows", "daily"),
        ('create table if not exists "a name" (x int)', "a name"),
        ("SELECT 'CREATE TABLE other' AS x FROM flows", None),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id int, sql string")
    got = {r["id"]: r["created"] for r in lineage.created_table(frame, "id", "sql").collect()}
    assert got == {i: n for i, (_, n) in enumerate(texts) if n}
    assert split_ctas("CREATE TABLE IF NOT EXISTS a AS SELECT 1;") == ("a", "ignore", "SELECT 1")


def test_long_lists_of_tables(spark):
    names = [f"t{i}" for i in range(20_000)]
    frame = spark.createDataFrame([(1, "SELECT 1 FROM " + ", ".join(names))], "id int, sql string")
    assert {r["ref"] for r in lineage.table_refs(frame, "id", "sql").collect()} == set(names)


def test_frozen_names_do_not_meet(ws):
    for name, value in (("a b", 1), ("a_b", 2)):
        ws.sql(f"SELECT {value} AS x", name=name)
        ws.freeze(name)
    assert [ws.table(n).head()[0] for n in ("a b", "a_b")] == [1, 2]


def test_unknown_refs(spark):
    refs = spark.createDataFrame([(1, "Auth"), (1, "logs")], "id int, ref string")
    known = spark.createDataFrame([("auth",)], "name string")
    assert values(lineage.unknown_refs(refs, known)) == [(1, "logs")]


# --- graph corner cases ---------------------------------------------------------


@pytest.fixture(scope="module")
def diamond(spark):
    nodes = spark.createDataFrame(
        [(n, "query", "UpToDate", c) for n, c in [
            ("a", "SELECT 1"), ("b", "SELECT * FROM a"), ("c", "SELECT * FROM a"),
            ("d", "SELECT * FROM b JOIN c"), ("lost", "SELECT * FROM gone"), ("p", "SELECT * FROM q"), ("q", "SELECT * FROM p"),
        ]],
        "name string, kind string, status string, command string",
    )
    edges = spark.createDataFrame(
        [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("lost", "gone"), ("p", "q"), ("q", "p")], "child string, parent string"
    )
    return nodes, edges


def test_walks(diamond):
    _, edges = diamond
    assert values(lineage.descendants(edges, "a")) == [("b", 1), ("c", 1), ("d", 2)]
    assert values(lineage.ancestors(edges, "d")) == [("a", 2), ("b", 1), ("c", 1)]
    assert values(lineage.descendants(edges, "p")) == [("q", 1)]
    assert values(lineage.descendants(edges, "nobody")) == []


def test_tree_lists_every_way_orphans_and_cycles(diamond):
    got = [tuple(r) for r in lineage.tree(*diamond).collect()]
    assert got == [
        ("a", "a", 0, ""), ("a / b", "b", 1, ""), ("a / b / d", "d", 2, ""), ("a / c", "c", 1, ""), ("a / c / d", "d", 2, ""),
        ("lost", "lost", 0, "orphan"), ("p", "p", 0, "cycle"), ("q", "q", 0, "cycle"),
    ]


def test_mark_remove_and_clone(diamond):
    nodes, edges = diamond
    marked = {r["name"]: r["status"] for r in lineage.mark_dirty(nodes, edges, "b").collect()}
    assert marked["d"] == "Dirty" and marked["c"] == marked["b"] == "UpToDate"
    kept, kept_edges, removed = lineage.remove_subtree(nodes, edges, "b")
    assert values(removed) == [("b",), ("d",)] and kept.count() == 5 and ("c", "a") in values(kept_edges)
    copies, copy_edges = lineage.clone_subtree(nodes, edges, "b")
    assert values(copies.select("name", "status", "command")) == [
        ("b_copy", "Empty", "SELECT * FROM a"), ("d_copy", "Empty", "SELECT * FROM b_copy JOIN c"),
    ]
    assert values(copy_edges) == [("b_copy", "a"), ("d_copy", "b_copy"), ("d_copy", "c")]


def test_large_rounds_go_to_the_shared_folder(spark, monkeypatch):
    monkeypatch.setattr("weftline.session.settle.__defaults__", (2,))
    edges = spark.range(2, 200).select(F.col("id").alias("child"), F.expr("id div 2").alias("parent"))
    assert lineage.descendants(edges, 1).count() == 198
    chain = spark.range(1, 40).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    assert lineage.descendants(chain, 0).agg(F.max("depth")).head()[0] == 39
