"""Saving, loading, cloning and editing a workspace."""

import pytest
from pyspark.sql import functions as F

from weftline import Workspace
from weftline.plans import lineage
from weftline.plans.references import with_tables_renamed


@pytest.fixture
def ws(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "tables"))
    work.sql("CREATE TABLE sv_base AS SELECT id AS x, id % 3 AS g FROM range(30)")
    work.sql("SELECT g, count(*) AS n FROM sv_base GROUP BY g", name="sv_counts")
    work.sql("SELECT max(n) AS most FROM sv_counts", name="sv_most")
    yield work
    for name in list(work._nodes):
        if name in work:
            work.remove(name)


def state(ws):
    return sorted(tuple(r) for r in ws.nodes().collect())


def test_load_gives_back_what_was_saved(ws, spark, tmp_path):
    ws.freeze("sv_counts")
    ws.plot("bar", "sv_counts", "g", "n")
    ws.derive("sv_later", "SELECT n + 1 AS m FROM sv_counts")
    ws.template("over", "SELECT count(*) AS n FROM sv_base WHERE x > :low", ["low"])
    path = str(tmp_path / "saved")
    assert [ws.save(path), ws.save(path)] == [1, 2]
    # another session has its own temporary views, so what is selectable comes from loading
    other = spark.newSession()
    again = Workspace.load(other, path)
    assert state(again) == state(ws) and again._steps == ws._steps
    assert sorted(map(tuple, again.edges().collect())) == sorted(map(tuple, ws.edges().collect()))
    assert again.run_template("over", low=20).head()[0] == 9
    assert again.table("sv_most").head()[0] == 10 and again.table("sv_later").count() == 3
    assert again["sv_counts"].frozen
    ws.sql("INSERT INTO sv_base SELECT 99, 7")
    assert again.table("sv_counts").count() == 3  # frozen data is read, not the query
    assert again.series("plot:sv_counts").count() == 3


def test_tables_unknown_to_the_catalog_are_attached(ws, spark, tmp_path):
    path = str(tmp_path / "saved")
    ws.freeze("sv_counts")
    ws.save(path)
    for table in ("sv_base", ws._frozen_name("sv_counts")):
        spark.sql(f"DROP TABLE `{table}`")  # its files stay: the location was given
    again = Workspace.load(spark.newSession(), path)
    assert again.table("sv_base").count() == 30 and again.table("sv_counts").count() == 3
    assert again["sv_base"].status == "UpToDate" and again["sv_base"].rows == 30


def test_lost_files_leave_an_empty_node_that_can_be_run(ws, spark, tmp_path):
    path = str(tmp_path / "saved")
    ws.save(path)
    spark.sql("DROP TABLE sv_base")
    moved = spark.read.json(path).select("ord", "part", F.regexp_replace("body", r'("data": "[^"]+)sv_base"', '$1nowhere"').alias("body"))
    moved.coalesce(1).write.json(f"{path}/version=2")
    again = Workspace.load(spark.newSession(), path)
    assert again["sv_base"].status == "Empty" and again["sv_counts"].status == "Dirty"
    assert again.run() == ["sv_base", "sv_counts", "sv_most"]
    assert again.table("sv_most").head()[0] == 10


def test_nothing_saved(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Workspace.load(spark, str(tmp_path / "none"))


def test_every_verb_is_replayed(ws, spark, tmp_path):
    ws.freeze("sv_counts")
    ws.clone("sv_most", "_two")
    ws.derive("sv_kept", "SELECT 1 AS x")
    ws.trim("sv_kept")
    ws.template("t", "SELECT :a AS a", ["a"])
    ws.mark_dirty("sv_base")
    ws.edit("sv_most", "SELECT min(n) AS least FROM sv_counts")
    steps = ws.steps()
    want = [(n.name, n.kind, n.status, n.frozen, n.parents) for n in ws._nodes.values()]
    for name in list(ws._nodes):
        if name in ws:
            ws.remove(name)
    again = Workspace(spark, str(tmp_path / "again"))
    again.replay(steps)
    assert [(n.name, n.kind, n.status, n.frozen, n.parents) for n in again._nodes.values()] == want
    assert again.run_template("t", a=5).head()[0] == 5
    again.run("sv_most")
    assert again.table("sv_most").columns == ["least"]
    for name in list(again._nodes):
        if name in again:
            again.remove(name)


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT 'num' AS num, x AS plus FROM num -- num", "SELECT 'num' AS num, x AS plus FROM num_2 -- num"),
        ("SELECT num.x FROM num, `plus` p", "SELECT num.x FROM num_2 AS `num`, plus_2 p"),
        ("WITH num AS (SELECT * FROM plus) SELECT * FROM num", "WITH num AS (SELECT * FROM plus_2) SELECT * FROM num"),
        ("SELECT 'é𝄞', num FROM plus TABLESAMPLE (50 PERCENT)", "SELECT 'é𝄞', num FROM plus_2 TABLESAMPLE (50 PERCENT)"),
        ("INSERT INTO num SELECT * FROM plus", "INSERT INTO num_2 SELECT * FROM plus_2"),
        ("CREATE TABLE num AS SELECT 'num' AS a FROM Plus", "CREATE TABLE `num_2` AS SELECT 'num' AS a FROM plus_2"),
        ("SELECT max(x) FROM plus WHERE x IN (SELECT num FROM num)", "SELECT max(x) FROM plus_2 WHERE x IN (SELECT num FROM num_2)"),
    ],
)
def test_only_table_positions_are_renamed(spark, sql, want):
    assert with_tables_renamed(spark, sql, {"num": "num_2", "plus": "plus_2"}) == want


def test_clone_keeps_literals(ws):
    ws.sql("SELECT 'sv_counts' AS sv_most, sv_counts.n FROM sv_counts", name="sv_label")
    ws.clone("sv_counts", "_b")
    ws.run()
    assert {r[0] for r in ws.table("sv_label_b").collect()} == {"sv_counts"}
    assert ws["sv_label_b"].parents == ["sv_counts_b"]


def test_edit_in_place_and_as_a_variant(ws):
    assert ws.edit("sv_counts", "SELECT g, sum(x) AS n FROM sv_base GROUP BY g", suffix="_v") == ["sv_counts_v", "sv_most_v"]
    ws.run()
    assert ws.table("sv_most").head()[0] == 10 and ws.table("sv_most_v").head()[0] == 155
    assert ws.edit("sv_counts", "SELECT 1 AS g, 2 AS n") == ["sv_counts", "sv_most"]
    assert ws["sv_counts"].status == "Empty" and ws["sv_counts"].parents == [] and ws["sv_most"].status == "Dirty"
    ws.run()
    assert ws.table("sv_most").head()[0] == 2
    with pytest.raises(ValueError):
        ws.edit("sv_counts", "SELECT * FROM sv_most")
    ws.edit("sv_base", "SELECT 1L AS x, 1L AS g")
    assert ws.run() == ["sv_base", "sv_counts_v", "sv_most_v"] and ws["sv_base"].rows == 1


# --- deep graphs ------------------------------------------------------------------


def test_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    settle = lineage.settle
    monkeypatch.setattr(lineage, "settle", lambda df, *a: rounds.append(df.columns) or settle(df, *a))
    chain = spark.range(1, 3_001).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    below = lineage.descendants(chain, 0)
    assert below.agg(F.count("*"), F.sum("depth"), F.max("depth")).head() == (3000, 3000 * 3001 // 2, 3000)
    assert sum(columns == ["node", "depth"] for columns in rounds) < 20


@pytest.mark.parametrize("seed", range(3))
def test_least_depths_of_tangled_graphs(spark, seed):
    import random

    rng = random.Random(seed)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(50)} | {(i + 1, i) for i in range(20, 45)}
    depth, level = {22: 0}, [22]
    while level:
        level = sorted({c for c, p in edges if p in level} - set(depth))
        depth |= {n: max(depth.values()) + 1 for n in level}
    got = lineage.descendants(spark.createDataFrame(sorted(edges), "child long, parent long"), 22)
    assert {r.node: r.depth for r in got.collect()} == {n: d for n, d in depth.items() if n != 22}


def test_compact_tree_of_diamonds_is_linear(spark):
    # twenty diamonds in a row: 2^20 ways down, 61 nodes, 80 edges
    pairs = [(f"n{3 * k + up:02d}", f"n{3 * k + down:02d}") for k in range(20) for down, up in ((0, 1), (0, 2), (1, 3), (2, 3))]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(61)], "name string")
    rows = lineage.tree(nodes, edges, compact=True).collect()
    assert len(rows) == 81 and sum(r.note == "" for r in rows) == 61
    assert [(r.path, r.note) for r in rows if r.node == "n03"] == [("n00 / n01 / n03", ""), ("n00 / n02 / n03", "see n00 / n01 / n03")]
    assert {r.node: r.depth for r in rows if not r.note} == {f"n{i:02d}": 2 * (i // 3) + (i % 3 > 0) for i in range(61)}


def test_compact_tree_keeps_orphans_and_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("d", "gone"), ("e", "d"), ("f", "e"), ("f", "d")], "child string, parent string")
    nodes = spark.createDataFrame([(n,) for n in "abdef"], "name string")
    got = [tuple(r) for r in lineage.tree(nodes, edges, compact=True).collect()]
    assert got == [
        ("a", "a", 0, "cycle"), ("b", "b", 0, "cycle"), ("d", "d", 0, "orphan"), ("d / e", "e", 1, ""),
        ("d / e / f", "f", 2, "see d / f"), ("d / f", "f", 1, ""),
    ]


def test_cloned_commands_change_at_table_positions_only(spark):
    command = "SELECT 'FROM n1' AS n1, n1.x, n2 FROM n1, n2 u -- n1\nJOIN (n1 v) ON u.n1 = v.x"
    nodes = spark.createDataFrame([("n1", "q", "UpToDate", "SELECT 1"), ("n2", "q", "UpToDate", "SELECT * FROM n1"), ("n3", "q", "UpToDate", command)],
                                  "name string, kind string, status string, command string")
    edges = spark.createDataFrame([("n2", "n1"), ("n3", "n1"), ("n3", "n2")], "child string, parent string")
    got = {r.name: r.command for r in lineage.clone_subtree(nodes, edges, "n1", "$c")[0].collect()}
    assert got["n2$c"] == "SELECT * FROM n1$c"
    assert got["n3$c"] == "SELECT 'FROM n1' AS n1, n1$c.x, n2 FROM n1$c, n2$c u -- n1\nJOIN (n1$c v) ON u.n1 = v.x"
