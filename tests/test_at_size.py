"""What must hold on larger tables, shown on small ones."""

import math

import pytest

from weftline import session
from weftline.operators import logs, plotdata
from weftline.operators.relational import range_join
from weftline.plans import lineage, ordered


def test_range_join_broadcasts_no_exploded_side(spark):
    # a row per cell size of every point: far more than Spark takes the points for
    points = spark.range(2000).selectExpr("id AS i", "CASE WHEN id % 2 = 0 THEN 0.5D ELSE id / 2000 END AS at")
    ranges = spark.range(300).selectExpr("id AS j", "id / 300 AS lo", "id / 300 + (id % 5) * 0.001D AS hi")
    out = range_join(points, ranges, "at", "lo", "hi")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = points.crossJoin(ranges).where("at BETWEEN lo AND hi")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_shapes_of_many_skeletons_merge_as_others(spark):
    lines = [f"a w{i % 12} w{i % 8} z{i}" for i in range(40)] + [f"b w{i} x" for i in range(8)] + [f"c w{i} <*>" for i in range(9)] + ["c", "d e"]
    skeletons = logs._skeleton_counts(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    assert skeletons.count() == len(lines)
    for hot in (0, 20, None):
        found = logs._wildcards(skeletons, 8, hot).collect()
        assert sorted((r._len, r._first, sorted(r._wild)) for r in found) == [(3, "c", [1]), (4, "a", [1, 3])]


def test_templates_are_not_made_twice_to_be_numbered(spark, monkeypatch):
    made, counted = [], ordered.largest_key
    monkeypatch.setattr(ordered, "largest_key", lambda df, by: made.append(by) or counted(df, by))
    lines = spark.range(30).selectExpr("concat('user u', id, ' in') AS line")
    for hot in (1, None):
        out = logs.log_templates(lines, "line", hot_rows=hot).collect()
        assert [tuple(r)[:3] for r in out] == [(1, "user <*> in", 30)]
    assert made == []


def test_line_layout_sorts_no_points(spark):
    table = spark.range(500).selectExpr("id AS x", "sin(id / 20) AS a", "cos(id / 20) AS b")
    out = plotdata.line_layout(plotdata.plot_series(table, "x", ["a", "b"], order=["x"]), 40, 10)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    cells = {(x, number): wave(x / 20) for number, wave in enumerate((math.sin, math.cos)) for x in range(500)}
    low, high = min(cells.values()), max(cells.values())
    want = {}
    for (x, number), y in sorted(cells.items(), key=lambda c: c[0][1]):
        want[7 - min(math.floor((y - low) / (high - low) * 7.0), 7), x * 31 // 499] = "●○"[number]
    assert {(r.row, r.col): r.marker for r in out.collect()} == want


def limited(monkeypatch):
    """The counts of what is settled by asking for its rows, with four rows as small."""
    settle, settle_large, counts = session.settle, session.settle_large, []

    def counted(df, *_):
        made, count = settle(df, 4)
        counts.append(count)
        return made, count

    monkeypatch.setattr(lineage, "settle", counted)
    monkeypatch.setattr(lineage, "settle_large", lambda df, *_: settle_large(df, 4))
    return counts


def test_large_levels_of_a_compact_tree_stay_off_the_driver(spark, monkeypatch):
    keys = spark.range(1, 120).withColumnRenamed("id", "name")
    edges = keys.where("name > 1").selectExpr("name AS child", "name div 2 AS parent")
    edges = edges.union(edges.selectExpr("child", "least((child + 1) div 2, child - 1) AS parent")).distinct()
    want = sorted(map(tuple, lineage.tree(keys, edges, compact=True).collect()))
    counts = limited(monkeypatch)
    assert sorted(map(tuple, lineage.tree(keys, edges, compact=True).collect())) == want
    # only the first level above the limit is asked for rows in vain, besides the edges
    assert counts.count(None) == 2


def test_large_rounds_of_a_walk_are_not_asked_for_rows_in_vain(spark, monkeypatch):
    chain = spark.range(1, 150).selectExpr("id AS child", "id - 1 AS parent")
    counts = limited(monkeypatch)
    assert sorted(map(tuple, lineage.descendants(chain, 0).collect())) == [(i, i) for i in range(1, 150)]
    # the edges, and the first round above the limit
    assert counts.count(None) <= 2


def test_rounds_of_a_walk_write_in_proportion_to_the_chain(spark, monkeypatch):
    n, durable, written = 600, session.durable, []
    for module in (session, lineage):
        monkeypatch.setattr(module, "durable", lambda df: written.append((out := durable(df)).count()) or out, raising=False)
    limited(monkeypatch)
    chain = spark.range(1, n + 1).selectExpr("id AS child", "id - 1 AS parent")
    assert sorted(map(tuple, lineage.descendants(chain, 0).collect())) == [(i, i) for i in range(1, n + 1)]
    assert sum(written) < 10 * n


# a chain with a branch, twigs, a diamond, a cycle beside it and one it leads into, ways back and repeats
_ODD = [(i + 1, i) for i in range(30)] + [(100 + i, i % 30) for i in range(40)] + [(200, 12), (201, 12), (202, 200), (202, 201), (203, 202)]
_ODD += [(301, 300), (302, 301), (300, 302), (400, 30), (401, 400), (402, 401), (400, 402), (5, 20), (0, 9), (7, 7), (25, 3), (500, 501), (3, 500)]


@pytest.mark.parametrize("roots", [(0,), (2, 12, 7)])
def test_odd_graphs_above_the_limit(spark, monkeypatch, roots):
    limited(monkeypatch)
    edges = spark.createDataFrame([(f"n{c}", f"n{p}") for c, p in _ODD * 3] + [("n1", None), (None, "n0")], "child string, parent string")
    depth, level = dict.fromkeys(roots, 0), set(roots)
    while level:
        level = {c for c, p in _ODD if p in level} - set(depth)
        depth |= dict.fromkeys(level, max(depth.values()) + 1)
    got = lineage.descendants(edges, *(f"n{r}" for r in roots)).collect()
    assert sorted(map(tuple, got)) == sorted((f"n{node}", d) for node, d in depth.items() if d)
