"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.llm.runs import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); equal roots, same component.

    Each round hangs every node under its smallest neighbour, shortens those paths
    and contracts the edges, which at least halves the nodes that still have any.
    Rounds are written to the shared folder.  The root is a node of the component.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    roots = None
    while not edges.isEmpty():
        parent = both(edges).groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        parent = stored(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("u", F.col("pp").alias("p"))
        parent = stored(parent, "jumped")
        if roots is None:
            roots = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = roots.join(parent.select(F.col("u").alias("root"), "p"), "root", "left")
            roots = stored(moved.select("node", F.coalesce("p", "root").alias("root")), "roots")
        of_u, of_v = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        next_edges = edges.join(of_u, "u").join(of_v, "v").where("pu <> pv")
        edges = stored(next_edges.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    if roots is None:
        roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
