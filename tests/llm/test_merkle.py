"""The manifest against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, arity):
    """The root, and for every leaf its list of (left, right)."""
    paths, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(place):
            run = at - at % arity
            paths[k].append(("".join(level[run:at]), "".join(level[at + 1 : run + arity])))
        level = [H("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        place = [at // arity for at in place]
    return level[0], paths


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], H("".join(field(v) for v in r))))
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in ordered:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([leaf for _, leaf in groups[g]], arity)
    root, tops = plain_tree([trees[g][0] for g in ordered], arity)
    return sorted(
        (str(doc), leaf, trees[g][0], root, tuple(trees[g][1][i] + tops[k]))
        for k, g in enumerate(ordered)
        for i, (doc, leaf) in enumerate(groups[g])
    )


def made(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("path", F.lit(1)).withColumn("pos", F.lit(2)).repartition(3)
    out = merkle.manifest(docs, merkle.row_digest(F.col("doc_id"), F.col("lang"), F.col("text")), keep=["doc_id", "text"], **options)
    folded = out.withColumn("again", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    assert all(r.again == r.root for r in folded)
    assert all(r.proof == H("".join(s.left + s.right for s in r.path)) for r in folded)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in folded)


def table(sizes):
    rows = [(i, f"l{g}", "é" * (i % 5)) for g, n in enumerate(sizes) for i in range(g * 1000, g * 1000 + n)]
    return [*rows, (None, None, None), (None, None, None), (7, None, ""), (5, "", "same"), (5, "", "same"), (5, "", "other")]


@pytest.mark.parametrize(("arity", "height"), [(2, 2), (2, 6), (3, 1)])
def test_manifest(spark, arity, height):
    rows = table([1, 2, 5, 16, 17, 75])
    assert made(spark, rows, arity=arity, height=height) == plain_manifest(rows, arity)


def test_one_row_is_its_own_root(spark):
    [row] = made(spark, [(3, "x", "t")])
    assert row[1] == row[2] == row[3] and row[4] == ()


def test_no_rows(spark):
    assert made(spark, []) == []


def test_a_changed_leaf_leads_elsewhere(spark):
    docs = spark.createDataFrame(table([9]), "doc_id long, lang string, text string")
    out = merkle.manifest(docs, merkle.row_digest(F.col("doc_id"), F.col("text")), keep=["doc_id"], height=2)
    other = out.where(merkle.fold(F.sha2(F.lit("else"), 256), F.col("path")) != F.col("root"))
    assert other.count() == out.count() == 15


def test_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        merkle.manifest(spark.range(1).withColumn("lang", F.lit("x")), F.lit("y"), id_col="id", arity=1)
