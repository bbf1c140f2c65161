"""Range joins against all pairs, sketches against what they sketch."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import sketches
from weftline.operators.relational import range_join


def joined(spark, points, ranges, kind, **options):
    p = spark.createDataFrame(list(enumerate(points)), f"i int, at {kind}")
    r = spark.createDataFrame([(j, lo, hi) for j, (lo, hi) in enumerate(ranges)], f"j int, lo {kind}, hi {kind}")
    return sorted((x.i, x.j) for x in range_join(p, r, "at", "lo", "hi", **options).collect())


def plain(points, ranges):
    return sorted(
        (i, j) for i, at in enumerate(points) for j, (lo, hi) in enumerate(ranges)
        if None not in (at, lo, hi) and lo <= at <= hi
    )


@pytest.mark.parametrize("depth", [0, 4])
def test_range_join_of_doubles(spark, depth):
    rng = random.Random(depth)
    draw = lambda: rng.choice([0.5, 0.0, -0.0, rng.random(), rng.gauss(0, 1e-9), rng.gauss(0, 1e200), -1.0, math.inf, -math.inf, 5e-324])
    points = [None, *(draw() for _ in range(150))]
    ranges = [(None, 1.0), (0.0, None), (1.0, 0.0), (-math.inf, math.inf)]
    ranges += [(lo, lo + rng.choice([0.0, 1e-12, 0.1, 1e199])) for lo in (draw() for _ in range(80))]
    assert joined(spark, points, ranges, "double", depth=depth) == plain(points, ranges)


def test_range_join_of_whole_numbers(spark):
    rng = random.Random(3)
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1, 7]
    points = ends + [rng.randrange(-300, 300) for _ in range(200)]
    ranges = [(ends[0], ends[1]), (ends[0], -1), (7, ends[1]), (5, 4)]
    ranges += [(lo, lo + rng.choice([0, 1, 9, 100])) for lo in (rng.randrange(-300, 300) for _ in range(100))]
    assert joined(spark, points, ranges, "bigint") == plain(points, ranges)


def test_range_join_candidates_are_few(spark, monkeypatch):
    """In the plan's join, before the exact condition, little more than the result."""
    points = spark.range(20_000).select((F.rand(1)).alias("at"))
    ranges = spark.range(2_000).select(F.rand(2).alias("lo")).withColumn("hi", F.col("lo") + 1e-3)
    within = range_join(points, ranges, "at", "lo", "hi").count()
    loose = range_join(points.withColumn("true_at", F.col("at")), ranges.withColumnsRenamed({"lo": "at_lo"}).withColumn("lo", F.col("at_lo") - 5e-4), "at", "lo", "hi").count()
    assert within == points.join(ranges, F.col("at").between(F.col("lo"), F.col("hi"))).count() > 0 and loose > within


def test_quantile_sketches_merge(spark):
    rows = spark.range(200_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 2).alias("k"), F.hash("id").cast("double").alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(0, 0, None), (0, 0, float("nan"))], "day long, k long, x double"))
    daily = sketches.quantile_sketches(rows, "x", ["k", "day"])
    merged = sketches.merge_quantile_sketches(daily, ["k"])
    found = sketches.sketched_quantiles(merged, [0.0, 0.5, 0.99, 1.0], ["k"]).collect()
    assert len(found) == 8 and {r.n for r in found} == {100_000}
    off = sketches.rank_errors(rows, sketches.sketched_quantiles(merged, [0.01, 0.5, 0.99], ["k"]), "x", ["k"]).collect()
    assert len(off) == 6 and all(r.error <= sketches.QUANTILE_ERROR for r in off)


def test_distinct_sketches_merge(spark):
    rows = spark.range(100_000).select((F.col("id") % 5).alias("day"), (F.col("id") % 20_000).alias("user"))
    daily = sketches.distinct_sketches(rows, "user", ["day"])
    whole = sketches.distinct_sketches(rows, "user")
    merged = sketches.merge_distinct_sketches(daily)
    part = sketches.distinct_sketches(rows.where("user < 15000"), "user")
    both = merged.join(whole.withColumnRenamed("sketch", "whole")).join(part.withColumnRenamed("sketch", "part"))
    row = both.select(sketches.alike("sketch", "whole").alias("a"), sketches.alike("sketch", "part").alias("b"), sketches.distinct_estimate().alias("n")).head()
    assert row.a and not row.b
    assert abs(row.n - 20_000) <= sketches.DISTINCT_ERROR * 20_000


def test_empty_tables_have_no_quantiles(spark):
    none = spark.createDataFrame([(1, None)], "k long, x double")
    assert sketches.sketched_quantiles(sketches.quantile_sketches(none, "x", ["k"]), [0.5], ["k"]).collect() == []
