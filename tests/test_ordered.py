"""The split way of every ordered operator gives what the plain window gives.

One key holds a third of the rows; ``hot_rows`` is far below that, so blocks,
halos and carries are all in use.
"""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import clean, compare, distribution, logs, plotdata, relational, stats, timeseries, windows
from weftline.plans import ordered

SMALL = 7


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        value = None if rng.random() < 0.2 else float(rng.randint(0, 20))
        rows.append((i, key, 1_700_000_000 + rng.randint(0, 4000) * 60, value))
    df = spark.createDataFrame(rows, "id bigint, k string, s bigint, v double")
    out = df.select("id", "k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "v")
    return out.repartition(5).cache()


def rows(df):
    named = sorted(df.dtypes)
    rounded = df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in named])
    return sorted(tuple(str(v) for v in r) for r in rounded.collect())


def same(build):
    plain, split = build(None), build(SMALL)
    assert sorted(plain.columns) == sorted(split.columns)
    assert rows(plain) == rows(split)
    assert rows(plain)


def test_positions_are_a_permutation_in_order(skewed):
    got = ordered.positions(skewed, ["k", "ts", "id"]).orderBy("pos").select("pos", "id").collect()
    want = [r["id"] for r in skewed.orderBy("k", "ts", "id").collect()]
    assert [r["pos"] for r in got] == list(range(300))
    assert [r["id"] for r in got] == want


def test_positions_of_nothing(skewed):
    assert ordered.positions(skewed.where("false"), ["id"]).count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
def test_scan(skewed, by):
    same(lambda hot: ordered.scan(
        skewed, by, ["ts", "id"], sums={"run": "id"}, lasts={"seen": "v"}, totals={"all": "id"}, hot_rows=hot
    ))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_framed(skewed, by):
    same(lambda hot: ordered.framed(
        skewed, by, ["ts", "id"],
        lambda w: {"p": F.lag("v", 3).over(w), "n": F.lead("id", 2).over(w), "m": F.sum("id").over(w.rowsBetween(-3, 2))},
        back=3, ahead=2, hot_rows=hot,
    ))


def test_framed_wider_than_a_block(skewed):
    same(lambda hot: ordered.framed(
        skewed, ["k"], ["ts", "id"], lambda w: {"m": F.sum("id").over(w.rowsBetween(-40, 0))}, back=40, hot_rows=hot
    ))


def test_framed_range(skewed):
    ticked = skewed.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    same(lambda hot: ordered.framed_range(
        ticked, ["k"], "t", lambda w: {"n": F.count(F.lit(1)).over(w), "x": F.max("id").over(w)}, back=3_600_000_000, hot_rows=hot
    ))


@pytest.mark.parametrize("hot", [None, SMALL])
def test_trailing_totals(skewed, hot):
    ticked = skewed.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    for back in (0, 59_999_999, 3_600_000_000, 10**12):
        want = ordered.trailing_totals(ticked, ["k"], "t", "v", back=back, frame_rows=10**6)
        got = ordered.trailing_totals(ticked, ["k"], "t", "v", back=back, hot_rows=hot, frame_rows=0)
        assert rows(want) == rows(got)


def test_long_row_frames(skewed, monkeypatch):
    want = timeseries.moving_avg(skewed, "ts", "v", rows=20, by=["k"], tie=["id"])
    monkeypatch.setattr(timeseries, "LONG_FRAME", 3)
    assert rows(timeseries.moving_avg(skewed, "ts", "v", rows=20, by=["k"], tie=["id"])) == rows(want)


def test_rank_rows(skewed):
    same(lambda hot: ordered.rank_rows(skewed, [F.desc("v"), F.asc("id")], hot_rows=hot))


def test_asof_join(skewed):
    left = skewed.where("id % 2 = 0").select("id", "k", "ts")
    right = skewed.where("id % 2 = 1").select("k", F.col("ts").alias("at"), F.col("v").alias("w"))
    same(lambda hot: relational.asof_join(left, right, "ts", ["k"], right_on="at", hot_rows=hot))
    same(lambda hot: relational.asof_join(left, right, "ts", [], right_on="at", tolerance="10 minutes", hot_rows=hot))


def test_ranks(skewed):
    same(lambda hot: windows.ranks(skewed, ["k"], ["v"], ["id"], ntile=7, hot_rows=hot))


def test_neighbours(skewed):
    same(lambda hot: windows.neighbours(skewed, ["k"], ["ts", "id"], {"a": ("v", -2), "b": ("v", 1)}, hot_rows=hot))


@pytest.mark.parametrize("ps", [[0.0, 0.3, 1.0], [i / 40 for i in range(41)]])
def test_percentiles(skewed, ps):
    same(lambda hot: stats.percentiles(skewed, "v", ps, ["k"], hot_rows=hot))
    want = skewed.groupBy("k").agg(F.expr("percentile(v, array(" + ",".join(f"{p}D" for p in ps) + "))").alias("q"))
    want = want.select("k", F.explode(F.arrays_zip(F.lit(ps).alias("p"), F.col("q").alias("value"))).alias("z")).select("k", "z.*")
    assert rows(stats.percentiles(skewed, "v", ps, ["k"])) == rows(want)


def test_summaries(skewed):
    same(lambda hot: stats.stats(skewed, ["id", "k", "v"], hot_rows=hot))
    same(lambda hot: stats.group_stats(skewed, ["k"], "v", hot_rows=hot))
    same(lambda hot: stats.group_stats(skewed, [], "v", hot_rows=hot))
    for method in ("iqr", "mad"):
        same(lambda hot: stats.outlier_bounds(skewed, "v", method, 1.0, ["k"], hot_rows=hot))


def test_distributions(skewed):
    same(lambda hot: distribution.cdf(skewed, "v", ["k"], hot_rows=hot))
    same(lambda hot: distribution.cdf(skewed, "v", hot_rows=hot))


def test_time_series(skewed):
    same(lambda hot: timeseries.rate(skewed, "ts", "v", ["k"], tie=["id"], hot_rows=hot))
    same(lambda hot: timeseries.moving_avg(skewed, "ts", "v", rows=4, by=["k"], tie=["id"], hot_rows=hot))
    same(lambda hot: timeseries.moving_avg(skewed, "ts", "v", range="2 hours", by=["k"], hot_rows=hot))
    aggs = {"n": F.count(F.lit(1))}
    same(lambda hot: timeseries.bucket(skewed, "ts", "1 hour", aggs, ["k"], fill=True, hot_rows=hot))


def test_comparisons(skewed):
    two = skewed.where("k in ('hot', 'a')")
    same(lambda hot: compare.ks_test(two, "k", "v", hot_rows=hot))
    same(lambda hot: compare.mann_whitney(two, "k", "v", hot_rows=hot))
    same(lambda hot: compare.change_points(skewed, "ts", "v", "1 hour", hot_rows=hot))


def test_cleaning(skewed):
    same(lambda hot: clean.gaps(skewed, "ts", "30 minutes", ["k"], hot_rows=hot))
    same(lambda hot: clean.id_gaps(skewed.where("id % 5 <> 2"), "id", hot_rows=hot))
    same(lambda hot: clean.fill(skewed, "v", "forward", order=["ts", "id"], by=["k"], hot_rows=hot))


def test_log_templates(skewed):
    lines = skewed.select(F.concat(F.coalesce("k", F.lit("none")), F.lit(" saw "), "id").alias("line"))
    same(lambda hot: logs.log_templates(lines, "line", hot_rows=1 if hot else None))


def test_all_points_of_a_chart(skewed):
    some = plotdata.plot_series(skewed, "id", ["v"], limit=300, order=["id"])
    every = plotdata.plot_series(skewed, "id", ["v"], limit=None, order=["id"])
    assert rows(some) == rows(every)


@pytest.mark.parametrize("frame_rows", [0, 10**6])
def test_rows_without_a_time_frame_each_other(spark, frame_rows):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", None, 2), ("a", 5, 4), ("a", 6, 8), ("b", None, None), ("b", 1, 16)], "k string, t long, v long"
    )
    got = ordered.trailing_totals(df, ["k"], "t", "v", back=1, frame_rows=frame_rows)
    assert sorted((r.k, r.t or -1, r.v or -1, r.frame_sum, r.frame_count) for r in got.collect()) == [
        ("a", -1, 1, 3, 2), ("a", -1, 2, 3, 2), ("a", 5, 4, 4, 1), ("a", 6, 8, 12, 2), ("b", -1, -1, None, 0), ("b", 1, 16, 16, 1),
    ]


def test_moving_avg_has_one_type(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS ts, cast(id / 3 AS decimal(10, 2)) AS v FROM range(20)")
    few, many = (timeseries.moving_avg(df, "ts", "v", rows=n) for n in (10, 300))
    assert dict(few.dtypes)["moving_avg"] == dict(many.dtypes)["moving_avg"] == "double"


def test_a_long_gap_is_filled_in_runs(spark, monkeypatch):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) AS ts FROM VALUES (0), (1), (997), (1000) AS t(s)")
    aggs = {"n": F.count(F.lit(1))}
    want = rows(timeseries.bucket(df, "ts", "1 second", aggs, fill=True))
    monkeypatch.setattr(timeseries, "FILL_RUNS", (100, 7, 1))
    got = timeseries.bucket(df, "ts", "1 second", aggs, fill=True)
    # 100 is no multiple of 7: runs end at the run around them
    assert rows(got) == want and got.count() == 1001 and got.select("bucket").distinct().count() == 1001


def test_histogram_edges_are_finite(spark):
    df = spark.sql("SELECT cast(v AS double) AS v FROM VALUES ('NaN'), ('Infinity'), ('-Infinity'), ('0'), ('1'), ('4'), (NULL) AS t(v)")
    got = [(r.lo, r.hi, r.n) for r in distribution.hist(df, "v", 2).orderBy("bin").collect()]
    assert got == [(0.0, 2.0, 2), (2.0, 4.0, 1)]
