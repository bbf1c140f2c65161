"""Known values and edge inputs: empty, one row, all NULL, all equal, ties."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import special
from weftline.functions.dialect import java_pattern
from weftline.functions.names import micros, quoted
from weftline.functions.times import epoch_micros, from_micros
from weftline.operators import clean, compare, distribution, logs, plotdata, relational, stats, timeseries
from weftline.operators.spectrum import power_spectrum
from weftline.streaming.ingest import drain_to, into_incremental, stream_bucket_counts


def values(df):
    return sorted(tuple(r) for r in df.collect())


def numbers(spark, xs):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double")


def series(spark, pairs):
    df = spark.createDataFrame(pairs, "s bigint, v double")
    return df.select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "v")


EDGES = {"empty": [], "one": [5], "nulls": [None, None], "equal": [3, 3, 3]}


@pytest.mark.parametrize("name", EDGES)
def test_edge_inputs(spark, name):
    xs = EDGES[name]
    df = numbers(spark, xs)
    present = [x for x in xs if x is not None]
    assert sum(r["n"] for r in distribution.hist(df, "x", 4).collect()) == len(present)
    top = distribution.cdf(df, "x").orderBy(F.desc("value")).head()
    assert top is None if not present else (top["cdf"], top["ccdf"]) == (1.0, 0.0)
    row = stats.stats(df).head()
    assert (row["count"], row["nulls"]) == (len(present), len(xs) - len(present))
    assert row["distinct"] == len(set(present)) and row["q50"] == (present[0] if present else None)
    for method in ("iqr", "zscore", "mad"):
        assert stats.outliers(df, "x", method).count() == 0
    assert distribution.kde(df, "x", 8).count() == (8 if present else 0)
    assert distribution.modes(df, "x", 4).count() == (1 if present else 0)
    assert distribution.bimodal_threshold(df, "x").count() == 0
    assert {r["side"] for r in distribution.split_bimodal(df, "x").collect()} <= {None}
    assert distribution.tail(df, "x", 3).count() == (1 if len(present) > 1 else 0)
    assert stats.fit(df, "x").count() >= 0
    assert stats.percentiles(df, "x", [0.5]).count() == 1
    assert clean.nulls(df).head()["nulls"] == len(xs) - len(present)
    points = plotdata.plot_series(df.withColumn("k", F.lit("k")), "k", ["x"])
    assert plotdata.bar_layout(points).count() == (len(xs) if present else 0)
    assert plotdata.line_layout(points).count() <= max(len(xs), 0)


def test_special_functions(spark):
    row = spark.range(1).select(
        special.erf(F.lit(0.5)), special.normal_cdf(F.lit(1.96)), special.normal_quantile(F.lit(0.975)),
        special.normal_quantile(F.lit(0.001)), special.kolmogorov_p(F.lit(1.0)),
        special.student_two_sided_p(F.lit(2.0), F.lit(10.0)),
    ).head()
    for got, want in zip(row, (0.5204999, 0.9750021, 1.959964, -3.090232, 0.2699997, 0.0733880)):
        assert got == pytest.approx(want, abs=1e-6)


def test_two_sample_tests(spark):
    a, b = [1, 2, 3, 4, 5, 5], [4, 5, 6, 7, 8]
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, x double")
    t = compare.t_test(df, "g", "x").head()
    assert (t["t"], t["dof"], t["p"]) == (pytest.approx(-2.743977, abs=1e-5), pytest.approx(8.7443, abs=1e-3), pytest.approx(0.0233, abs=1e-3))
    assert compare.ks_test(df, "g", "x").head()["d"] == pytest.approx(0.6)
    u = compare.mann_whitney(df, "g", "x").head()
    pairs = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert u["u"] == pytest.approx(pairs) and 0 < u["p"] < 0.1
    same = compare.ks_test(df.withColumn("g", F.when(F.rand(1) < 2, "a")).union(df.withColumn("g", F.lit("b"))), "g", "x").head()
    assert (same["d"], same["p"]) == (0.0, 1.0)
    with pytest.raises(ValueError):
        compare.t_test(df.where("g = 'a'"), "g", "x")


def test_fit_prefers_the_true_family(spark):
    base = spark.range(1, 20001).withColumn("u", F.col("id") / 20001.0)
    assert stats.fit(base.select((-F.ln("u") * 4).alias("x")), "x").head()["model"] == "exponential"
    assert stats.fit(base.select(F.pow("u", -0.5).alias("x")), "x").head()["model"] == "pareto"
    normal = stats.fit(base.select((special.normal_quantile(F.col("u")) * 3 + 1).alias("x")), "x").head()
    assert normal["model"] == "normal" and normal["param2"] == pytest.approx(3, abs=0.01)
    assert distribution.tail(base.select(F.pow("u", -0.5).alias("x")), "x", 500).head()["tail_class"] == "heavy"


def test_long_tails_agree_with_short_ones(spark, monkeypatch):
    df = spark.range(1, 400).select((F.col("id") % 90 + 1).cast("double").alias("x"))
    short = distribution.tail(df, "x", 60).head()
    monkeypatch.setattr(distribution, "TAIL_WINDOW", 5)
    long = distribution.tail(df, "x", 60).head()
    assert tuple(long)[:4] == pytest.approx(tuple(short)[:4]) and long["tail_class"] == short["tail_class"]


def test_periodogram_ways_agree(spark):
    n = 300
    df = spark.range(n).where("id % 7 <> 3").select(
        F.col("id").alias("i"), (F.sin(F.col("id") * 2 * math.pi / 12) * 3 + F.col("id") % 5 + 40).alias("y")
    )
    mean = df.agg(F.sum("y")).head()[0] / n
    direct = {r["k"]: r["power"] for r in power_spectrum(df, n, mean).collect()}
    split = {r["k"]: r["power"] for r in power_spectrum(df, n, mean, direct=10).collect()}
    assert sorted(direct) == sorted(split) == list(range(1, n // 2 + 1))
    for k in direct:
        assert split[k] == pytest.approx(direct[k], rel=1e-6, abs=1e-6)


def test_periodogram_finds_the_day(spark):
    df = series(spark, [(h * 3600, 10 + 5 * math.sin(2 * math.pi * h / 24)) for h in range(240)])
    best = timeseries.periodogram(df, "ts", "v", "1 hour").orderBy(F.desc("power")).head()
    assert best["period_seconds"] == 86400


def test_change_point(spark):
    df = series(spark, [(i * 60, 1.0 if i < 30 else 9.0) for i in range(50)])
    row = compare.change_point(df, "ts", "v", "1 minute").head()
    assert (row["i"], row["mean_before"], row["mean_after"]) == (29, 1.0, 9.0)


def test_rate_and_gaps(spark):
    df = series(spark, [(0, 1.0), (10, 6.0), (10, 7.0), (100, 7.0)])
    assert [r["rate"] for r in timeseries.rate(df, "ts", "v").orderBy("ts", "v").collect()] == [None, 0.5, None, 0.0]
    gap = clean.gaps(df, "ts", "10 seconds").collect()
    assert len(gap) == 1 and gap[0]["missing"] == 8
    assert clean.id_gaps(spark.createDataFrame([(1,), (2,), (2,), (6,)], "i int"), "i").collect()[0][:] == (3, 5, 3)


def test_bucket_fill_and_alignment(spark):
    df = series(spark, [(30, 1.0), (200, 2.0)])
    out = timeseries.bucket(df, "ts", "1 minute", {"n": F.count(F.lit(1))}, fill=True).orderBy("bucket").collect()
    assert [r["n"] for r in out] == [1, None, None, 1]
    assert out[0]["bucket"].minute == 0


def test_time_arithmetic_ignores_the_session_zone(spark):
    stamps = ["2024-03-10 02:30:00.123456", "2024-11-03 01:30:00", "1950-06-01 00:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").selectExpr("cast(s as timestamp_ntz) AS ts")
    utc = values(df.select(epoch_micros("ts")))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(df.select(epoch_micros("ts"))) == utc
        assert values(df.select(from_micros(epoch_micros("ts")))) == values(df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_compare_tables(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (3, "z", 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (4, "w", 4.0)], "k int, s string, v double")
    assert values(compare.compare(a, b, ["k"])) == [(1, "same", []), (2, "changed", ["v"]), (3, "removed", []), (4, "added", [])]
    assert compare.compare(a, a).count() == 0
    assert values(compare.compare_counts(a, b)) == [("added", 2), ("removed", 2)]
    twice = a.union(a.where("k = 1"))
    assert compare.compare(a, twice).collect()[0]["copies"] == 1


def test_relational(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 3), (None, 9)], "g string, v int")
    assert [tuple(r) for r in relational.top_n(df, "g", F.sum("v"), 2, "t").collect()] == [(None, 9), ("a", 4)]
    assert relational.pivot(df, ["v"], "g", F.count(F.lit(1))).columns == ["v", "a", "b"]
    assert values(clean.dedup(df, ["v"], ["g"]).where("v = 3")) == [("a", 3)]
    points = spark.createDataFrame([(i,) for i in range(-5, 40)], "p bigint")
    ranges = spark.createDataFrame([(0, 0), (-3, 10), (5, 4), (7, 39), (30, 31)], "lo bigint, hi bigint")
    got = values(relational.range_join(points, ranges, "p", "lo", "hi"))
    assert got == sorted((p, lo, hi) for (p,) in values(points) for lo, hi in values(ranges) if lo <= p <= hi)


def test_null_keys_never_match_as_of(spark):
    left = spark.createDataFrame([(None, 5), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([(None, 1, "n"), ("a", 2, "x"), ("a", 2, "y"), ("a", 6, "z")], "k string, t int, v string")
    got = {r["k"]: r["v"] for r in relational.asof_join(left.withColumn("t", F.timestamp_seconds("t")), right.withColumn("t", F.timestamp_seconds("t")), "t", ["k"]).collect()}
    assert got == {None: None, "a": "y"}


def test_coerce_and_types(spark):
    df = spark.createDataFrame([("1", "2.5", "2024-01-01", "true", "x", " "), ("2", "1e3", "2024-01-02 10:00:00", "no", "1", None)], "a string, b string, c string, d string, e string, f string")
    assert {r[0]: r[2] for r in clean.suggest_types(df).collect()} == {
        "a": "bigint", "b": "double", "c": "timestamp_ntz", "d": "boolean", "e": "string", "f": "string",
    }
    assert values(clean.coerce_report(df, {"e": "int"})) == [("e", "int", 2, 1)]
    assert values(clean.coerce(df, {"e": "int"}).select("e").na.fill(-1)) == [(-1,), (1,)]


def test_log_templates(spark):
    lines = [f"login user{i} ok from 10.0.0.{i}" for i in range(12)] + ["disk full", 'read "a b" took 12ms at /var/x', None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [(r["template_id"], r["pattern"], r["count"]) for r in logs.log_templates(df, "line").orderBy("template_id").collect()]
    assert got[0] == (1, "login <*> ok from <ip>", 12)
    assert {p for _, p, _ in got[1:]} == {"disk full", "read <quoted> took 12ms at <path>"}
    found = {r["line"]: r["values"] for r in logs.log_records(df, "line").collect()}
    assert found["login user3 ok from 10.0.0.3"] == ["user3", "10.0.0.3"] and found["disk full"] == []
    assert found['read "a b" took 12ms at /var/x'][0] == '"a b"'


def test_chart_layouts(spark):
    # labels take 20 of the 50 columns, the figures 12, so the longest bar has 18
    sites = [(0, "north", 9.5), (1, "south-west regional office", 4.0), (2, "east", -3.0), (3, "hub", 9.5), (4, "dock", 0.5)]
    sites = spark.createDataFrame(sites, "o int, x string, n double")
    bars = plotdata.bar_layout(plotdata.plot_series(sites, "x", ["n"], order=["o"]), 50).orderBy("ord").collect()
    assert [(r["label"], r["len"]) for r in bars] == [("north", 18), ("south-west regional ", 7), ("east", 0), ("hub", 18), ("dock", 0)]
    text = plotdata.plot_series(sites, "x", ["n", "x"], order=["o"])
    assert {r["y"] for r in text.where("series = 'x'").collect()} == {0.0}
    assert plotdata.bar_layout(text.where("series = 'x'")).count() == 0
    negative = spark.createDataFrame([("a", -2.0), ("b", 4.0)], "x string, y double")
    assert [r["len"] for r in plotdata.bar_layout(plotdata.plot_series(negative, "x", ["y"])).orderBy("label").collect()] == [0, 67]
    # 6 rows and 22 columns of cells; values from -1 to 5, the greatest twice
    depth = spark.createDataFrame([(1, 3.0), (2, -1.0), (3, 5.0), (4, 5.0), (5, 0.0)], "x int, y double")
    cells = values(plotdata.line_layout(plotdata.plot_series(depth, "x", ["y"], order=["x"]), 30, 8))
    assert sorted(cells) == [(0, 10, "●"), (0, 15, "●"), (2, 0, "●"), (5, 5, "●"), (5, 21, "●")]
    two = plotdata.plot_series(depth, "x", ["y", "y + 0"], order=["x"])
    assert {r["marker"] for r in plotdata.line_layout(two, 30, 8).collect()} == {"○"}
    with pytest.raises(ValueError):
        plotdata.plot_series(depth.select("x"))


def test_records_of_long_tokens(spark):
    lines = ["job 1 wrote " + "Zm9v" * 25_000, "job 2 wrote /" + "a" * 50_000]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert logs.log_records(df, "line").count() == 2


def test_byte_sizes():
    from weftline.session import byte_size

    assert [byte_size(x) for x in ("134217728b", "256m", "1g", "64KB", "7")] == [134217728, 256 << 20, 1 << 30, 64 << 10, 7]


def test_names_and_patterns():
    assert quoted("a.b`c") == "`a`.`b``c`"
    assert micros("15 minutes") == 900_000_000
    assert java_pattern("%Y-%m-%d %H:00 h") == "yyyy-MM-dd HH:00 'h'"
    for bad in ("soon", "0 days", "1 month"):
        with pytest.raises(ValueError):
            micros(bad)


# --- streaming -------------------------------------------------------------------


def test_incremental_reads_each_file_once(spark, tmp_path):
    arriving = str(tmp_path / "in")
    put = {"directory": arriving, "schema": "id bigint", "checkpoint": str(tmp_path / "cp"), "location": str(tmp_path / "t")}
    spark.range(5).coalesce(1).write.parquet(arriving)
    assert into_incremental(spark, "incr_t", **put).rows == 5
    assert into_incremental(spark, "incr_t", **put).batches == ()
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(arriving)
    assert into_incremental(spark, "incr_t", **put).rows == 3
    assert values(spark.table("incr_t")) == [(i,) for i in range(8)]


def test_late_rows_are_dropped_and_closed_windows_equal_the_batch(spark, tmp_path):
    arriving, schema = str(tmp_path / "in"), "ts timestamp_ntz, k string"

    def deliver(minutes):
        rows = spark.createDataFrame([(m * 60,) for m in minutes], "s bigint")
        rows.select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), F.lit("a").alias("k")).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(schema).parquet(arriving)
        drain_to(stream_bucket_counts(stream, "ts", "10 minutes", ["k"], "5 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))

    deliver([1, 2, 11, 31])
    deliver([3, 32, 70])  # minute 3 is behind the watermark by now
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["bucket"].minute, r["n"]) for r in out.collect()) == [(0, 2), (10, 1), (30, 2)]
