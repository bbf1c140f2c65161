"""Time buckets, rates, moving averages and periodicity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from weftline.functions.names import micros
from weftline.functions.times import epoch_micros, from_micros, kind_of
from weftline.operators.spectrum import power_spectrum
from weftline.plans.ordered import framed, scan, trailing_totals

# rows above which a sliding frame, evaluated afresh per row, costs too much
LONG_FRAME = 256
# buckets that one row is spun out to at a time; a gap goes through the runs of each size
FILL_RUNS = (1_000_000, 1_000, 1)


def bucket_start(ts: str, width: str, kind: str = "timestamp_ntz") -> Column:
    """Start of the epoch-aligned bucket of ``width`` that holds ``ts``."""
    w = micros(width)
    t = epoch_micros(ts, kind)
    return from_micros(t - F.pmod(t, F.lit(w)), kind)


def bucket(
    df: DataFrame,
    ts: str,
    width: str,
    aggs: Mapping[str, Column],
    by: Sequence[str] = (),
    fill: bool = False,
    *,
    hot_rows: int | None = None,
) -> DataFrame:
    """(bucket, by, aggregates) per tumbling bucket, aligned to the epoch.

    ``fill`` adds the missing buckets of every key between the first and last
    bucket of the whole table, with NULL aggregates.  They are spun out of the
    gap that each existing bucket leaves, so there is no keys-by-time grid.  A gap is
    cut into runs before it is spun out: no row holds an array of a gap's length.
    """
    by, w = list(by), micros(width)
    kind = kind_of(df, ts)
    t = epoch_micros(ts, kind)
    start = (t - F.pmod(t, F.lit(w))).alias("_b")
    counted = df.where(F.col(ts).isNotNull()).groupBy(start, *by).agg(*[c.alias(n) for n, c in aggs.items()])
    names = list(aggs)
    if not fill:
        return counted.select(from_micros(F.col("_b"), kind).alias("bucket"), *by, *names)

    first, last = df.agg(F.min(t - F.pmod(t, F.lit(w))), F.max(t - F.pmod(t, F.lit(w)))).head()
    if first is None:
        return counted.select(from_micros(F.col("_b"), kind).alias("bucket"), *by, *names)
    near = framed(
        counted,
        by,
        ["_b"],
        lambda win: {"_prev": F.lag("_b").over(win), "_next": F.lead("_b").over(win)},
        back=1,
        ahead=1,
        hot_rows=hot_rows,
    )
    begin = F.when(F.col("_prev").isNull(), F.lit(first)).otherwise(F.col("_b"))
    stop = F.coalesce(F.col("_next") - w, F.lit(last))
    spun = near.withColumn("_f", begin).withColumn("_upto", stop)
    for run in FILL_RUNS:
        spun = spun.withColumn("_f", F.explode(F.sequence("_f", "_upto", F.lit(w * run))))
        spun = spun.withColumn("_upto", F.least("_upto", F.col("_f") + F.lit(w * (run - 1))))
    real = F.col("_f") == F.col("_b")
    return spun.select(
        from_micros(F.col("_f"), kind).alias("bucket"), *by, *[F.when(real, F.col(n)).alias(n) for n in names]
    )


def rate(
    df: DataFrame, ts: str, value: str, by: Sequence[str] = (), *, tie: Sequence[str] = (), hot_rows: int | None = None
) -> DataFrame:
    """Adds ``rate``: change of ``value`` per second since the previous row of
    the key.  NULL on the first row and where no time has passed."""
    order = [ts, *(tie or [value])]
    near = framed(
        df,
        by,
        order,
        lambda w: {"_pt": F.lag(ts).over(w), "_pv": F.lag(value).over(w)},
        back=1,
        hot_rows=hot_rows,
    )
    kind = kind_of(df, ts)
    seconds = (epoch_micros(ts, kind) - epoch_micros("_pt", kind)) / F.lit(1e6)
    change = F.col(value) - F.col("_pv")
    return near.withColumn("rate", F.try_divide(change.cast("double"), seconds)).drop("_pt", "_pv")


def event_rate(df: DataFrame, ts: str, width: str, by: Sequence[str] = ()) -> DataFrame:
    """(bucket, by, n, per_second)."""
    out = bucket(df, ts, width, {"n": F.count(F.lit(1))}, by)
    return out.withColumn("per_second", F.col("n") / F.lit(micros(width) / 1e6))


def _last(window: WindowSpec, rows: int) -> WindowSpec:
    return window.rowsBetween(-(rows - 1), 0)


def _mean(total: Column, count: Column) -> Column:
    return F.try_divide(total.cast("double"), count)


def moving_avg(
    df: DataFrame,
    ts: str,
    value: str,
    rows: int | None = None,
    range: str | None = None,
    by: Sequence[str] = (),
    *,
    tie: Sequence[str] = (),
    name: str = "moving_avg",
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds the trailing mean over the last ``rows`` rows or the last ``range`` of time,
    a double at every length.  Rows without a time are each other's frame in a range."""
    if (rows is None) == (range is None):
        raise ValueError("give either rows= or range=")
    if rows is not None and rows <= LONG_FRAME:
        return framed(
            df,
            by,
            [ts, *(tie or [value])],
            lambda w: {name: _mean(F.sum(value).over(_last(w, rows)), F.count(value).over(_last(w, rows)))},
            back=rows - 1,
            hot_rows=hot_rows,
        )
    if rows is not None:
        one = df.withColumn("_one", F.lit(1))
        ticked = scan(one, by, [ts, *(tie or [value])], sums={"_tick": "_one"}, hot_rows=hot_rows).drop("_one")
        back = rows - 1
    else:
        ticked = df.withColumn("_tick", epoch_micros(ts, kind_of(df, ts)))
        back = micros(range)
    out = trailing_totals(ticked, by, "_tick", value, back=back, hot_rows=hot_rows)
    return out.select(*df.columns, _mean(F.col("frame_sum"), F.col("frame_count")).alias(name))


def series_of(df: DataFrame, ts: str, width: str, value: Column) -> tuple[DataFrame, int]:
    """(i, y) per bucket 0..N-1 of the whole time range, and N; empty buckets have NULL."""
    w = micros(width)
    t = epoch_micros(ts, kind_of(df, ts))
    lo, hi = df.agg(F.min(t), F.max(t)).head()
    if lo is None:
        return df.sparkSession.createDataFrame([], "i bigint, y double"), 0
    first = lo - lo % w
    n = (hi - first) // w + 1
    offset = t - F.lit(first)
    index = ((offset - F.pmod(offset, F.lit(w))) / F.lit(w)).cast("bigint")
    counted = df.where(F.col(ts).isNotNull()).groupBy(index.alias("i")).agg(value.alias("y"))
    return counted.select("i", F.col("y").cast("double").alias("y")), n


def periodogram(df: DataFrame, ts: str, value: str, width: str, agg: str = "sum") -> DataFrame:
    """(k, period_seconds, power) of the bucketed, mean-removed series.

    Empty buckets count as 0.  ``power`` is |X_k|^2 / N for k = 1..N/2.
    """
    made = {"sum": F.sum(value), "avg": F.avg(value), "count": F.count(value)}[agg]
    series, n = series_of(df, ts, width, made)
    if n < 2:
        return df.sparkSession.createDataFrame([], "k bigint, period_seconds double, power double")
    total = series.agg(F.sum("y")).head()[0] or 0.0
    seconds = micros(width) / 1e6
    return power_spectrum(series, n, total / n).select(
        "k", (F.lit(n * seconds) / F.col("k")).alias("period_seconds"), "power"
    )
