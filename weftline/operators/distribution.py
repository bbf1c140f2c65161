"""Histograms, distribution functions and shapes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.special import normal_quantile
from weftline.operators.stats import _attach, cumulative_counts, percentiles
from weftline.plans.ordered import positions

# rows a top-k may bring to one task; a longer tail is numbered in place
TAIL_WINDOW = 100_000


def _bounds(df: DataFrame, col: str, lo: float | None, hi: float | None) -> tuple[float, float] | None:
    if lo is None or hi is None:
        x = F.col(col).cast("double")
        finite = F.when(F.abs(x) < F.lit(math.inf), x)
        seen = df.agg(F.min(finite), F.max(finite)).head()
        lo = seen[0] if lo is None else lo
        hi = seen[1] if hi is None else hi
    return None if lo is None or hi is None else (float(lo), float(hi))


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1, last bin closed; NULL outside."""
    if hi <= lo:
        return F.when(x == lo, F.lit(0))
    index = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins)))
    return F.when((x >= lo) & (x <= hi), F.least(F.greatest(index, F.lit(0)), F.lit(bins - 1)).cast("int"))


def _edges(bins: int, lo: float, hi: float) -> tuple[Column, Column]:
    width = (hi - lo) / bins
    b = F.col("bin").cast("double")
    return (F.lit(lo) + b * F.lit(width)).alias("lo"), (F.lit(lo) + (b + 1.0) * F.lit(width)).alias("hi")


def hist(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, lo, hi, n) for every bin, empty ones with 0.

    NaN and infinities set no edge and are in no bin, nor are values outside ``lo`` and ``hi``.
    """
    spark = df.sparkSession
    if bins < 1:
        raise ValueError("bins must be at least 1")
    ends = _bounds(df, col, lo, hi)
    if ends is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    lo, hi = ends
    counts = (
        df.select(bin_of(F.col(col).cast("double"), lo, hi, bins).alias("bin"))
        .where("bin is not null")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", *_edges(bins, lo, hi), F.coalesce("n", F.lit(0)).alias("n")
    )


def cdf(df: DataFrame, col: str, by: Sequence[str] = (), *, hot_rows: int | None = None) -> DataFrame:
    """(by, value, n, cdf, ccdf) per distinct value: P(X <= x) and P(X > x)."""
    counted = cumulative_counts(df, col, list(by), hot_rows)
    at = F.col("upto") / F.col("total")
    above = (F.col("total") - F.col("upto")) / F.col("total")
    return counted.select(*by, F.col(col).alias("value"), "n", at.alias("cdf"), above.alias("ccdf"))


def ccdf(df: DataFrame, col: str, by: Sequence[str] = (), *, hot_rows: int | None = None) -> DataFrame:
    return cdf(df, col, by, hot_rows=hot_rows).drop("cdf")


def kde(
    df: DataFrame, col: str, points: int = 64, bandwidth: float | None = None, bins: int = 512
) -> DataFrame:
    """(x, density): Gaussian kernel over bin weights, Silverman's width by default.

    The data is reduced to at most ``bins`` weights first; the kernel sum then
    costs bins * points whatever the size of the table.
    """
    x = F.col(col).cast("double")
    row = df.agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).head()
    n, sd, lo, hi = row
    if not n:
        return df.sparkSession.createDataFrame([], "x double, density double")
    if bandwidth is None:
        quarter = percentiles(df, col, [0.25, 0.75]).orderBy("p").collect()
        iqr = quarter[1]["value"] - quarter[0]["value"]
        spread = min(v for v in (sd, iqr / 1.34) if v) if (sd or iqr) else 1.0
        bandwidth = 0.9 * spread * n ** (-0.2)
    start, step = lo - 3 * bandwidth, (hi - lo + 6 * bandwidth) / max(points - 1, 1)
    weights = hist(df, col, bins, lo, hi).where("n > 0")
    centre = (F.col("lo") + F.col("hi")) / 2.0
    grid = weights.select(
        centre.alias("_c"), "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")
    ).withColumn("x", F.lit(start) + F.col("_i") * F.lit(step))
    z = (F.col("x") - F.col("_c")) / F.lit(bandwidth)
    scale = 1.0 / (n * bandwidth * math.sqrt(2.0 * math.pi))
    return (
        grid.groupBy("_i", "x")
        .agg((F.sum(F.col("n") * F.exp(F.lit(-0.5) * z * z)) * F.lit(scale)).alias("density"))
        .orderBy("_i")
        .select("x", "density")
    )


def modes(df: DataFrame, col: str, bins: int = 32) -> DataFrame:
    """(bin, x, n, smoothed): local maxima of a histogram smoothed over 3 bins.

    A plateau counts once, at its first bin.
    """
    # at most ``bins`` rows from here on
    order = Window.partitionBy(F.lit(0)).orderBy("bin")
    smooth = F.avg("n").over(order.rowsBetween(-1, 1))
    h = hist(df, col, bins).withColumn("smoothed", smooth)
    change = h.withColumn("_prev", F.lag("smoothed").over(order)).where(
        F.col("_prev").isNull() | (F.col("_prev") != F.col("smoothed"))
    )
    rising = F.col("_prev").isNull() | (F.col("_prev") < F.col("smoothed"))
    following = F.lead("smoothed").over(order)
    falling = following.isNull() | (following < F.col("smoothed"))
    return (
        change.withColumn("_falls", falling)
        .where(rising & F.col("_falls") & (F.col("smoothed") > 0))
        .select("bin", ((F.col("lo") + F.col("hi")) / 2.0).alias("x"), "n", "smoothed")
    )


def bimodal_threshold(df: DataFrame, col: str, bins: int = 64) -> DataFrame:
    """(threshold, between): Otsu's split of the histogram, one row."""
    order = Window.partitionBy(F.lit(0)).orderBy("bin")
    whole = Window.partitionBy(F.lit(0))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    mid = (F.col("lo") + F.col("hi")) / 2.0
    h = hist(df, col, bins).select(
        "bin",
        "hi",
        F.sum("n").over(running).alias("_w"),
        F.sum(F.col("n") * mid).over(running).alias("_s"),
        F.sum("n").over(whole).alias("_wt"),
        F.sum(F.col("n") * mid).over(whole).alias("_st"),
    )
    w0, w1 = F.col("_w"), F.col("_wt") - F.col("_w")
    gap = F.col("_s") / w0 - (F.col("_st") - F.col("_s")) / w1
    scored = h.where((w0 > 0) & (w1 > 0)).select("bin", "hi", (w0 * w1 * gap * gap).alias("between"))
    return scored.orderBy(F.round("between", 6).desc(), "bin").limit(1).select(F.col("hi").alias("threshold"), "between")


def split_bimodal(df: DataFrame, col: str, bins: int = 64) -> DataFrame:
    """Every row with ``side`` low/high around Otsu's threshold.

    NULL values, and tables whose values are all equal, get a NULL side.
    """
    row = bimodal_threshold(df, col, bins).head()
    cut = F.lit(row["threshold"] if row else None).cast("double")
    return df.withColumn("threshold", cut).withColumn(
        "side", F.when(F.col(col) < cut, "low").when(F.col(col) >= cut, "high")
    )


def tail(df: DataFrame, col: str, k: int) -> DataFrame:
    """(k, threshold, alpha, slope, tail_class) from the k greatest positive values.

    ``alpha`` is Hill's estimator over the k greatest against the next one;
    ``slope`` is the log-log slope of the empirical CCDF over the same values.
    """
    positive = df.where(F.col(col) > 0).select(F.col(col).cast("double").alias("x"))
    m = min(positive.count() - 1, k)
    empty = "k bigint, threshold double, alpha double, slope double, tail_class string"
    if m < 1:
        return df.sparkSession.createDataFrame([], empty)
    if m <= TAIL_WINDOW:
        # a top-k: each task keeps its own best before anything moves
        best = positive.orderBy(F.desc("x")).limit(m + 1)
        ranked = best.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("x"))))
    else:
        ranked = positions(positive, [F.desc("x")], "r").where(F.col("r") <= m).withColumn("r", F.col("r") + 1)
    within = F.col("r") <= m
    out = ranked.agg(
        F.lit(m).cast("bigint").alias("k"),
        F.max(F.when(F.col("r") == m + 1, F.col("x"))).alias("threshold"),
        F.sum(F.when(within, F.ln("x"))).alias("_logs"),
        F.regr_slope(F.when(within, F.ln(F.col("r").cast("double"))), F.when(within, F.ln("x"))).alias("slope"),
    )
    excess = F.col("_logs") / F.col("k") - F.ln("threshold")
    out = out.withColumn("alpha", F.when(excess > 0, F.lit(1.0) / excess))
    kind = F.when(F.col("alpha") <= 1, "very heavy").when(F.col("alpha") <= 3, "heavy").otherwise("light")
    return out.select("k", "threshold", "alpha", "slope", kind.alias("tail_class"))


def qq(
    df: DataFrame, col: str, other: DataFrame | None = None, points: int = 99, other_col: str | None = None
) -> DataFrame:
    """(p, x, y): matching quantiles of two samples, or of one against the
    normal distribution with its mean and sd."""
    ps = [i / (points + 1) for i in range(1, points + 1)]
    mine = percentiles(df, col, ps).withColumnRenamed("value", "y")
    if other is not None:
        theirs = percentiles(other, other_col or col, ps).withColumnRenamed("value", "x")
        return mine.join(theirs, "p").select("p", "x", "y")
    moments = df.agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    return _attach(mine, moments, []).select(
        "p", (F.col("_m") + F.col("_s") * normal_quantile(F.col("p"))).alias("x"), "y"
    )


def heatmap(df: DataFrame, x: str, y: str, xbins: int, ybins: int) -> DataFrame:
    """(xbin, ybin, n) for every cell, empty ones with 0."""
    spark = df.sparkSession
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.where(xs.isNotNull() & ys.isNotNull())
    xlo, xhi, ylo, yhi = both.agg(F.min(xs), F.max(xs), F.min(ys), F.max(ys)).head()
    if xlo is None:
        return spark.createDataFrame([], "xbin int, ybin int, n bigint")
    counts = (
        both.select(bin_of(xs, xlo, xhi, xbins).alias("xbin"), bin_of(ys, ylo, yhi, ybins).alias("ybin"))
        .groupBy("xbin", "ybin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = spark.range(xbins * ybins).select(
        F.expr(f"cast(id div {ybins} as int)").alias("xbin"), F.expr(f"cast(id % {ybins} as int)").alias("ybin")
    )
    return cells.join(counts, ["xbin", "ybin"], "left").select("xbin", "ybin", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap_hours(df: DataFrame, category: str, ts: str) -> DataFrame:
    """(category, hour, n): counts per category and hour of day, zeros included."""
    hour = F.hour(ts)
    counts = df.groupBy(category).agg(F.array(*[F.count_if(hour == h) for h in range(24)]).alias("_n"))
    return counts.select(category, F.posexplode("_n").alias("hour", "n"))
