"""Chart-ready series and character-cell layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import quoted
from weftline.plans.ordered import positions

# Series markers, reused in turn.
MARKERS = ("●", "○", "◆", "◇", "■", "□")


def plot_series(
    df: DataFrame,
    x: str | None = None,
    ys: Sequence[str] = (),
    limit: int | None = None,
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """(series_no, series, ord, x, y): one row per point, ``ord`` from 0 in a series.

    ``x`` is a column name, each y a SQL expression.  Without them the first
    column is x and every other column a series.  A y that is no number is 0.
    """
    ys = list(ys)
    if x is None or not ys:
        if len(df.columns) < 2:
            raise ValueError("a chart needs at least two columns")
        x, exprs, labels = df.columns[0], [quoted(c) for c in df.columns[1:]], df.columns[1:]
    else:
        exprs, labels = ys, df.select(*[F.expr(y) for y in ys]).columns
    point = [
        F.col(quoted(x)).cast("string").alias("_x"),
        *[F.coalesce(F.expr(e).try_cast("string").try_cast("double"), F.lit(0.0)).alias(f"_y{i}") for i, e in enumerate(exprs)],
    ]
    if limit is not None:
        # at most ``limit`` rows, in one partition after the limit
        first = (df.orderBy(*order) if order else df).limit(limit)
        points = first.select(*point, F.monotonically_increasing_id().alias("_id"))
        number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_id")) - 1
        placed = points.withColumn("_ord", number.cast("bigint"))
    else:
        named = [o for o in order if isinstance(o, str)]
        kept = named if len(named) == len(order) else df.columns
        placed = positions(df.select(*dict.fromkeys(kept), *point), order, "_ord")
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("series_no"), F.lit(n).alias("series"), F.col(f"_y{i}").alias("y"))
            for i, n in enumerate(labels)
        ]
    )
    return placed.select("_ord", "_x", F.explode(rows).alias("_r")).select(
        "_r.series_no", "_r.series", F.col("_ord").alias("ord"), F.col("_x").alias("x"), "_r.y"
    )


def bar_layout(series: DataFrame, width: int = 80) -> DataFrame:
    """(series, ord, label, len, value): horizontal bars scaled to ``width``.

    No rows when no value is above 0.
    """
    top, longest = series.agg(
        F.greatest(F.max("y"), F.lit(0.0)), F.coalesce(F.max(F.octet_length("x")), F.lit(5))
    ).head()
    label = min(longest, 20)
    room = max(width - label - 12, 0)
    if not top:
        return series.where("false").select(
            "series", "ord", F.col("x").alias("label"), F.lit(0).alias("len"), F.col("y").alias("value")
        )
    length = F.floor(F.greatest(F.col("y") / F.lit(float(top)) * F.lit(float(room)), F.lit(0.0))).cast("int")
    return series.select(
        "series", "ord", F.substring("x", 1, label).alias("label"), length.alias("len"), F.round("y", 1).alias("value")
    )


def line_layout(series: DataFrame, width: int = 80, height: int = 20) -> DataFrame:
    """(row, col, marker): the filled cells of a character line chart.

    Any number of points reduces to at most rows * columns cells in one
    aggregate.  A later series, or a later point, wins its cell.
    """
    rows, cols = height - 2, width - 8
    empty = "row int, col int, marker string"
    spark = series.sparkSession
    if height < 3 or cols < 1:
        return spark.createDataFrame([], empty)
    low, high = series.agg(F.min("y"), F.max("y")).head()
    if low is None:
        return spark.createDataFrame([], empty)
    spread = 1.0 if abs(high - low) < 1e-10 else high - low
    # one row per series
    lengths = series.groupBy("series_no").agg(F.count(F.lit(1)).alias("_n"))
    at = series.join(lengths, "series_no")
    col = F.when(F.col("_n") > 1, F.expr(f"ord * {cols - 1} div (_n - 1)")).otherwise(F.lit(cols // 2))
    step = F.floor((F.col("y") - F.lit(low)) / F.lit(spread) * F.lit(float(rows - 1)))
    row = F.lit(rows - 1) - F.least(step, F.lit(rows - 1))
    # points of a series share its marker; a number is kept in a hashed grouping, which sorts nothing
    cells = at.select(row.cast("int").alias("row"), col.cast("int").alias("col"), "series_no")
    last = cells.where((F.col("col") >= 0) & (F.col("col") < cols)).groupBy("row", "col").agg(F.max("series_no").alias("_s"))
    marker = F.element_at(F.lit(list(MARKERS)), (F.col("_s") % len(MARKERS) + 1).cast("int"))
    return last.select("row", "col", marker.alias("marker"))


def line_axis(series: DataFrame, height: int = 20) -> DataFrame:
    """(row, label): the value written beside each row of ``line_layout``."""
    rows = height - 2
    low, high = series.agg(F.min("y"), F.max("y")).head()
    spark = series.sparkSession
    if low is None or height < 3:
        return spark.createDataFrame([], "row int, label double")
    spread = 1.0 if abs(high - low) < 1e-10 else high - low
    r = F.col("id").cast("double")
    label = F.lit(high) - (r / F.lit(float(max(rows - 1, 1)))) * F.lit(spread)
    return spark.range(rows).select(F.col("id").cast("int").alias("row"), F.round(label, 1).alias("label"))


def scaled_series(series: DataFrame) -> DataFrame:
    """Adds ``scaled``: each series stretched to 0..1 on its own axis; 0 when flat."""
    ends = series.groupBy("series_no").agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col("y") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return series.join(ends, "series_no").withColumn("scaled", scaled).drop("_lo", "_hi")
