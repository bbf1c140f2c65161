"""Ordered computations that survive hot keys.

A Spark window puts every row of one key into one task.  That is the cheapest
plan while the largest key is small, and it breaks when one key holds a third
of the table.  Each operator here measures the largest key first (one pass over
the key columns, combined map-side) and

* uses the ordinary window when the largest key has at most ``hot_rows`` rows;
* otherwise sorts the rows globally over (key, order), so that a hot key spans
  many tasks, numbers them, and works on equal blocks of ``hot_rows`` rows.
  What a block needs from its neighbours is either a short halo of copied rows
  or one carried summary row per (block, key).

Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weftline.functions.names import whole_numbers
from weftline.session import durable

HOT_ROWS = 5_000_000

_PARTITION_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def largest_key(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the most frequent key (all rows when there is no key)."""
    if not by:
        return df.count()
    top = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).head()[0]
    return top or 0


def _needs_split(df: DataFrame, by: Sequence[str], hot_rows: int | None) -> bool:
    return largest_key(df, by) > (HOT_ROWS if hot_rows is None else hot_rows)


def _key_window(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _columns(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def positions(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Number the rows 0.. in a global order with no one-task window.

    The range-partitioned sort is written out before it is counted: its
    boundaries come from a sample, so a second run could cut elsewhere.
    """
    placed = df.orderBy(*_columns(order)) if order else df
    held = durable(placed.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", _PARTITION_BITS).cast("int")
    # one row per sort partition, at most spark.sql.shuffle.partitions of them
    counts = {r[0]: r[1] for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    first = whole_numbers(offsets or [0])
    local = F.col("_mid").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return held.withColumn(name, first[part] + local).drop("_mid")


def rank_rows(
    df: DataFrame, order: Sequence[str | Column], name: str = "rn", hot_rows: int | None = None, rows: int | None = None
) -> DataFrame:
    """``row_number()`` from 1 over the whole table.  ``rows``, where it is known how many
    there are at most, saves making ``df`` once just to count it."""
    if (rows if rows is not None else df.count()) > (HOT_ROWS if hot_rows is None else hot_rows):
        return positions(df, order, name).withColumn(name, F.col(name) + 1)
    return df.withColumn(name, F.row_number().over(_key_window([]).orderBy(*_columns(order))).cast("bigint"))


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe equality of ``keys``, keeping the left keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(renamed, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    *,
    sums: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    hot_rows: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Running state per key in the given order.

    ``sums``: inclusive running sums; ``lasts``: the latest non-null value up
    to this row; ``totals``: the sum over the whole key.  Each maps the new
    column to its source column.  ``split`` overrides the size check.
    """
    sums, lasts, totals = dict(sums or {}), dict(lasts or {}), dict(totals or {})
    by = list(by)
    if split is None:
        split = _needs_split(df, by, hot_rows)
    if not split:
        running = _key_window(by).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*",
            *[F.sum(c).over(running).alias(n) for n, c in sums.items()],
            *[F.last(c, ignorenulls=True).over(running).alias(n) for n, c in lasts.items()],
            *[F.sum(c).over(_key_window(by)).alias(n) for n, c in totals.items()],
        )

    rows = HOT_ROWS if hot_rows is None else max(hot_rows, 1)
    placed = positions(df, [*by, *order], "_pos").withColumn("_block", F.expr(f"_pos div {rows}"))
    inside = Window.partitionBy("_block", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "*",
        *[F.sum(c).over(inside).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(inside).alias(f"_l_{n}") for n, c in lasts.items()],
    )
    summary = placed.groupBy("_block", *by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_cs_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_cl_{n}") for n, c in lasts.items()],
        *[F.sum(c).alias(f"_ct_{n}") for n, c in totals.items()],
    )
    # one row per block and key from here: a hot key has rows / hot_rows of them
    earlier = _key_window(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        "_block",
        *by,
        *[F.sum(f"_cs_{n}").over(earlier).alias(f"_cs_{n}") for n in sums],
        *[F.last(f"_cl_{n}", ignorenulls=True).over(earlier).alias(f"_cl_{n}") for n in lasts],
        *[F.sum(f"_ct_{n}").over(_key_window(by)).alias(n) for n in totals],
    )

    def plus_carry(n: str) -> Column:
        here, before = F.col(f"_s_{n}"), F.col(f"_cs_{n}")
        return F.when(here.isNull() | before.isNull(), F.coalesce(here, before)).otherwise(here + before)

    joined = _match(local, carried, ["_block", *by])
    return joined.select(
        *df.columns,
        *[plus_carry(n).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in lasts],
        *totals,
    )


def framed(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    back: int = 0,
    ahead: int = 0,
    hot_rows: int | None = None,
) -> DataFrame:
    """Window columns that look at most ``back`` rows behind and ``ahead`` rows on.

    ``columns`` gets the ordered window and returns the new columns.
    """
    by = list(by)
    if not _needs_split(df, by, hot_rows):
        made = columns(_key_window(by).orderBy(*_columns(order)))
        return df.select("*", *[c.alias(n) for n, c in made.items()])

    rows = max(HOT_ROWS if hot_rows is None else hot_rows, back, ahead, 1)
    placed = positions(df, [*by, *order], "_pos")
    block, offset = f"(_pos div {rows})", f"(_pos % {rows})"
    homes = [f"named_struct('_block', {block}, '_halo', false)"]
    if back:
        homes.append(f"if({offset} >= {rows - back}, named_struct('_block', {block} + 1, '_halo', true), null)")
    if ahead:
        homes.append(f"if({offset} < {ahead}, named_struct('_block', {block} - 1, '_halo', true), null)")
    spread = placed.withColumn("_home", F.explode(F.expr(f"array_compact(array({', '.join(homes)}))")))
    spread = spread.select(*placed.columns, "_home._block", "_home._halo")
    made = columns(Window.partitionBy("_block", *by).orderBy("_pos"))
    out = spread.select("*", *[c.alias(n) for n, c in made.items()])
    return out.where(~F.col("_halo")).select(*df.columns, *made)


def framed_range(
    df: DataFrame,
    by: Sequence[str],
    ticks: str,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    back: int,
    hot_rows: int | None = None,
) -> DataFrame:
    """Window columns over the values of the long column ``ticks`` in
    ``[t - back, t]``.  ``columns`` gets a window with that range frame."""
    by = list(by)

    def trailing(window: WindowSpec) -> WindowSpec:
        return window.orderBy(ticks).rangeBetween(-back, 0)

    if not _needs_split(df, by, hot_rows):
        made = columns(trailing(_key_window(by)))
        return df.select("*", *[c.alias(n) for n, c in made.items()])

    rows = max(HOT_ROWS if hot_rows is None else hot_rows, 1)
    lo, hi, n = df.agg(F.min(ticks), F.max(ticks), F.count(F.lit(1))).head()
    if lo is None:
        lo, hi = 0, 0
    # slabs of the time line, never narrower than the frame so one halo is enough
    width = max(back + 1, (hi - lo + 1) * rows // max(n, 1), 1)
    slab = f"floor(({ticks} - {lo}) / {width})"
    homes = (
        f"array_compact(array(named_struct('_block', cast({slab} as bigint), '_halo', false), "
        f"if({ticks} - {lo} >= ({slab} + 1) * {width} - {back}, "
        f"named_struct('_block', cast({slab} + 1 as bigint), '_halo', true), null)))"
    )
    spread = df.withColumn("_home", F.explode(F.expr(homes))).select(*df.columns, "_home._block", "_home._halo")
    made = columns(trailing(Window.partitionBy("_block", *by)))
    out = spread.select("*", *[c.alias(c_name) for c_name, c in made.items()])
    return out.where(~F.col("_halo")).select(*df.columns, *made)


FRAME_ROWS = 500


def trailing_totals(
    df: DataFrame,
    by: Sequence[str],
    ticks: str,
    col: str,
    *,
    back: int,
    names: tuple[str, str] = ("frame_sum", "frame_count"),
    hot_rows: int | None = None,
    frame_rows: int | None = None,
) -> DataFrame:
    """Sum and count of ``col`` over ``[t - back, t]`` of the long column ``ticks``.

    Spark evaluates a sliding frame afresh for every row, which costs rows times
    frame length.  Where frames are long this uses tiles as wide as the frame
    instead: a frame is the end of one tile plus the start of the next, so a
    running total from each side of a tile gives every frame in one pass, with
    nothing subtracted.  Rows of equal key and time are summed first.  Rows without a
    time have the key's rows without a time as their frame, as in SQL, on both ways.
    """
    by, (total, count) = list(by), names
    width = back + 1
    tile = F.floor(F.col(ticks) / F.lit(width)).cast("bigint")
    tiled = df.where(F.col(ticks).isNotNull()).select(*by, tile.alias("_tile"))
    if largest_key(tiled, [*by, "_tile"]) <= (FRAME_ROWS if frame_rows is None else frame_rows):
        frame = lambda w: {total: F.sum(col).over(w), count: F.count(col).over(w)}
        return framed_range(df, by, ticks, frame, back=back, hot_rows=hot_rows)

    points = df.where(F.col(ticks).isNotNull()).groupBy(*by, F.col(ticks).alias("_t")).agg(
        F.sum(col).alias("_s"), F.count(col).alias("_n")
    )
    place = lambda t: F.floor(t / F.lit(width)).cast("bigint")
    starts = scan(
        points.withColumn("_tile", place(F.col("_t"))), [*by, "_tile"], ["_t"],
        sums={"_ss": "_s", "_nn": "_n"}, hot_rows=hot_rows,
    ).select(*by, "_t", F.col("_ss").alias("_s"), F.col("_nn").alias("_n"))

    # the frame of t reaches down to t - back: ask the tile below for its end from
    # there; the first tick of the own tile has nothing below it but that
    data = points.select(*by, place(F.col("_t")).alias("_tile"), (-F.col("_t")).alias("_down"), F.lit(0).alias("_ask"),
                         F.lit(None).cast("bigint").alias("_for"), "_s", "_n")
    low = F.col("_t") - F.lit(back)
    asks = points.select(*by, place(low).alias("_tile"), (-low).alias("_down"), F.lit(1).alias("_ask"),
                         F.col("_t").alias("_for"), F.lit(None).cast(points.schema["_s"].dataType).alias("_s"),
                         F.lit(0).cast("bigint").alias("_n")).where(place(F.col("_for")) > F.col("_tile"))
    rests = scan(
        data.unionByName(asks), [*by, "_tile"], ["_down", "_ask"], sums={"_ss": "_s", "_nn": "_n"}, hot_rows=hot_rows
    ).where("_ask = 1").select(*by, F.col("_for").alias("_t"), F.col("_ss").alias("_s"), F.col("_nn").alias("_n"))
    frames = starts.unionByName(rests).groupBy(*by, "_t").agg(
        F.sum("_s").alias(total), F.coalesce(F.sum("_n"), F.lit(0)).alias(count)
    )
    timeless = df.where(F.col(ticks).isNull()).groupBy(*by, F.col(ticks).alias("_t")).agg(
        F.sum(col).alias(total), F.count(col).alias(count)
    )
    joined = _match(df.withColumn("_t", F.col(ticks)), frames.unionByName(timeless), [*by, "_t"])
    return joined.select(*df.columns, total, count)
