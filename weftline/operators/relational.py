"""Relational operators that Spark SQL lacks or that need care at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import micros
from weftline.functions.times import epoch_micros, kind_of
from weftline.plans.ordered import scan

PIVOT_VALUES = 10_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    *,
    right_on: str | None = None,
    tolerance: str | None = None,
    suffix: str = "_right",
    hot_rows: int | None = None,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before ``on``.

    One shuffle over the union of both sides; no pair of rows is ever built.
    Unmatched left rows stay, with NULLs.  Right rows that tie on time are
    resolved to the greatest one, column by column, so results repeat.
    """
    by, right_on = list(by), right_on or on
    payload = [c for c in right.columns if c not in by]
    taken = set(left.columns)
    names = {c: c + suffix if c in taken else c for c in payload}

    left_rows = left.select(
        *by,
        F.col(on).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_left"),
    )
    right_rows = right.where(F.col(right_on).isNotNull()).select(
        *by,
        F.col(right_on).alias("_t"),
        F.lit(0).alias("_side"),
        F.struct(F.col(right_on).alias("_rt"), *payload).alias("_right"),
    )
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    matched = scan(both, by, ["_t", "_side", "_right"], lasts={"_hit": "_right"}, hot_rows=hot_rows)

    usable = F.col("_t").isNotNull()
    for key in by:
        usable = usable & F.col(key).isNotNull()
    if tolerance is not None:
        gap = epoch_micros("_t", kind_of(left, on)) - epoch_micros("_hit._rt", kind_of(right, right_on))
        usable = usable & (gap <= micros(tolerance))
    return matched.where(F.col("_side") == 1).select(
        "_left.*", *[F.when(usable, F.col("_hit")[c]).alias(names[c]) for c in payload]
    )


def _ticks(value: Column, kind: str) -> Column:
    """A long that is ordered as ``value``: equal ticks only for values next to each other."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.least(value.cast("bigint"), F.lit((1 << 63) - 2))
    # the bits of a double are ordered as its size; the sign bit turns that round
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double")).cast("bigint")
    sized = F.when(bits < 0, -bits.bitwiseAND(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.when(value.isNotNull(), sized)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, depth: int = 4) -> DataFrame:
    """Inner join on ``low <= point <= high`` as an equi-join on dyadic cells.

    Every range is covered by cells of power-of-two sizes, at most two of a size, the
    smallest of them 2 ** ``depth`` times smaller than the range; so the points that meet it
    without lying in it stand within that share of its ends.  Every point is looked up once
    per cell size that occurs.  Cells are cut from the bits of the values, so they are as
    fine as the values are: whole numbers, doubles, decimals, timestamps, dates.  Nulls meet
    nothing; a range whose ``low`` is above its ``high`` is empty.
    """
    kind = kind_of(points, point)
    if kind == "date" or kind.startswith("timestamp"):
        tick = lambda c, of: epoch_micros(c, kind_of(of, c))
    else:
        whole = {"tinyint", "smallint", "int", "bigint"}
        kinds = {kind, kind_of(ranges, low), kind_of(ranges, high)}
        common = kind if kinds <= whole else "double"
        tick = lambda c, of: _ticks(F.col(c), common)

    shift = lambda value, by: F.call_function("shiftright", value, by)
    span = F.try_subtract(F.col("_high"), F.col("_low"))
    size = F.when(span.isNull(), F.lit(63)).otherwise(F.length(F.bin(span))).cast("int")
    ticked = ranges.where(F.col(low) <= F.col(high)).withColumns({"_low": tick(low, ranges), "_high": tick(high, ranges)})
    ticked = ticked.withColumn("_fine", F.greatest(size - depth, F.lit(0)))

    def cells(k: Column) -> Column:
        # whole cells of this size between the ends, as far as no larger cell takes them
        first = -shift(-shift(F.col("_low"), F.col("_fine")), k)
        end = shift(shift(F.col("_high"), F.col("_fine")) + 1, k)
        cell = lambda taken, at: F.when((first < end) & taken, F.struct((F.col("_fine") + k).cast("int").alias("_level"), at.alias("_cell")))
        return F.array(cell(first % 2 != 0, first), cell(end % 2 != 0, end - 1))

    cover = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth + 2)), cells)))
    covered = ticked.select(*ranges.columns, F.explode(cover).alias("_c")).select(*ranges.columns, "_c._level", "_c._cell")
    # of a long's 64 bits, so this list is bounded
    levels = sorted(r[0] for r in covered.select("_level").distinct().collect())
    looked = points.withColumn("_level", F.explode(F.lit(levels or [0]).cast("array<int>"))).withColumn(
        "_cell", shift(tick(point, points), F.col("_level"))
    )
    inside = (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    # both sides are many times their inputs, which Spark's sizes do not tell: broadcast neither
    return looked.hint("merge").join(covered, ["_level", "_cell"]).where(inside).drop("_level", "_cell")


def qualify(df: DataFrame, window: Column, predicate: str, name: str = "_q") -> DataFrame:
    """Keep the rows whose window value ``name`` satisfies ``predicate``.

    Ranking predicates of the form ``_q <= k`` are cut map-side by Spark before
    the shuffle, so a hot key never travels whole.
    """
    return df.withColumn(name, window).where(predicate).drop(name)


def top_n(df: DataFrame, group: str | Sequence[str], measure: Column, n: int, name: str = "measure") -> DataFrame:
    """The ``n`` groups with the greatest aggregate, ties broken on the key."""
    keys = [group] if isinstance(group, str) else list(group)
    ranked = df.groupBy(*keys).agg(measure.alias(name))
    return ranked.orderBy(F.col(name).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group in ``order``, numbered from 1."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def pivot(
    df: DataFrame,
    keys: Sequence[str],
    on: str,
    agg: Column,
    values: Sequence | None = None,
) -> DataFrame:
    """Rows to columns.  Without ``values`` the distinct ones become columns;
    more than ``PIVOT_VALUES`` of them is an error, never a silent cut."""
    if values is None:
        found = df.select(on).where(F.col(on).isNotNull()).distinct().limit(PIVOT_VALUES + 1).collect()
        if len(found) > PIVOT_VALUES:
            raise ValueError(f"more than {PIVOT_VALUES} distinct values in {on!r}; pass values=")
        values = sorted(r[0] for r in found)
    return df.groupBy(*keys).pivot(on, list(values)).agg(agg)
