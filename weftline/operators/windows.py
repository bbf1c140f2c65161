"""Window functions over whole keys that survive hot keys.

Frames of a few rows are ``plans.ordered.framed``; what is here needs the whole
key: ranks, and values at its ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.ordered import _match, _needs_split, framed, scan


def ranks(
    df: DataFrame, by: Sequence[str], order: Sequence[str], tie: Sequence[str] = (), ntile: int | None = None,
    *, hot_rows: int | None = None,
) -> DataFrame:
    """Adds row_number, rank, dense_rank, percent_rank, cume_dist (and ntile).

    ``order`` are the columns that decide ranks; ``tie`` settles row_number and
    ntile among equal ones.  Ascending, NULLs first.
    """
    by, order, tie = list(by), list(order), list(tie)
    names = ["row_number", "rank", "dense_rank", "percent_rank", "cume_dist"] + (["ntile"] if ntile else [])
    if not _needs_split(df, by, hot_rows):
        ranked = Window.partitionBy(*by).orderBy(*order)
        numbered = Window.partitionBy(*by).orderBy(*order, *tie)
        made = {
            "row_number": F.row_number().over(numbered).cast("bigint"),
            "rank": F.rank().over(ranked).cast("bigint"),
            "dense_rank": F.dense_rank().over(ranked).cast("bigint"),
            "percent_rank": F.percent_rank().over(ranked),
            "cume_dist": F.cume_dist().over(ranked),
        }
        if ntile:
            made["ntile"] = F.ntile(ntile).over(numbered).cast("bigint")
        return df.select("*", *[c.alias(n) for n, c in made.items()])

    # rank and dense_rank need the distinct order values only
    key = F.struct(*order)
    steps = df.groupBy(*by, key.alias("_o")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    stepped = scan(
        steps, by, ["_o"], sums={"_upto": "_n", "dense_rank": "_one"}, totals={"_total": "_n"}, hot_rows=hot_rows, split=True
    ).drop("_one")
    rows = scan(
        df.withColumn("_o", key).withColumn("_one", F.lit(1)), by, [*order, *tie], sums={"row_number": "_one"},
        hot_rows=hot_rows, split=True,
    ).drop("_one")
    joined = _match(rows, stepped, [*by, "_o"])
    out = joined.withColumn("rank", F.col("_upto") - F.col("_n") + 1)
    last = F.col("_total") - 1
    out = out.withColumn("percent_rank", F.when(last == 0, F.lit(0.0)).otherwise((F.col("rank") - 1) / last))
    out = out.withColumn("cume_dist", F.col("_upto") / F.col("_total"))
    if ntile:
        # the first (total mod ntile) tiles hold one row more
        small = F.expr(f"_total div {ntile}")
        extra = F.col("_total") % ntile
        long_part = extra * (small + 1)
        at = F.col("row_number") - 1
        tile = F.when(at < long_part, F.floor(at / (small + 1))).otherwise(
            extra + F.floor((at - long_part) / F.greatest(small, F.lit(1)))
        )
        out = out.withColumn("ntile", (tile + 1).cast("bigint"))
    return out.select(*df.columns, *names)


def neighbours(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], shifts: Mapping[str, tuple[str, int]],
    *, hot_rows: int | None = None,
) -> DataFrame:
    """lag and lead: each new column takes (source, k), the value k rows later
    in the key, or earlier for a negative k."""
    back = max([-k for _, k in shifts.values()] + [0])
    ahead = max([k for _, k in shifts.values()] + [0])
    return framed(
        df, by, order, lambda w: {n: F.lead(c, k).over(w) for n, (c, k) in shifts.items()},
        back=back, ahead=ahead, hot_rows=hot_rows,
    )


def ends(
    df: DataFrame, by: Sequence[str], order: Sequence[str], col: str, nth: int | None = None,
) -> DataFrame:
    """Adds first_value, last_value (and nth_value) of ``col`` over the whole key.

    The ends are found by aggregation, combined map-side; the nth row by a
    numbering that Spark cuts map-side.
    """
    by = list(by)
    at = F.struct(*order)
    found = df.groupBy(*by).agg(F.min_by(col, at).alias("first_value"), F.max_by(col, at).alias("last_value"))
    if nth:
        window = Window.partitionBy(*by).orderBy(*order)
        picked = df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= nth)
        picked = picked.where(F.col("_rn") == nth).select(*by, F.col(col).alias("nth_value"))
        found = _match(found, picked, by)
    return _match(df, found, by)
