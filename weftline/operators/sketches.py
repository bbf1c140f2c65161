"""Mergeable sketches as stored state: quantiles (KLL) and distinct counts (HyperLogLog).

A sketch is a binary column of a few kilobytes per key, whatever the number of rows, so it
can be kept in a table, and sketches of days or batches merge into those of any longer span
without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items a level of a quantile sketch holds; ranks are off by about QUANTILE_ERROR at most.
QUANTILE_K = 1000
#: Share of all rows by which a rank may be off, for QUANTILE_K (1.65 % at 200, less in proportion).
QUANTILE_ERROR = 0.005
#: Logarithm of the registers of a distinct-count sketch; its relative standard error is
#: 1.04 / sqrt(registers), DISTINCT_ERROR is three of them.
DISTINCT_LG = 14
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_LG / 2)


def quantile_sketches(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, sketch): one quantile sketch per key of the non-null numbers, NaN left out."""
    x = F.col(col).cast("double")
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.when(~F.isnan(x), x), QUANTILE_K).alias("sketch"))


def merge_quantile_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, sketch): the sketches of all finer keys as one."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", QUANTILE_K).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, p, value, n): an element whose rank is within QUANTILE_ERROR of ``p``."""
    n = F.kll_sketch_get_n_double("sketch")
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in ps]))
    return sketches.where(n > 0).select(*by, n.alias("n"), each.alias("_z")).select(*by, "_z.p", "_z.value", "n")


def rank_errors(df: DataFrame, quantiles: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """(by, p, value, error): how far the rank of ``value`` among the rows is from ``p``.

    ``quantiles`` has (by, p, value), a few rows per key.  Every row is compared with the
    quantiles of its key, so this costs a scan and a small join.
    """
    listed = quantiles.groupBy(*by).agg(F.collect_list(F.struct("p", "value")).alias("_q"))
    x = F.col(col).cast("double")
    rows = df.select(*by, x.alias("_x")).where(~F.isnan("_x")).join(listed, list(by))
    sides = F.transform("_q", lambda q: F.struct(q["p"].alias("p"), q["value"].alias("value"), (F.col("_x") < q["value"]).cast("int").alias("below"), (F.col("_x") <= q["value"]).cast("int").alias("upto")))
    counted = rows.select(*by, F.explode(sides).alias("_s")).groupBy(*by, "_s.p", "_s.value").agg(F.avg("_s.below").alias("_lo"), F.avg("_s.upto").alias("_hi"))
    off = F.greatest(F.col("_lo") - F.col("p"), F.col("p") - F.col("_hi"), F.lit(0.0))
    return counted.select(*by, "p", "value", off.alias("error"))


def distinct_sketches(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, sketch): one sketch of the distinct non-null values per key."""
    kinds = dict(df.dtypes)
    x = F.col(col) if kinds[col] in ("int", "bigint", "string", "binary") else F.col(col).cast("string")
    return df.groupBy(*by).agg(F.hll_sketch_agg(x, DISTINCT_LG).alias("sketch"))


def merge_distinct_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, sketch): the sketches of all finer keys as one."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimate(sketch: str | Column = "sketch") -> Column:
    """About how many distinct values a sketch has seen."""
    return F.hll_sketch_estimate(sketch)


def alike(one: str, other: str) -> Column:
    """Whether two sketches have seen the same values, as far as their registers tell.

    Estimates of sketches on their own also depend on the order of what they have seen;
    those of a union of two do not, so unions are compared.
    """
    of = lambda a, b: F.hll_sketch_estimate(F.hll_union(a, b))
    return (of(one, other) == of(one, one)) & (of(one, other) == of(other, other))
