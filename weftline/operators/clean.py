"""Duplicates, gaps, missing values and types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import micros
from weftline.functions.times import epoch_micros, kind_of
from weftline.operators.stats import _attach
from weftline.plans.ordered import framed, scan


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in ``order``; ties go to the least row.

    The filter on row number 1 is applied map-side before the shuffle, so many
    copies of one key shrink to one row per task.
    """
    rest = [F.col(c) for c in df.columns if c not in keys and not _unordered(df, c)]
    window = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def _unordered(df: DataFrame, col: str) -> bool:
    return "map<" in dict(df.dtypes)[col] or dict(df.dtypes)[col] == "variant"


def gaps(
    df: DataFrame, ts: str, expected: str, by: Sequence[str] = (), *, hot_rows: int | None = None
) -> DataFrame:
    """(by, gap_start, gap_end, missing) wherever more than ``expected`` passes
    between two rows of a key; ``missing`` counts the expected rows in between."""
    step = micros(expected)
    seen = df.where(F.col(ts).isNotNull()).select(*by, F.col(ts).alias("_t"))
    near = framed(
        seen, by, ["_t"], lambda w: {"gap_end": F.lead("_t").over(w)}, ahead=1, hot_rows=hot_rows
    )
    kind = kind_of(df, ts)
    length = epoch_micros("gap_end", kind) - epoch_micros("_t", kind)
    missing = F.ceil(length / F.lit(step)).cast("bigint") - 1
    return near.where(length > step).select(*by, F.col("_t").alias("gap_start"), "gap_end", missing.alias("missing"))


def id_gaps(df: DataFrame, id: str, *, hot_rows: int | None = None) -> DataFrame:
    """(gap_start, gap_end, missing): runs of absent whole numbers between ids."""
    seen = df.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("_i"))
    near = framed(seen, [], ["_i"], lambda w: {"_n": F.lead("_i").over(w)}, ahead=1, hot_rows=hot_rows)
    return near.where("_n > _i + 1").select(
        (F.col("_i") + 1).alias("gap_start"), (F.col("_n") - 1).alias("gap_end"), (F.col("_n") - F.col("_i") - 1).alias("missing")
    )


def nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, rows, nulls, blanks, null_rate, blank_rate), one aggregate."""
    types = dict(df.dtypes)
    cols = list(cols or df.columns)
    cells = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        blank = F.trim(F.col(c)) == "" if types[c] == "string" else F.lit(False)
        cells += [F.count_if(F.col(c).isNull()).alias(f"_n{i}"), F.count_if(blank).alias(f"_b{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("_n").alias("rows"),
            F.col(f"_n{i}").alias("nulls"),
            F.col(f"_b{i}").alias("blanks"),
            F.try_divide(F.col(f"_n{i}"), F.col("_n")).alias("null_rate"),
            F.try_divide(F.col(f"_b{i}"), F.col("_n")).alias("blank_rate"),
        )
        for i, c in enumerate(cols)
    ]
    return df.agg(*cells).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def fill(
    df: DataFrame,
    col: str,
    how: str = "constant",
    value=None,
    *,
    order: Sequence[str | Column] = (),
    by: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Replace NULLs in ``col``: by a constant, the mean of the key, or the
    latest earlier value of the key in ``order`` (``how="forward"``)."""
    kind = dict(df.dtypes)[col]
    if how == "constant":
        return df.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(kind)))
    if how == "mean":
        means = df.groupBy(*by).agg(F.avg(col).alias("_mean"))
        filled = F.coalesce(F.col(col).cast("double"), F.col("_mean").cast("double"))
        return _attach(df, means, by).withColumn(col, filled).select(*df.columns)
    if how == "forward":
        if not order:
            raise ValueError("a forward fill needs order=")
        out = scan(df, by, order, lasts={"_last": col}, hot_rows=hot_rows)
        return out.withColumn(col, F.col("_last")).select(*df.columns)
    raise ValueError(f"unknown fill {how!r}")


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns, values that do not convert becoming NULL."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def coerce_report(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """(column_name, target_type, values, failures) of a ``coerce``."""
    cells, rows = [], []
    for i, (c, kind) in enumerate(types.items()):
        lost = F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()
        cells += [F.count(c).alias(f"_n{i}"), F.count_if(lost).alias(f"_f{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(kind).alias("target_type"),
                F.col(f"_n{i}").alias("values"),
                F.col(f"_f{i}").alias("failures"),
            )
        )
    return df.agg(*cells).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


# Candidate types, narrowest first.
CANDIDATE_TYPES = ("bigint", "double", "timestamp_ntz", "boolean")

# What a text must look like for a cast to have a chance.  A cast
# that fails raises and catches an exception inside Spark, for every row.
_PLAUSIBLE = {
    "bigint": r"^[+-]?[0-9]+$",
    "double": r"^[0-9+\-.eEdDfFiInNaAtTyY]+$",
    "timestamp_ntz": r"^[+-]?[0-9]{4}",
    "boolean": r"(?i)^(t|true|y|yes|1|f|false|n|no|0)$",
}


def suggest_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, values, suggested_type): the narrowest type that every
    non-blank text of the column accepts, from one aggregate."""
    types = dict(df.dtypes)
    cols = list(cols or [c for c in df.columns if types[c] == "string"])
    cells, rows = [], []
    for i, c in enumerate(cols):
        text = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        cells.append(F.count(text).alias(f"_n{i}"))
        pick = F.when(F.col(f"_n{i}") == 0, F.lit("string"))
        for j, kind in enumerate(CANDIDATE_TYPES):
            fit = F.when(text.rlike(_PLAUSIBLE[kind]), text.try_cast(kind))
            cells.append(F.count(fit).alias(f"_t{i}_{j}"))
            pick = pick.when(F.col(f"_t{i}_{j}") == F.col(f"_n{i}"), F.lit(kind))
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_n{i}").alias("values"),
                pick.otherwise(F.lit("string")).alias("suggested_type"),
            )
        )
    return df.agg(*cells).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
