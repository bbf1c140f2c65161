"""Two-sample tests, change points and table comparison.

All tests reduce the table to counts per distinct value first; what remains is
running counts in value order (see ``plans.ordered``) and one final aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.special import kolmogorov_p, student_two_sided_p, two_sided_normal_p
from weftline.operators.timeseries import series_of
from weftline.plans.ordered import HOT_ROWS, scan


def two_groups(df: DataFrame, group: str, groups: Sequence | None = None) -> list:
    """The two compared groups, in order; an error unless there are exactly two."""
    if groups is None:
        found = df.select(group).where(F.col(group).isNotNull()).distinct().limit(3).collect()
        groups = sorted(r[0] for r in found)
    if len(groups) != 2:
        raise ValueError(f"expected two groups in {group!r}, found {len(groups)}; pass groups=(a, b)")
    return list(groups)


def t_test(df: DataFrame, group: str, value: str, groups: Sequence | None = None) -> DataFrame:
    """Welch's test: n, mean and variance of both groups, t, dof and p, one row."""
    a, b = two_groups(df, group, groups)
    x = F.col(value).cast("double")
    one, two = F.when(F.col(group) == a, x), F.when(F.col(group) == b, x)
    m = df.where(F.col(group).isin(a, b)).agg(
        F.count(one).alias("n1"), F.count(two).alias("n2"),
        F.avg(one).alias("mean1"), F.avg(two).alias("mean2"),
        F.var_samp(one).alias("var1"), F.var_samp(two).alias("var2"),
    )
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(e1 + e2))
    dof = F.try_divide(
        (e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1.0) + e2 * e2 / (F.col("n2") - 1.0)
    )
    guarded = F.when((F.col("n1") > 1) & (F.col("n2") > 1), t), F.when((F.col("n1") > 1) & (F.col("n2") > 1), dof)
    out = m.select("*", guarded[0].alias("t"), guarded[1].alias("dof"))
    return out.withColumn("p", student_two_sided_p("t", "dof"))


def _sided_counts(
    df: DataFrame, group: str, value: str, groups: Sequence, hot_rows: int | None
) -> DataFrame:
    """(x, c1, c2, u1, u2, t1, t2): per-group counts, running counts and totals."""
    a, b = groups
    kept = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    limit = HOT_ROWS if hot_rows is None else hot_rows
    split = kept.count() > limit
    counts = kept.groupBy(F.col(value).cast("double").alias("x")).agg(
        F.count_if(F.col(group) == a).alias("c1"), F.count_if(F.col(group) == b).alias("c2")
    )
    return scan(
        counts, [], ["x"], sums={"u1": "c1", "u2": "c2"}, totals={"t1": "c1", "t2": "c2"},
        hot_rows=hot_rows, split=split,
    )


def ks_test(
    df: DataFrame, group: str, value: str, groups: Sequence | None = None, *, hot_rows: int | None = None
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: n1, n2, d and the asymptotic p, one row."""
    ranked = _sided_counts(df, group, value, two_groups(df, group, groups), hot_rows)
    gap = F.abs(F.try_divide(F.col("u1"), F.col("t1")) - F.try_divide(F.col("u2"), F.col("t2")))
    out = ranked.agg(F.max("t1").alias("n1"), F.max("t2").alias("n2"), F.max(gap).alias("d"))
    root = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    return out.withColumn("p", kolmogorov_p((root + 0.12 + F.lit(0.11) / root) * F.col("d")))


def mann_whitney(
    df: DataFrame, group: str, value: str, groups: Sequence | None = None, *, hot_rows: int | None = None
) -> DataFrame:
    """(n1, n2, u, z, p): U of the first group with average ranks for ties and
    the tie-corrected normal approximation, one row."""
    ranked = _sided_counts(df, group, value, two_groups(df, group, groups), hot_rows)
    tied = F.col("c1") + F.col("c2")
    upto = F.col("u1") + F.col("u2")
    middle = upto - (tied - 1) / 2.0
    ties = tied.cast("double")
    out = ranked.agg(
        F.max("t1").alias("n1"),
        F.max("t2").alias("n2"),
        F.sum(F.col("c1") * middle).alias("_r1"),
        F.sum(ties * ties * ties - ties).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2.0
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    out = out.select("n1", "n2", u.alias("u"), F.try_divide(u - n1 * n2 / 2.0, spread).alias("z"))
    return out.withColumn("p", two_sided_normal_p(F.col("z")))


def change_points(
    df: DataFrame, ts: str, value: str, width: str, agg: str = "avg", *, hot_rows: int | None = None
) -> DataFrame:
    """(i, y, cusum, gain, mean_before, mean_after) per bucket with data.

    ``gain`` is how much splitting the series after bucket i lowers the squared
    error; ``cusum`` is the running sum of deviations from the overall mean.
    """
    made = {"sum": F.sum(value), "avg": F.avg(value), "count": F.count(value)}[agg]
    series, n = series_of(df, ts, width, made)
    held = series.where("y is not null").withColumn("_one", F.lit(1))
    limit = HOT_ROWS if hot_rows is None else hot_rows
    running = scan(
        held, [], ["i"], sums={"_s": "y", "_n": "_one"}, totals={"_st": "y", "_nt": "_one"},
        hot_rows=hot_rows, split=n > limit,
    )
    after_n, after_s = F.col("_nt") - F.col("_n"), F.col("_st") - F.col("_s")
    before = F.col("_s") / F.col("_n")
    after = F.try_divide(after_s, after_n)
    gap = before - after
    return running.select(
        "i",
        "y",
        (F.col("_s") - F.col("_n") * F.col("_st") / F.col("_nt")).alias("cusum"),
        (F.col("_n") * after_n / F.col("_nt") * gap * gap).alias("gain"),
        before.alias("mean_before"),
        after.alias("mean_after"),
    )


def change_point(
    df: DataFrame, ts: str, value: str, width: str, agg: str = "avg", *, hot_rows: int | None = None
) -> DataFrame:
    """The split with the greatest gain, one row; none for fewer than two buckets."""
    rows = change_points(df, ts, value, width, agg, hot_rows=hot_rows)
    return rows.where("gain is not null").orderBy(F.round("gain", 9).desc(), "i").limit(1)


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row-level difference of two variants.

    With keys: (keys, status, changed_columns), status one of added, removed,
    changed, same.  Without: the columns plus status and the number of copies
    more on one side.
    """
    keys = list(keys)
    if not keys:
        cols = a.columns
        tagged = a.withColumn("_w", F.lit(-1)).unionByName(b.withColumn("_w", F.lit(1)))
        balance = tagged.groupBy(*cols).agg(F.sum("_w").alias("_d")).where("_d != 0")
        status = F.when(F.col("_d") > 0, "added").otherwise("removed")
        return balance.select(*cols, status.alias("status"), F.abs("_d").alias("copies"))

    fields = [c for c in a.columns if c not in keys and c in b.columns]
    left = a.select(*[F.col(c).alias(f"_a_{c}") for c in keys + fields], F.lit(True).alias("_in_a"))
    right = b.select(*[F.col(c).alias(f"_b_{c}") for c in keys + fields], F.lit(True).alias("_in_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}"))
    both = left.join(right, on, "full")
    differs = F.array_compact(
        F.array(
            *[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in fields],
            F.lit(None).cast("string"),
        )
    )
    paired = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    status = (
        F.when(F.col("_in_a").isNull(), "added")
        .when(F.col("_in_b").isNull(), "removed")
        .when(F.size(differs) > 0, "changed")
        .otherwise("same")
    )
    return both.select(
        *[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys],
        status.alias("status"),
        F.when(paired, differs).otherwise(F.array().cast("array<string>")).alias("changed_columns"),
    )


def compare_counts(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(status, n) of ``compare``."""
    rows = compare(a, b, keys)
    size = F.count(F.lit(1)) if keys else F.sum("copies")
    return rows.groupBy("status").agg(size.alias("n"))
