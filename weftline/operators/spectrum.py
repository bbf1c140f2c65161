"""Power spectrum of an indexed series.

Short series are evaluated directly inside Spark.  Long ones go through
transforms whose length is a power of two, split into rows and columns so that
each task transforms about sqrt(length) points; a chirp turns the spectrum of
any length N into one convolution of such transforms (Bluestein's method).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT_LENGTH = 2_048


def power_spectrum(series: DataFrame, n: int, mean: float, direct: int = DIRECT_LENGTH) -> DataFrame:
    """(k, power = |X_k|^2 / n) for k = 1..n/2 of (i, y); missing i count as 0."""
    grid = series.sparkSession.range(n).select(F.col("id").alias("i"))
    y = F.coalesce("y", F.lit(0.0)) - F.lit(mean)
    centred = grid.join(series, "i", "left").select("i", y.alias("y"))
    return _direct(centred, n) if n <= direct else _chirp(centred, n)


def _direct(centred: DataFrame, n: int) -> DataFrame:
    # n is at most DIRECT_LENGTH here: n * n / 2 terms, combined map-side
    terms = centred.select("i", "y", F.explode(F.sequence(F.lit(1), F.lit(n // 2))).alias("k"))
    # the index product is reduced first: large angles lose digits
    angle = F.lit(2.0 * math.pi / n) * (F.col("i") * F.col("k") % F.lit(n))
    sums = terms.groupBy(F.col("k").cast("bigint").alias("k")).agg(
        F.sum(F.col("y") * F.cos(angle)).alias("_c"), F.sum(F.col("y") * F.sin(angle)).alias("_s")
    )
    return sums.select("k", ((F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / F.lit(float(n))).alias("power"))


def _transform(points: DataFrame, length: int, inverse: bool = False) -> DataFrame:
    """DFT of (i, re, im) with ``length`` = 2^m; missing i are 0."""
    bits = length.bit_length() - 1
    rows = 1 << (bits // 2)
    cols = length // rows
    sign = 1.0 if inverse else -1.0

    def along(values: pd.DataFrame, at: str, size: int) -> np.ndarray:
        dense = np.zeros(size, dtype=np.complex128)
        dense[values[at].to_numpy()] = values["re"].to_numpy() + 1j * values["im"].to_numpy()
        return np.fft.ifft(dense) * size if inverse else np.fft.fft(dense)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["c"].iloc[0])
        out = along(pdf, "r", rows)
        k = np.arange(rows)
        out = out * np.exp(sign * 2j * np.pi * (c * k % length) / length)
        return pd.DataFrame({"c": c, "k1": k, "re": out.real, "im": out.imag})

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        k1 = int(pdf["k1"].iloc[0])
        out = along(pdf, "c", cols)
        return pd.DataFrame({"i": k1 + rows * np.arange(cols), "re": out.real, "im": out.imag})

    split = points.select(
        F.expr(f"i div {cols}").alias("r"), F.expr(f"i % {cols}").alias("c"), "re", "im"
    )
    half = split.groupBy("c").applyInPandas(first, "c bigint, k1 bigint, re double, im double")
    full = half.groupBy("k1").applyInPandas(second, "i bigint, re double, im double")
    if not inverse:
        return full
    return full.select("i", (F.col("re") / F.lit(float(length))).alias("re"), (F.col("im") / F.lit(float(length))).alias("im"))


def _chirp(centred: DataFrame, n: int) -> DataFrame:
    spark = centred.sparkSession
    length = 1 << (2 * n - 1).bit_length()
    # i * i is reduced modulo 2n in decimals: it may pass 2^63 for long series
    def phase(i):
        wide = i.cast("decimal(19,0)")
        return F.lit(math.pi / n) * (wide * wide % F.lit(2 * n).cast("decimal(19,0)")).cast("double")

    angle = phase(F.col("i"))
    signal = centred.select(
        "i", (F.col("y") * F.cos(angle)).alias("re"), (-F.col("y") * F.sin(angle)).alias("im")
    )
    lag = spark.range(2 * n - 1).select((F.col("id") - F.lit(n - 1)).alias("_d"))
    distance = phase(F.abs("_d"))
    kernel = lag.select(
        F.pmod(F.col("_d"), F.lit(length)).alias("i"), F.cos(distance).alias("re"), F.sin(distance).alias("im")
    )
    a = _transform(signal, length)
    b = _transform(kernel, length).select("i", F.col("re").alias("_br"), F.col("im").alias("_bi"))
    product = a.join(b, "i").select(
        "i",
        (F.col("re") * F.col("_br") - F.col("im") * F.col("_bi")).alias("re"),
        (F.col("re") * F.col("_bi") + F.col("im") * F.col("_br")).alias("im"),
    )
    # the last chirp has modulus 1 and drops out of the power
    folded = _transform(product, length, inverse=True)
    wanted = folded.where((F.col("i") >= 1) & (F.col("i") <= n // 2))
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.lit(float(n))
    return wanted.select(F.col("i").alias("k"), power.alias("power"))
