"""Folders, written stages and skew-safe joins shared by the operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import scratch_path

#: A key held by more than 1/HEAVY_SHARE of all rows counts as heavy.
HEAVY_SHARE = 1000


#: Rows, and bytes where Spark knows the setting, that a Python task gets at once.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def prepare(spark: SparkSession) -> None:
    """Bounds the batches of Python tasks, and lets Python workers import this package.

    Whole texts are long rows, so Spark's 10,000 a batch are too many; a value that the
    session has set itself stays.  The import path serves a local master, whatever its
    working folder; on a cluster the package is installed or sent with the job.
    """
    for key, value in _BATCH.items():
        if spark.conf.get(key, None) in (None, "10000"):
            spark.conf.set(key, value)
    root, given = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in given.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        given["PYTHONPATH"] = os.pathsep.join([*paths, root])


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, with as many underscores in front that none of ``taken`` is among them."""
    front, used = "_", {t.lower() for t in taken}
    while used & {front + n for n in names}:
        front += "_"
    return [front + n for n in names]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again.

    Cuts lineage: what follows re-reads the files when an executor is lost.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one ``table`` row per key, where a key may be hot.

    ``weight`` says how many rows a key has in ``rows`` at most, ``total`` how many
    there are in all.  Of keys above total/HEAVY_SHARE there are fewer than
    HEAVY_SHARE, so those are broadcast; the rows they match take a key of their
    own in the shuffled join of all others, which spreads them evenly.
    """
    others = [c for c in table.columns if c not in keys]
    hot = table.where(F.col(weight) * HEAVY_SHARE > F.lit(total))
    rest = table.where(F.col(weight) * HEAVY_SHARE <= F.lit(total))
    hot = hot.select(*keys, F.struct(*others).alias("_hot"))
    rest = rest.select(*[F.col(k).alias(f"_rest_{k}") for k in keys], F.struct(*others).alias("_cold"))
    rows = rows.join(F.broadcast(hot), keys, "left")
    served = F.col("_hot").isNotNull()
    rows = rows.withColumn("_join", F.when(served, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col(keys[0])))
    on = F.col("_hot").isNull() & (F.col("_join") == F.col(f"_rest_{keys[0]}"))
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"_rest_{k}"))
    joined = rows.join(rest, on, "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    return joined.select(*[c for c in rows.columns if c not in ("_hot", "_join")], *[F.col("_got")[c].alias(c) for c in others])
