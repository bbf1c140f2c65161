"""Session set-up, the shared working folder and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on at scale.  A cluster's own values win: they
# are only applied by ``build_session``, never forced on a given session.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.checkpoint.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


SMALL_ROWS = 50_000


def build_session(app: str = "weftline", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a ``local`` master, where driver and executors share one disk, may go
    without the setting; it then gets a fresh temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if folder:
        if current is None:
            context.setCheckpointDir(folder)
        return folder.rstrip("/")
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settle(df: DataFrame, small_rows: int = SMALL_ROWS) -> tuple[DataFrame, int | None]:
    """Cut the lineage of one round of an iteration.

    A result of at most ``small_rows`` rows becomes a local relation, whose size
    Spark knows and may broadcast, and its row count is returned.  A larger one
    is written to the shared folder, with None for the count.
    """
    head = df.limit(small_rows + 1).toArrow()
    if head.num_rows <= small_rows:
        return df.sparkSession.createDataFrame(head, df.schema), head.num_rows
    return durable(df), None


def settle_large(df: DataFrame, small_rows: int = SMALL_ROWS) -> tuple[DataFrame, int | None]:
    """``settle`` of what is likely large: written first, and to the driver only if small."""
    held = durable(df)
    return (held, None) if held.count() > small_rows else settle(held, small_rows)


_UNITS = {"": 1, "b": 1, **{u + b: 1 << (10 * i) for i, u in enumerate("kmgtp", 1) for b in ("", "b", "ib")}}


def byte_size(setting: str) -> int:
    """The bytes of a size setting such as 134217728b, 256m or 1g."""
    number = setting.strip().lower()
    digits = number.rstrip("bikmgtp ")
    return int(float(digits) * _UNITS[number[len(digits) :].strip()])


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small input that sits in few splits.

    For heavy work per row only.  Inputs of at least one full split per core are
    left as they are, so what is shuffled here is bounded by that size.  Without a
    session that tells the size (a remote one), nothing is moved.
    """
    spark = df.sparkSession
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return df
    cores = spark.sparkContext.defaultParallelism
    split = byte_size(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_views(spark: SparkSession, folder: str, *names: str) -> None:
    """Register the named Parquet tables of ``folder`` as temporary views."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)
