"""The registered queries and the plain SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.session import load_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def register_sql(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """A query that is Spark SQL over the named tables; ``oracle`` is given
    where the two SQL dialects differ."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        load_views(spark, folder, *tables.split())
        return spark.sql(sql)

    register(name, sql if oracle is None else oracle)(run)
