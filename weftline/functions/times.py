"""Timestamps as whole microseconds, independent of the session's time zone.

A TIMESTAMP_NTZ is read as wall-clock time: going through TIMESTAMP would lose
or repeat hours wherever the session's zone changes its clocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone names without clock changes and at offset 0.
_UTC = {"utc", "etc/utc", "gmt", "z", "+00:00", "utc+0"}


def _utc_session() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone").lower() in _UTC


def _ntz(kind: str) -> bool:
    return kind == "timestamp_ntz"


def kind_of(df: DataFrame, ts: str) -> str:
    return dict(df.dtypes)[ts]


def epoch_micros(ts: str | Column, kind: str = "timestamp_ntz") -> Column:
    """Microseconds since 1970 of a timestamp of type ``kind``, as a bigint."""
    at = F.col(ts) if isinstance(ts, str) else ts
    if not _ntz(kind) or _utc_session():
        return F.unix_micros(at.cast("timestamp"))
    since = (at.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).cast("interval second")
    return (since.cast("decimal(18,6)") * F.lit(1_000_000)).cast("bigint")


def from_micros(value: Column, kind: str = "timestamp_ntz") -> Column:
    """The timestamp of type ``kind`` that many microseconds after 1970."""
    if _ntz(kind) and not _utc_session():
        return F.timestamp_add("MICROSECOND", value, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return F.timestamp_micros(value).cast(kind)
