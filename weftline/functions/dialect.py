"""SQL functions of the analyst's dialect that Spark SQL does not have.

They are temporary SQL functions: Spark inlines their bodies, so they cost the
same as the built-in expressions they stand for.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Strftime directives and the date pattern letters they stand for.
STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
    "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
    "%I": "hh", "%p": "a", "%f": "SSSSSS",
}


def java_pattern(fmt: str) -> str:
    """A date pattern for a strftime format, letters outside directives quoted."""
    out, i = [], 0
    while i < len(fmt):
        two = fmt[i : i + 2]
        if two in STRFTIME:
            out.append(STRFTIME[two])
            i += 2
        elif two == "%%":
            out.append("%")
            i += 2
        elif fmt[i] == "%":
            raise ValueError(f"unknown directive {two!r}")
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i])
            i += 1
    return "".join(out)


def _replaced(expr: str) -> str:
    for directive, letters in STRFTIME.items():
        expr = f"replace({expr}, '{directive}', '{letters}')"
    return expr


def install(spark: SparkSession) -> None:
    """Register ``strftime``, ``epoch``, ``time_bucket`` and ``json_extract_string``."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strftime(ts TIMESTAMP_NTZ, fmt STRING) RETURNS STRING "
        f"RETURN date_format(ts, {_replaced('fmt')})"
    )
    # wall-clock arithmetic: no session time zone takes part
    origin = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    seconds = f"cast(cast(ts - {origin} AS INTERVAL SECOND) AS DECIMAL(18,6))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION epoch(ts TIMESTAMP_NTZ) RETURNS DOUBLE RETURN cast({seconds} AS DOUBLE)")
    micros = f"cast({seconds} * 1000000 AS BIGINT)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION time_bucket(width BIGINT, ts TIMESTAMP_NTZ) RETURNS TIMESTAMP_NTZ "
        f"RETURN timestampadd(MICROSECOND, {micros} - pmod({micros}, width * 1000000L), {origin})"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION json_extract_string(doc STRING, path STRING) RETURNS STRING "
        "RETURN get_json_object(doc, path)"
    )
