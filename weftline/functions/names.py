"""Identifiers and widths."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTH = re.compile(r"^\s*(\d+)\s*(microsecond|millisecond|second|minute|hour|day|week)s?\s*$", re.IGNORECASE)

# Microseconds per unit.
UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def quoted(name: str) -> str:
    """A safely quoted identifier; dots separate catalog parts."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def micros(width: str | timedelta) -> int:
    """Length of a fixed width such as ``"15 minutes"`` in microseconds."""
    if isinstance(width, timedelta):
        out = width // timedelta(microseconds=1)
    else:
        found = _WIDTH.match(width)
        if not found:
            raise ValueError(f"not a fixed width: {width!r}")
        out = int(found[1]) * UNIT_MICROS[found[2].lower()]
    if out <= 0:
        raise ValueError("a width must be positive")
    return out


def whole_numbers(values: Sequence[int]) -> Column:
    """A literal array of many whole numbers, sent as one text and folded by
    the optimizer; one literal per element would be slow to build and analyse."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast("array<bigint>")
