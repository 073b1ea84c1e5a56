"""Search filters: functions from a DataFrame with language and published_at to a predicate."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SearchFilter = Callable[[DataFrame], Column]


def by_language(code: str) -> SearchFilter:
    """Pages of unknown language are left out."""
    return lambda df: df["language"] == F.lit(code)


def by_published_range(start: date | None, end: date | None) -> SearchFilter:
    """Whole UTC days, both ends included; pages without a date are left out once an end is set."""

    def made(df: DataFrame) -> Column:
        bounds = []
        if start:
            bounds.append(df["published_at"] >= F.lit(f"{start.isoformat()} 00:00:00").cast("timestamp"))
        if end:
            bounds.append(df["published_at"] < F.lit(f"{end.isoformat()} 00:00:00").cast("timestamp") + F.expr("INTERVAL 24 HOURS"))
        return reduce(lambda a, b: a & b, bounds, F.lit(True))

    return made


def compiled(filters: tuple[SearchFilter, ...], df: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [f(df) for f in filters], F.lit(True))
