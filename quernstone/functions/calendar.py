"""Business-day predicates that a parquet scan can use as plain ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_date(day: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def days_before(day: dt.date | str, n: int) -> dt.date:
    return as_date(day) - dt.timedelta(days=n)


def in_days(df: DataFrame, column: str, first: dt.date | str, last: dt.date | str) -> Column:
    """Rows whose business day lies in ``[first, last]``.

    The column may hold dates, timestamps (with or without zone) or ISO strings
    of dates or times; each is compared with literals of its own type.
    """
    first, last = as_date(first), as_date(last)
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        end = last + dt.timedelta(days=1)
        return (value >= F.lit(first).cast(kind)) & (value < F.lit(end).cast(kind))
    if isinstance(kind, T.StringType):
        # Text of a time within a day lies between the texts of that day and the next.
        end = last + dt.timedelta(days=1)
        return (value >= F.lit(first.isoformat())) & (value < F.lit(end.isoformat()))
    if not isinstance(kind, T.DateType):
        raise TypeError(f"date column {column!r} is {kind.simpleString()}, which holds no days")
    low, high = F.lit(first), F.lit(last)
    return value == low if first == last else (value >= low) & (value <= high)


def on_day(df: DataFrame, column: str, day: dt.date | str) -> Column:
    return in_days(df, column, day, day)


def business_day(df: DataFrame, column: str) -> Column:
    """The column as a date; strings that are no dates give null."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return value.try_cast("date")
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"date column {column!r} is {kind.simpleString()}, which holds no days")
    return F.to_date(value)
