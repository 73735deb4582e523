"""Records that break a condition, and bounded samples of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED_LIMIT, SAMPLE_LIMIT = 100, 20


def any_null(columns: Sequence[str]) -> Column:
    """True where at least one of the columns is null."""
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns])


def failed_records(
    df: DataFrame, condition: str | Column, limit: int = FAILED_LIMIT, order_by: Sequence[str] = ()
) -> DataFrame:
    """Up to ``limit`` (at least 1) rows for which the condition holds.

    A condition given as text is one SQL expression, never a statement. With
    ``order_by`` the sample is the same on every run.
    """
    return _first(df.where(_condition(condition)), limit, order_by)


def failed_count(df: DataFrame, condition: str | Column) -> DataFrame:
    """One row: how many rows the condition holds for, and how many there are."""
    return df.agg(F.count_if(_condition(condition)).alias("failed_count"), F.count(F.lit(1)).alias("total_count"))


def sample_data(df: DataFrame, limit: int = SAMPLE_LIMIT, order_by: Sequence[str] = ()) -> DataFrame:
    """Up to ``limit`` (at least 1) rows to look at."""
    return _first(df, limit, order_by)


def _first(df: DataFrame, limit: int, order_by: Sequence[str]) -> DataFrame:
    if limit < 1:
        raise ValueError(f"limit must be at least 1, not {limit}")
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered.limit(limit)


def _condition(condition: str | Column) -> Column:
    if isinstance(condition, str):
        if not condition.strip():
            raise ValueError("condition must not be empty")
        return F.expr(condition)
    return condition
