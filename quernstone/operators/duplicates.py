"""Rows that share a business key on one day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.calendar import business_day, on_day

SAMPLE_GROUPS = 20


def duplicate_groups(df: DataFrame, keys: Sequence[str], date_column: str, day: dt.date | str) -> DataFrame:
    """The keys that occur more than once on the day, with ``duplicate_count``. Null keys are equal to each other.

    Counted before the shuffle, so a key with any share of the rows costs one row per task.
    """
    return _repeated(df.where(on_day(df, date_column, day)), _names(keys))


def duplicate_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("duplicate_records"),
    ]


def duplicate_summary(df: DataFrame, keys: Sequence[str], date_column: str, day: dt.date | str) -> DataFrame:
    """One row: number of repeated keys, number of rows that have them, severity."""
    return _graded(duplicate_groups(df, keys, date_column, day).agg(*duplicate_aggregates()))


def duplicate_samples(
    df: DataFrame, keys: Sequence[str], date_column: str, day: dt.date | str, limit: int = SAMPLE_GROUPS
) -> DataFrame:
    """The most repeated keys of the day."""
    groups = duplicate_groups(df, keys, date_column, day)
    return groups.orderBy(F.desc("duplicate_count"), *[F.col(k) for k in _names(keys)]).limit(limit)


def duplicate_summary_daily(df: DataFrame, keys: Sequence[str], date_column: str) -> DataFrame:
    """``duplicate_summary`` for every day that has a repeated key."""
    return _graded(daily_duplicate_facts(df, keys, date_column))


def daily_duplicate_facts(df: DataFrame, keys: Sequence[str], date_column: str) -> DataFrame:
    dated = df.withColumn("current_day", business_day(df, date_column)).where("current_day is not null")
    names = _names(keys)
    groups = dated.groupBy("current_day", *names).agg(F.count(F.lit(1)).alias("duplicate_count"))
    return groups.where("duplicate_count > 1").groupBy("current_day").agg(*duplicate_aggregates())


def _repeated(df: DataFrame, names: list[str]) -> DataFrame:
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("duplicate_count")).where("duplicate_count > 1")


def _names(keys: Sequence[str]) -> list[str]:
    if not keys:
        raise ValueError("business keys must hold at least one column")
    return [f"`{k}`" for k in keys]


def _graded(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", sev.severity_name(sev.by_group_count(F.col("duplicate_groups"))))
