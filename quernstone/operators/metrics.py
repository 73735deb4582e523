"""Sums of a metric on two days, in total and by the groups that moved it most."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import severity as sev
from ..functions.calendar import business_day, on_day
from .row_counts import day_pairs

# A metric moving by 10 % is a warning, by 30 % critical, for every table.
WARNING_PCT, CRITICAL_PCT = 10.0, 30.0
CONTRIBUTORS = 10


def require_numeric(df: DataFrame, metric: str) -> None:
    if not isinstance(df.schema[metric].dataType, T.NumericType):
        raise TypeError(f"metric column {metric!r} is {df.schema[metric].dataType.simpleString()}, not numeric")


def _summable(df: DataFrame, metric: str) -> Column:
    """The metric in a type whose sums do not overflow."""
    value = F.col(f"`{metric}`")
    return value.cast("decimal(38,0)") if isinstance(df.schema[metric].dataType, T.LongType) else value


def metric_aggregates(df: DataFrame, metric: str, before: Column, today: Column) -> list[Column]:
    """Sums of the metric on both days; 0 where there is nothing to add."""

    def total(rows: Column) -> Column:
        return F.coalesce(F.sum(F.when(rows, _summable(df, metric))).cast("double"), F.lit(0.0))

    return [total(before).alias("previous_total"), total(today).alias("current_total")]


def change_columns(previous: str, current: str) -> list[Column]:
    moved = sev.pct_change(F.col(previous), F.col(current))
    return [
        F.round(previous, 2).alias(previous),
        F.round(current, 2).alias(current),
        F.round(F.col(current) - F.col(previous), 2).alias("difference"),
        F.round(moved, 2).alias("percentage_change"),
    ]


def total_columns() -> list[Column]:
    """Comparison columns over the ``metric_aggregates``."""
    moved = sev.pct_change(F.col("previous_total"), F.col("current_total"))
    severity = sev.by_pct_change(moved, WARNING_PCT, CRITICAL_PCT)
    return [*change_columns("previous_total", "current_total"), severity.alias("severity_code")]


def compare_metric_totals(
    df: DataFrame, metric: str, date_column: str, previous: dt.date | str, current: dt.date | str
) -> DataFrame:
    """One row: the metric's sum on both days, its change, severity in either direction."""
    require_numeric(df, metric)
    before, today = on_day(df, date_column, previous), on_day(df, date_column, current)
    totals = df.where(before | today).agg(*metric_aggregates(df, metric, before, today))
    return _named(totals.select(*total_columns()))


def compare_metric_groups(
    df: DataFrame, metric: str, group_by: str, date_column: str, previous: dt.date | str, current: dt.date | str
) -> DataFrame:
    """The metric's sum on both days for every group, not rounded."""
    require_numeric(df, metric)
    before, today = on_day(df, date_column, previous), on_day(df, date_column, current)
    return (
        df.where(before | today)
        .groupBy(F.col(f"`{group_by}`").alias("group_value"))
        .agg(*metric_aggregates(df, metric, before, today))
        .withColumnsRenamed({"previous_total": "previous_value", "current_total": "current_value"})
    )


def largest_move() -> list[Column]:
    moved = F.round(F.abs(F.col("current_value") - F.col("previous_value")), 6)
    return [moved.desc(), F.col("group_value").asc_nulls_first()]


def metric_contributors(
    df: DataFrame,
    metric: str,
    group_by: str,
    date_column: str,
    previous: dt.date | str,
    current: dt.date | str,
    limit: int = CONTRIBUTORS,
) -> DataFrame:
    """The groups whose sum moved most in absolute terms between the two days."""
    groups = compare_metric_groups(df, metric, group_by, date_column, previous, current)
    top = groups.orderBy(*largest_move()).limit(limit)
    return top.select("group_value", *change_columns("previous_value", "current_value"))


def metric_totals_daily(df: DataFrame, metric: str, date_column: str) -> DataFrame:
    """``compare_metric_totals`` of every day with the day before it."""
    return metric_totals_of_days(_daily_sums(df, metric, date_column, []))


def metric_totals_of_days(daily: DataFrame) -> DataFrame:
    """``metric_totals_daily`` from one row per day: day, m."""
    pairs = day_pairs(daily, ["m"]).withColumnsRenamed({"m": "current_total", "m_before": "previous_total"})
    return _named(pairs.select("current_day", "previous_day", *total_columns()))


def metric_contributors_daily(
    df: DataFrame, metric: str, group_by: str, date_column: str, limit: int = CONTRIBUTORS
) -> DataFrame:
    """``metric_contributors`` of every day, with ``rank``.

    Sums are formed before any shuffle, and each task keeps ``limit`` groups of
    a day before the ranks meet, so neither a hot day nor a hot group piles up.
    """
    named = df.withColumn("group_value", F.col(f"`{group_by}`"))
    return metric_contributors_of_days(_daily_sums(named, metric, date_column, ["group_value"]), limit)


def metric_contributors_of_days(daily: DataFrame, limit: int = CONTRIBUTORS) -> DataFrame:
    """``metric_contributors_daily`` from one row per day and group: day, group_value, m."""
    pairs = day_pairs(daily, ["m"], ["group_value"]).withColumnsRenamed(
        {"m": "current_value", "m_before": "previous_value"}
    )
    by_day = Window.partitionBy("current_day").orderBy(*largest_move())
    ranked = pairs.withColumn("rank", F.row_number().over(by_day)).where(F.col("rank") <= limit)
    return ranked.select("current_day", "rank", "group_value", *change_columns("previous_value", "current_value"))


def _daily_sums(df: DataFrame, metric: str, date_column: str, keys: list[str]) -> DataFrame:
    require_numeric(df, metric)
    daily = df.groupBy(business_day(df, date_column).alias("day"), *keys).agg(daily_metric_sum(df, metric).alias("m"))
    return daily.where("day is not null")


def daily_metric_sum(df: DataFrame, metric: str) -> Column:
    return F.coalesce(F.sum(_summable(df, metric)).cast("double"), F.lit(0.0))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", sev.severity_name(F.col("severity_code"))).drop("severity_code")
