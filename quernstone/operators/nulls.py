"""Null rates of every column against the days before."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.calendar import business_day, days_before, in_days, on_day
from .row_counts import lagged_sum, look_back

LOOKBACK_DAYS = 7


def checked_columns(df: DataFrame, date_column: str) -> list[str]:
    return [c for c in df.columns if c != date_column]


def null_aggregates(columns: list[str], today: Column, history: Column) -> list[Column]:
    """Rows and nulls per column, on the day and in its history, for one ``agg``."""
    aggregates = [F.count_if(today).alias("rows_now"), F.count_if(history).alias("rows_before")]
    for i, name in enumerate(columns):
        empty = F.col(f"`{name}`").isNull()
        aggregates += [
            F.count_if(empty & today).alias(f"nulls_now_{i}"),
            F.count_if(empty & history).alias(f"nulls_before_{i}"),
        ]
    return aggregates


def null_counts(columns: list[str], critical: Collection[str]) -> Column:
    """The per-column ``null_aggregates`` as one ``array<struct>``, so that a wide table stays a small expression."""
    return F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(name in critical).alias("is_critical"),
                F.col(f"nulls_now_{i}").alias("nulls_now"),
                F.col(f"nulls_before_{i}").alias("nulls_before"),
            )
            for i, name in enumerate(columns)
        ]
    )


def null_rates(counts: Column) -> Column:
    """Null percentages of an element of ``null_counts``: none in an empty day, unknown without history."""

    def percent(nulls: Column, rows: str) -> Column:
        return F.try_divide(nulls, F.col(rows)) * 100

    return F.struct(
        counts.position.alias("position"),
        counts.column_name.alias("column_name"),
        counts.is_critical.alias("is_critical"),
        F.coalesce(percent(counts.nulls_now, "rows_now"), F.lit(0.0)).alias("now"),
        F.round(percent(counts.nulls_before, "rows_before"), 2).alias("before"),
    )


def null_grade(rates: Column, threshold_pct: float) -> Column:
    """What is reported of a column, from an element of ``null_rates``."""
    return F.struct(
        rates.position.alias("position"),
        rates.column_name.alias("column_name"),
        F.round(rates.now, 2).alias("null_percentage"),
        rates.before.alias("historical_average"),
        sev.by_deviation(rates.now, rates.before, threshold_pct, rates.is_critical).alias("severity_code"),
    )


def detect_null_anomalies(
    df: DataFrame,
    date_column: str,
    day: dt.date | str,
    threshold_pct: float = 5.0,
    critical_columns: Collection[str] = (),
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """One row per column: null rate on the day, pooled rate of the days before, severity.

    The day and its history are counted in one scan of ``lookback_days + 1`` days.
    """
    columns = checked_columns(df, date_column)
    if not columns:
        raise ValueError("there is no column besides the date column to check for nulls")
    first, yesterday = days_before(day, lookback_days), days_before(day, 1)
    counts = df.where(in_days(df, date_column, first, day)).agg(
        *null_aggregates(columns, on_day(df, date_column, day), in_days(df, date_column, first, yesterday))
    )
    return _graded(counts, [], columns, threshold_pct, critical_columns)


def detect_null_anomalies_daily(
    df: DataFrame,
    date_column: str,
    threshold_pct: float = 5.0,
    critical_columns: Collection[str] = (),
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """``detect_null_anomalies`` for every day that has rows, in one pass over the table."""
    columns = checked_columns(df, date_column)
    daily = df.groupBy(business_day(df, date_column).alias("day")).agg(*daily_null_counts(columns))
    return null_anomalies_of_days(daily.where("day is not null"), columns, threshold_pct, critical_columns, lookback_days)


def null_anomalies_of_days(
    daily: DataFrame,
    columns: list[str],
    threshold_pct: float = 5.0,
    critical_columns: Collection[str] = (),
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """``detect_null_anomalies_daily`` from one row per day: day and the ``daily_null_counts`` of the columns."""
    sent = look_back(daily, lookback_days)
    facts = sent.groupBy("current_day").agg(*daily_null_aggregates(columns)).where("rows_now > 0")
    return _graded(facts, ["current_day"], columns, threshold_pct, critical_columns)


def null_anomaly_summary(graded: DataFrame) -> DataFrame:
    """``columns_checked, anomaly_count, overall_severity`` of ``detect_null_anomalies``, or of each of its days."""
    keys = [c for c in graded.columns if c == "current_day"]
    code = F.array_position(F.array(*map(F.lit, sev.LABELS)), F.col("severity")) - 1
    summed = graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("columns_checked"),
        F.count_if(code > sev.OK).alias("anomaly_count"),
        sev.worst(code).alias("code"),
    )
    return summed.withColumn("overall_severity", sev.severity_name(F.col("code"))).drop("code")


def daily_null_counts(columns: list[str]) -> list[Column]:
    """Rows ``n`` and nulls per column of one day."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{i}") for i, c in enumerate(columns)]
    return [F.count(F.lit(1)).alias("n"), *nulls]


def daily_null_aggregates(columns: list[str]) -> list[Column]:
    """The ``null_aggregates`` of a day over the ``daily_null_counts`` sent to it."""
    now, before = F.col("lag") == 0, F.col("lag") > 0
    aggregates = [lagged_sum("n", now).alias("rows_now"), lagged_sum("n", before).alias("rows_before")]
    for i in range(len(columns)):
        aggregates += [
            lagged_sum(f"nulls_{i}", now).alias(f"nulls_now_{i}"),
            lagged_sum(f"nulls_{i}", before).alias(f"nulls_before_{i}"),
        ]
    return aggregates


def _graded(
    facts: DataFrame, keys: list[str], columns: list[str], threshold_pct: float, critical: Collection[str]
) -> DataFrame:
    each = facts.select(*keys, "rows_now", "rows_before", F.explode(null_counts(columns, critical)).alias("c"))
    rated = each.select(*keys, null_rates(F.col("c")).alias("r"))
    graded = rated.select(*keys, null_grade(F.col("r"), threshold_pct).alias("g")).select(*keys, "g.*")
    return graded.withColumn("severity", sev.severity_name(F.col("severity_code"))).drop("severity_code")
