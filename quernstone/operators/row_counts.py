"""Row counts of two business days, and of every day against the day before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.calendar import business_day, on_day


def count_aggregates(today: Column, before: Column) -> list[Column]:
    return [F.count_if(today).alias("current_count"), F.count_if(before).alias("previous_count")]


def count_columns(warning_pct: float, critical_pct: float) -> list[Column]:
    """Comparison columns over ``current_count`` and ``previous_count``."""
    current, previous = F.col("current_count"), F.col("previous_count")
    # A first day with rows is a rise of 100 %, two empty days are no change.
    change = F.coalesce(sev.pct_change(previous, current), F.when(current > 0, 100.0).otherwise(0.0))
    return [
        current,
        previous,
        (current - previous).alias("difference"),
        F.round(change, 2).alias("percentage_change"),
        sev.by_drop(change, warning_pct, critical_pct).alias("severity_code"),
    ]


def compare_row_counts(
    df: DataFrame,
    date_column: str,
    current: dt.date | str,
    previous: dt.date | str,
    warning_pct: float = 10.0,
    critical_pct: float = 30.0,
) -> DataFrame:
    """One row comparing two days. Only drops raise the severity."""
    today, before = on_day(df, date_column, current), on_day(df, date_column, previous)
    counts = df.where(today | before).agg(*count_aggregates(today, before))
    return _named(
        counts.select(
            F.lit(str(current)).cast("date").alias("current_day"),
            F.lit(str(previous)).cast("date").alias("previous_day"),
            *count_columns(warning_pct, critical_pct),
        )
    )


def compare_row_counts_daily(
    df: DataFrame, date_column: str, warning_pct: float = 10.0, critical_pct: float = 30.0
) -> DataFrame:
    """One row per day up to the last one with rows; a day without rows counts as 0 after one with rows.

    One pass: each day's count is handed to the next day, and rows of a day
    are summed before they are shuffled, so a day may hold any share of them.
    """
    counts = df.groupBy(business_day(df, date_column).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return row_counts_of_days(counts.where("day is not null"), warning_pct, critical_pct)


def row_counts_of_days(counts: DataFrame, warning_pct: float = 10.0, critical_pct: float = 30.0) -> DataFrame:
    """``compare_row_counts_daily`` from one row per day: day, n."""
    return _named(
        day_pairs(counts, ["n"])
        .select("current_day", "previous_day", F.col("n").alias("current_count"), F.col("n_before").alias("previous_count"))
        .select("current_day", "previous_day", *count_columns(warning_pct, critical_pct))
    )


def day_pairs(daily: DataFrame, measures: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each measure of a day beside that of the day before (0 where missing), as ``m`` and ``m_before``.

    ``daily`` holds one row per ``day`` (and ``keys``).
    """
    keys = keys or []
    sent = look_back(daily, 1, keys)
    pairs = sent.groupBy("current_day", *keys).agg(
        *[lagged_sum(m, F.col("lag") == 0).alias(m) for m in measures],
        *[lagged_sum(m, F.col("lag") == 1).alias(f"{m}_before") for m in measures],
    )
    return pairs.withColumn("previous_day", F.date_sub("current_day", 1))


def look_back(daily: DataFrame, days: int, keys: list[str] | None = None) -> DataFrame:
    """Send the row of each ``day`` to that day and to the ``days`` after it, with its ``lag``.

    Grouped by ``current_day``, this is every day together with its history, and
    a missing day shows up through the days before it. Nothing is sent past the
    last day. Each row becomes ``days + 1`` small rows: no window over the rows.
    """
    if keys:
        last_day = daily.agg(F.max("day")).scalar()
    else:
        # One row per day of the calendar: small however large the table is.
        last_day = F.max("day").over(Window.partitionBy(F.lit(0)))
    bounded = daily.withColumn("__last", last_day)
    sent = bounded.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(days))))
    sent = sent.withColumn("current_day", F.date_add("day", F.col("lag")))
    return sent.where(F.col("current_day") <= F.col("__last")).drop("__last")


def lagged_sum(measure: str, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col(measure))), F.lit(0))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", sev.severity_name(F.col("severity_code"))).drop("severity_code")
