"""Age of the newest record."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev

THRESHOLD_HOURS = 6.0


def delay_hours(newest: Column, as_of: dt.datetime | str | None) -> Column:
    """Hours from the newest timestamp to ``as_of`` (now by default); negative if it lies ahead."""
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    # Text that is no timestamp has no age.
    seconds = F.unix_timestamp(now) - F.unix_timestamp(newest.try_cast("timestamp"))
    return F.round(seconds / 3600.0, 2)


def detect_freshness(
    df: DataFrame,
    timestamp_column: str,
    threshold_hours: float = THRESHOLD_HOURS,
    as_of: dt.datetime | str | None = None,
) -> DataFrame:
    """One row: newest timestamp, its age, severity. Looks at all days of the table."""
    newest = df.agg(F.max(F.col(f"`{timestamp_column}`")).alias("newest"))
    aged = newest.select("newest", delay_hours(F.col("newest"), as_of).alias("delay_hours"))
    return aged.select(
        F.col("newest").cast("string").alias("max_timestamp"),
        "delay_hours",
        F.lit(float(threshold_hours)).alias("threshold_hours"),
        sev.severity_name(sev.by_delay(F.col("delay_hours"), threshold_hours)).alias("severity"),
    )
