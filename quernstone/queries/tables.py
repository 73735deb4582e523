"""The given tables, and the views the queries take of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import spread_scan

DAY, DAY_BEFORE, AS_OF = "2024-01-10", "2024-01-09", "2024-01-31 08:30:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows take long to work on."""
    return spread_scan(read(spark, sf_dir, name).select(*columns))


def holed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls: errors lose their type, and small values are lost from ``DAY`` on."""
    late = F.col("ts") >= F.lit(DAY).cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(~(late & (F.col("value") < 10)), F.col("value")).alias("value"),
        "props",
    )


HOLED_EVENTS = f"""
holed AS (
  SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type,
         CASE WHEN ts >= TIMESTAMP '{DAY}' AND value < 10 THEN NULL ELSE value END AS value, props
  FROM events)"""
