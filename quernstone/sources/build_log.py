"""Status of an index, kept as an append-only log below the index folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "status string, document_count long, last_error string, version string, updated_at timestamp, entry string"
)


def append_status(
    spark: SparkSession,
    root: str,
    status: str,
    document_count: int | None = None,
    last_error: str | None = None,
    version: str | None = None,
) -> None:
    """Add one row: building, ready (with count and version) or failed (with error)."""
    row = spark.createDataFrame(
        [(status, document_count, last_error, version)],
        "status string, document_count long, last_error string, version string",
    )
    stamped = row.select("*", F.current_timestamp().alias("updated_at"), F.uuid().alias("entry"))
    stamped.coalesce(1).write.mode("append").parquet(f"{root}/status")


def read_log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/status")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def index_status(spark: SparkSession, root: str) -> DataFrame:
    """One row: status, document_count, start and end of the last build, last error, version.

    A new build keeps the count and the version of the one before until it is
    ready, and a failed one leaves them. Without any entry the index is pending.
    """
    log = read_log(spark, root)
    order = F.struct("updated_at", "entry")

    def latest(value, status: str | None = None):
        return F.max_by(value, order if status is None else F.when(F.col("status") == status, order))

    return log.agg(
        F.coalesce(latest("status"), F.lit("pending")).alias("status"),
        F.coalesce(latest("document_count", "ready"), F.lit(0)).alias("document_count"),
        latest("updated_at", "building").alias("last_build_started_at"),
        latest("updated_at", "ready").alias("last_build_completed_at"),
        latest("last_error").alias("last_error"),
        F.max_by("version", F.when(F.col("version").isNotNull(), order)).alias("version"),
    )
