"""Daily sums of a table's files, kept so that a report reads new files only.

A state is a folder: a log, and one folder per update with two tables

* ``days``: file, day, n, nulls_0 .. nulls_k, m - rows, nulls by column and the sum of the metric
* ``groups``: file, day, group_value, m

What a file holds is never counted twice: sums are stored by file, and the
entry of an update says which files the table has. A file that was written
anew, under its old name or another, is a new file; the sums of one that is gone
are passed over. A late file thus changes the days that it touches and no other.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection
from dataclasses import dataclass
from functools import cached_property, reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import business_day
from ..operators import metrics, nulls, row_counts
from ..sources.scratch import kept

#: A state of so many folders is merged by the next update.
MOST_FOLDERS = 16
LOG = "folders array<string>, files_read long, files long, columns array<string>, at timestamp, entry string"
#: What tells files apart: a name, and the size and time of change of what lies there.
FILE = ("path", "bytes", "changed")


@dataclass(frozen=True)
class DailyState:
    """The state of a table as the last update left it."""

    spark: SparkSession
    root: str
    folders: tuple[str, ...]
    columns: tuple[str, ...]
    files_read: int

    def _table(self, name: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.root}/{folder}/{name}") for folder in self.folders]
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        files = self.spark.read.parquet(f"{self.root}/{self.folders[-1]}/files")
        return rows.join(files, list(FILE), "left_semi")

    @cached_property
    def days(self) -> DataFrame:
        """One row per day: day, n, nulls_0 .., m."""
        rows = self._table("days")
        sums = [c for c in rows.columns if c not in (*FILE, "day")]
        return rows.groupBy("day").agg(*[F.sum(c).alias(c) for c in sums])

    @cached_property
    def groups(self) -> DataFrame:
        """One row per day and group: day, group_value, m."""
        return self._table("groups").groupBy("day", "group_value").agg(F.sum("m").alias("m"))

    def row_counts(self, warning_pct: float = 10.0, critical_pct: float = 30.0) -> DataFrame:
        """The rows of ``row_counts.compare_row_counts_daily``."""
        return row_counts.row_counts_of_days(self.days.select("day", "n"), warning_pct, critical_pct)

    def null_anomalies(self, threshold_pct: float = 5.0, critical_columns: Collection[str] = ()) -> DataFrame:
        """The rows of ``nulls.detect_null_anomalies_daily``."""
        return nulls.null_anomalies_of_days(self.days, list(self.columns), threshold_pct, critical_columns)

    def metric_totals(self) -> DataFrame:
        """The rows of ``metrics.metric_totals_daily``."""
        return metrics.metric_totals_of_days(self.days.select("day", "m"))

    def metric_contributors(self, limit: int = metrics.CONTRIBUTORS) -> DataFrame:
        """The rows of ``metrics.metric_contributors_daily``."""
        return metrics.metric_contributors_of_days(self.groups, limit)


def update_daily_state(table: DataFrame, root: str, date_column: str, metric: str, group_by: str) -> DailyState:
    """Count what is new in the files of ``table`` and return the state.

    ``table`` is a scan of files, with or without expressions of its columns
    but without shuffles; it must be read the same way each time. Only files
    that the state does not have are opened (Spark leaves the others out when
    it plans the scan); the names of the files go through the driver, as those
    of any scan do. One update at a time may run;
    what a failed one wrote is never read.
    """
    metrics.require_numeric(table, metric)
    spark = table.sparkSession
    columns = nulls.checked_columns(table, date_column)
    before = read_daily_state(spark, root)
    if before and list(before.columns) != columns:
        raise ValueError(f"the state counts the columns {list(before.columns)}, the table has {columns}")
    meta = F.col("_metadata")
    named = table.withColumns(
        {"__path": meta.file_path, "__bytes": meta.file_size, "__changed": meta.file_modification_time}
    )
    files = kept(_listed(table), "files")
    new = files
    if before:
        known = spark.read.parquet(f"{root}/{before.folders[-1]}/files")
        new = files.join(known, list(FILE), "left_anti")
    paths = [r["path"] for r in new.select("path").collect()]
    n_files = files.count()
    if before and not paths and n_files == known.count():
        return before
    folder = uuid.uuid4().hex
    # A filter on the name of a file is one on the list of files.
    rows = named.where(F.col("_metadata.file_path").isin(paths)).withColumn("__day", business_day(table, date_column))
    rows = rows.where(F.col("__day").isNotNull())
    keys = [*(F.col(f"__{c}").alias(c) for c in FILE), F.col("__day").alias("day")]
    total = metrics.daily_metric_sum(table, metric).alias("m")
    rows.groupBy(*keys).agg(*nulls.daily_null_counts(columns), total).write.parquet(f"{root}/{folder}/days")
    by_group = rows.groupBy(*keys, F.col(f"`{group_by}`").alias("group_value")).agg(total)
    by_group.write.parquet(f"{root}/{folder}/groups")
    files.coalesce(1).write.parquet(f"{root}/{folder}/files")
    state = DailyState(spark, root, (*(before.folders if before else ()), folder), tuple(columns), len(paths))
    if len(state.folders) >= MOST_FOLDERS:
        state = _merged(state)
    row = (list(state.folders), len(paths), n_files, columns)
    entry = spark.createDataFrame([row], "folders array<string>, files_read long, files long, columns array<string>")
    stamped = entry.select("*", F.current_timestamp().alias("at"), F.uuid().alias("entry"))
    stamped.coalesce(1).write.mode("append").parquet(f"{root}/log")
    return state


def _listed(table: DataFrame) -> DataFrame:
    """path, bytes, changed of the files of a scan, as their rows name them; the files are listed, not opened."""
    names = [unquote(name) for name in table.inputFiles()]
    if not names:
        return table.sparkSession.createDataFrame([], "path string, bytes long, changed timestamp")
    meta = F.col("_metadata")
    return table.sparkSession.read.format("binaryFile").load(names).select(
        meta.file_path.alias("path"), meta.file_size.alias("bytes"), meta.file_modification_time.alias("changed")
    )


def _merged(state: DailyState) -> DailyState:
    """The sums of the files that are there, in one folder."""
    folder = uuid.uuid4().hex
    for name in ("days", "groups"):
        state._table(name).write.parquet(f"{state.root}/{folder}/{name}")
    files = state.spark.read.parquet(f"{state.root}/{state.folders[-1]}/files")
    files.coalesce(1).write.parquet(f"{state.root}/{folder}/files")
    return DailyState(state.spark, state.root, (folder,), state.columns, state.files_read)


def state_log(spark: SparkSession, root: str) -> DataFrame:
    """One row per update that found a difference: folders, files_read, files, columns, at, entry."""
    try:
        return spark.read.schema(LOG).parquet(f"{root}/log")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def read_daily_state(spark: SparkSession, root: str) -> DailyState | None:
    """The state as the last update left it; None before the first."""
    last = state_log(spark, root).agg(F.max_by(F.struct("folders", "columns", "files_read"), F.struct("at", "entry"))).first()[0]
    if last is None:
        return None
    return DailyState(spark, root, tuple(last["folders"]), tuple(last["columns"]), last["files_read"])
