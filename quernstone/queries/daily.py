"""Daily comparisons from the stored sums of a table's files, each with the SQL of the full scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.daily_state import state_log, update_daily_state
from ..sources.scratch import scratch_path
from .quality import ORACLES as QUALITY_ORACLES
from .tables import DAY, holed_events, read


def _updated(spark, sf_dir):
    """The state of the events after two updates: for the days before ``DAY``, then with a file of the rest and a late one."""
    folder, root = scratch_path(spark, "table"), scratch_path(spark, "state")
    events = read(spark, sf_dir, "events")
    early = (F.col("ts") < F.lit(DAY).cast("timestamp_ntz")) & (F.col("event_id") % 10 != 0)
    for part in (early, ~early):
        events.where(part).write.mode("append").parquet(f"{folder}/events.parquet")
        state = update_daily_state(holed_events(spark, folder), root, "ts", "value", "user_id")
    return state, root


def _updates(spark, sf_dir):
    """Whether the second update left the files of the first unread."""
    _, root = _updated(spark, sf_dir)
    log = state_log(spark, root)
    return log.agg(F.count(F.lit(1)).alias("updates"), (F.sum("files_read") == F.max("files")).alias("each_file_once"))


QUERIES = {
    "state_null_anomalies": lambda spark, d: _updated(spark, d)[0].null_anomalies(5.0, ("event_type", "value")),
    "state_metric_totals": lambda spark, d: _updated(spark, d)[0].metric_totals(),
    "state_metric_contributors": lambda spark, d: _updated(spark, d)[0].metric_contributors(),
    "state_row_counts": lambda spark, d: _updated(spark, d)[0].row_counts(),
    "state_updates": _updates,
}

ORACLES = {
    "state_null_anomalies": QUALITY_ORACLES["null_anomalies_daily"],
    "state_metric_totals": QUALITY_ORACLES["metric_totals_daily"],
    "state_metric_contributors": QUALITY_ORACLES["metric_contributors_daily"],
    "state_row_counts": QUALITY_ORACLES["row_counts_daily"].replace("orders", "events").replace("o_orderdate", "ts"),
    "state_updates": "SELECT 2::BIGINT AS updates, TRUE AS each_file_once",
}
