"""What is checked on a table, and how strictly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableRules:
    """Columns and thresholds of one table's checks; the defaults suit a table nobody described."""

    business_keys: tuple[str, ...] = ()
    date_column: str = "business_date"
    freshness_column: str = "event_timestamp"
    freshness_threshold_hours: float = 6.0
    critical_columns: tuple[str, ...] = ()
    null_anomaly_threshold_pct: float = 5.0
    row_count_drop_warning_pct: float = 10.0
    row_count_drop_critical_pct: float = 30.0
    metric_column: str = ""
    group_by_column: str = ""
    lookback_days: int = 7

    def __post_init__(self) -> None:
        if self.lookback_days < 1:
            raise ValueError("at least one day must be looked back on")

    @property
    def duplicate_keys(self) -> tuple[str, ...]:
        """Without business keys all rows of a day share one key, the day."""
        return self.business_keys or (self.date_column,)


# The rules of the three email analytics tables.
EMAIL_RULES = {
    "email_events": TableRules(
        business_keys=("email_id", "event_type", "event_timestamp"),
        critical_columns=("email_id", "campaign_id", "recipient_id", "event_type"),
        metric_column="email_id",
        group_by_column="campaign_id",
    ),
    "email_sends": TableRules(
        business_keys=("email_id",),
        date_column="send_date",
        freshness_column="sent_timestamp",
        freshness_threshold_hours=4.0,
        critical_columns=("email_id", "campaign_id", "recipient_id"),
        metric_column="email_id",
        group_by_column="campaign_id",
    ),
    "campaign_performance": TableRules(
        business_keys=("campaign_id", "business_date"),
        freshness_column="updated_at",
        freshness_threshold_hours=12.0,
        critical_columns=("campaign_id", "sends", "opens", "clicks"),
        row_count_drop_warning_pct=15.0,
        row_count_drop_critical_pct=40.0,
        metric_column="opens",
        group_by_column="campaign_id",
    ),
}


def rules_for(table: str) -> TableRules:
    """Rules of a bare or qualified table name, the defaults if it is not known."""
    return EMAIL_RULES.get(table.rsplit(".", 1)[-1], TableRules())
