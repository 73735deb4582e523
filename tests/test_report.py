import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import row_counts
from quernstone.plans.report import ADVICE, NO_ADVICE, dq_findings, dq_recommendations, dq_report, dq_report_daily
from quernstone.plans.rules import EMAIL_RULES, TableRules, rules_for

DAY, BEFORE = dt.date(2024, 3, 8), dt.date(2024, 3, 7)
COLUMNS = "email_id string, campaign_id string, recipient_id string, event_type string, event_timestamp timestamp, business_date date"


def sends(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def event(i, day, campaign="c", kind="open"):
    return (f"e{i}", campaign, f"r{i}", kind, dt.datetime.combine(day, dt.time(12)), day)


def test_rules():
    rules = rules_for("email_events")
    assert rules.business_keys == ("email_id", "event_type", "event_timestamp")
    assert rules.freshness_column == "event_timestamp"
    assert "campaign_id" in rules.critical_columns
    assert rules_for("main.analytics.email_events") is rules
    assert EMAIL_RULES["campaign_performance"].row_count_drop_critical_pct == 40.0
    unknown = rules_for("some_new_table_nobody_registered")
    assert (unknown.date_column, unknown.business_keys) == ("business_date", ())
    assert unknown.null_anomaly_threshold_pct > 0
    assert unknown.duplicate_keys == ("business_date",)
    with pytest.raises(ValueError):
        TableRules(lookback_days=0)


def test_clean_table(spark):
    df = sends(spark, [event(i, BEFORE) for i in range(10)] + [event(i, DAY) for i in range(10)])
    rules = TableRules(business_keys=("email_id",), critical_columns=("email_id",))
    report = dq_report(df, rules, DAY, "t", as_of="2024-03-08 13:00:00").first()
    assert report["findings"] == []
    assert report["overall_severity"] == "ok"
    assert report["summary"] == "No data quality issues detected for t on 2024-03-08."
    assert report["recommendations"] == [NO_ADVICE]


def test_everything_wrong(spark):
    rows = [event(i, BEFORE) for i in range(10)]
    rows += [event(1, DAY), event(1, DAY), event(2, DAY, None), event(3, DAY, "d")]
    rules = EMAIL_RULES["email_events"]
    df = sends(spark, rows)
    report = dq_report(df, rules, DAY, "email_events", as_of="2024-03-09 12:00:00")
    row = report.first()
    found = {f["issue_type"]: f for f in row["findings"]}
    assert list(found) == [
        "row_count_drop", "null_anomaly", "duplicate_records", "freshness_issue", "metric_check_error",
        "critical_column_nulls",
    ]
    assert found["row_count_drop"]["description"] == "Row count changed -60.0% vs 2024-03-07 (10 -> 4)."
    assert found["row_count_drop"]["severity"] == "critical"
    assert found["null_anomaly"]["description"] == "1 column(s) show abnormal null rates on 2024-03-08."
    flagged = json.loads(found["null_anomaly"]["evidence"])["flagged_columns"]
    assert [(f["column"], f["null_percentage"], f["status"]) for f in flagged] == [("campaign_id", 25.0, "critical")]
    assert found["duplicate_records"]["description"] == "1 duplicate key group(s) (2 records) found on 2024-03-08."
    sample = json.loads(found["duplicate_records"]["evidence"])["sample_duplicate_records"]
    assert sample[0]["email_id"] == "e1" and sample[0]["duplicate_count"] == 2
    assert found["freshness_issue"]["description"] == "Latest event_timestamp is 24.0h old (threshold 6.0h)."
    # The metric of this table is an identifier, which cannot be summed.
    assert found["metric_check_error"]["severity"] == "warning"
    assert found["critical_column_nulls"]["description"] == (
        "1 sampled record(s) have NULLs in a critical column (email_id, campaign_id, recipient_id, event_type)."
    )
    assert json.loads(found["critical_column_nulls"]["evidence"])["failed_count"] == 1
    bare = dq_report(df, rules, DAY, "email_events", as_of="2024-03-09 12:00:00", with_samples=False).first()
    assert [f["description"] for f in bare["findings"]] == [f["description"] for f in row["findings"]]
    assert row["overall_severity"] == "critical"
    assert row["summary"].startswith("6 finding(s) for email_events on 2024-03-08 (overall severity: critical).")
    assert row["recommendations"] == [text for types, text in ADVICE if set(types) & set(found)]
    assert dq_findings(report).count() == 6
    assert [r["position"] for r in dq_recommendations(report).collect()] == [1, 2, 3, 4]


def test_a_missing_column_fails_its_check_only(spark):
    df = sends(spark, [event(i, BEFORE) for i in range(10)] + [event(1, DAY)]).drop("event_timestamp")
    rules = TableRules(business_keys=("nobody",), critical_columns=("missing",))
    found = dq_report(df, rules, DAY).first()["findings"]
    assert [f["issue_type"] for f in found] == [
        "row_count_drop", "duplicate_check_error", "freshness_check_error", "failed_records_error",
    ]
    assert found[1]["description"] == "no such column: nobody"


def test_a_table_without_the_date_still_gives_a_report(spark):
    report = dq_report(spark.range(3), TableRules(), DAY).first()
    assert len(report["findings"]) == 4
    assert report["overall_severity"] == "warning"


def test_metric_without_a_base_reads_none(spark):
    df = spark.createDataFrame([("c", DAY, 5, dt.datetime(2024, 3, 8))], "campaign_id string, business_date date, opens long, updated_at timestamp")
    rules = TableRules(business_keys=("campaign_id",), freshness_column="updated_at", metric_column="opens", group_by_column="campaign_id")
    found = dq_report(df, rules, DAY, as_of="2024-03-08 01:00:00").first()["findings"]
    assert [f["description"] for f in found] == ["opens moved None% vs 2024-03-07."]


def test_daily_report_agrees_with_single_days(spark):
    rows = []
    for d in range(12):
        day = dt.date(2024, 3, 1) + dt.timedelta(days=d)
        if d == 5:
            continue
        rows += [event(i % (7 + d), day, None if (i + d) % 5 == 0 and d > 6 else f"c{i % 3}") for i in range(12 + (d * 7) % 11)]
    df = sends(spark, rows).withColumn("amount", F.length("recipient_id").cast("double"))
    rules = TableRules(
        business_keys=("email_id",), critical_columns=("campaign_id",), metric_column="amount", group_by_column="campaign_id"
    )
    daily = {r["business_date"]: r for r in dq_report_daily(df, rules, "t").collect()}
    assert len(daily) == 12
    date_bound = ["row_count_drop", "null_anomaly", "duplicate_records", "metric_trend_deviation"]
    for day, row in daily.items():
        single = dq_report(df, rules, day, "t", as_of="2024-03-01 00:00:00").first()
        want = [(f["issue_type"], f["severity"], f["description"]) for f in single["findings"] if f["issue_type"] in date_bound]
        got = [(f["issue_type"], f["severity"], f["description"]) for f in row["findings"] if f["issue_type"] in date_bound]
        assert got == want, day
    moved = next(f for f in daily[dt.date(2024, 3, 8)]["findings"] if f["issue_type"] == "metric_trend_deviation")
    assert json.loads(moved["evidence"])["largest_contributors"][0]["rank"] == 1


ODD = "day date, n long, at string, keys string, shop string, text_day string"


def odd_rows(at="2024-03-08 11:00:00"):
    big = 2**62
    return [(d, big, at, None if k == 0 else f"k{k}", "a", f"{d} 10:00:00") for d in (BEFORE, DAY) for k in range(3)]


def types_of(report):
    return [f["issue_type"] for f in report.first()["findings"]]


def test_a_check_that_cannot_run_leaves_the_others(spark):
    df = spark.createDataFrame(odd_rows(), ODD)
    rules = TableRules(date_column="day", freshness_column="at", critical_columns=("keys",), business_keys=("shop",))
    as_of = "2024-03-08 12:00:00"
    assert types_of(dq_report(df, rules, DAY, as_of=as_of)) == ["duplicate_records", "critical_column_nulls"]
    # A date column that holds no days.
    found = types_of(dq_report(df, TableRules(date_column="n", freshness_column="at", critical_columns=("keys",)), DAY, as_of=as_of))
    assert found == ["row_count_check_error", "null_check_error", "duplicate_check_error", "critical_column_nulls"]
    # A newest record that is no timestamp.
    text = spark.createDataFrame(odd_rows("yesterday"), ODD)
    report = dq_report(text, rules, DAY, as_of=as_of).first()
    assert [f["issue_type"] for f in report["findings"]] == ["duplicate_records", "freshness_issue", "critical_column_nulls"]
    assert report["findings"][1]["severity"] == "warning" and "yesterday" in report["findings"][1]["description"]
    # A metric whose sum is no long.
    metric = TableRules(date_column="day", freshness_column="at", metric_column="n", group_by_column="shop", business_keys=("keys",))
    assert types_of(dq_report(df, metric, DAY, as_of=as_of)) == []
    assert dq_report_daily(df, metric).count() == 2


def test_days_of_text_with_times(spark):
    df = spark.createDataFrame(odd_rows(), ODD)
    one = row_counts.compare_row_counts(df, "text_day", BEFORE, DAY).first()
    assert (one["previous_count"], one["current_count"]) == (3, 3)


def test_evidence_keeps_nulls_and_digits(spark):
    rows = [event(1, DAY), event(1, DAY), event(2, DAY, None)]
    df = sends(spark, rows).withColumn("event_timestamp", F.lit("2024-03-08 10:00:00.123456").cast("timestamp"))
    rules = TableRules(business_keys=("campaign_id",), critical_columns=("campaign_id",))
    found = {f["issue_type"]: json.loads(f["evidence"]) for f in dq_report(df, rules, DAY).first()["findings"]}
    sample = found["critical_column_nulls"]["sample_records"][0]
    assert sample["campaign_id"] is None and sample["event_timestamp"].startswith("2024-03-08T10:00:00.123456")
