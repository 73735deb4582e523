import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernstone.operators import duplicates, failed, freshness, metrics, nulls, row_counts

D = [dt.date(2024, 3, d) for d in range(1, 32)]


def sales(spark, rows, day_type="date"):
    df = spark.createDataFrame(rows, "day date, shop string, amount double")
    return df.withColumn("day", F.col("day").cast(day_type))


@pytest.mark.parametrize("day_type", ["date", "timestamp", "timestamp_ntz", "string"])
def test_row_counts_for_every_kind_of_day(spark, day_type):
    df = sales(spark, [(D[0], "a", 1.0)] * 10 + [(D[1], "a", 1.0)] * 6 + [(None, "a", 1.0)], day_type)
    row = row_counts.compare_row_counts(df, "day", D[1], D[0]).first()
    assert (row["current_count"], row["previous_count"], row["difference"]) == (6, 10, -4)
    assert (row["percentage_change"], row["severity"]) == (-40.0, "critical")


def test_row_counts_without_a_base(spark):
    df = sales(spark, [(D[1], "a", 1.0)])
    rise = row_counts.compare_row_counts(df, "day", D[1], D[0]).first()
    assert (rise["percentage_change"], rise["severity"]) == (100.0, "ok")
    nothing = row_counts.compare_row_counts(df, "day", D[5], D[4]).first()
    assert (nothing["current_count"], nothing["percentage_change"], nothing["severity"]) == (0, 0.0, "ok")


def test_daily_counts_show_a_missing_day_but_nothing_after_the_last(spark):
    df = sales(spark, [(D[0], "a", 1.0)] * 4 + [(D[3], "a", 1.0)] * 2 + [(None, "a", 1.0)])
    rows = row_counts.compare_row_counts_daily(df, "day").orderBy("current_day").collect()
    assert [(r["current_day"], r["current_count"], r["previous_count"], r["severity"]) for r in rows] == [
        (D[0], 4, 0, "ok"),
        (D[1], 0, 4, "critical"),
        (D[3], 2, 0, "ok"),
    ]


def test_history_is_pooled_and_not_averaged(spark):
    # 1 of 1 null on one day and 0 of 9 on another: 10 % of the rows, not 50 % of the days.
    rows = [(D[0], None, 1.0)] + [(D[1], "a", 1.0)] * 9 + [(D[7], "a", None)] * 4
    found = {r["column_name"]: r for r in nulls.detect_null_anomalies(sales(spark, rows), "day", D[7]).collect()}
    assert found["shop"]["historical_average"] == 10.0
    assert (found["shop"]["null_percentage"], found["shop"]["severity"]) == (0.0, "critical")
    assert (found["amount"]["null_percentage"], found["amount"]["severity"]) == (100.0, "critical")


def test_history_reaches_back_seven_days_only(spark):
    rows = [(D[0], None, 1.0)] + [(D[8], "a", 1.0)]
    found = {r["column_name"]: r for r in nulls.detect_null_anomalies(sales(spark, rows), "day", D[8]).collect()}
    assert found["shop"]["historical_average"] is None
    assert found["shop"]["severity"] == "ok"


def test_nulls_need_a_column(spark):
    with pytest.raises(ValueError):
        nulls.detect_null_anomalies(sales(spark, []).select("day"), "day", D[0])


def test_daily_nulls_equal_each_single_day(spark):
    rows = [(D[i % 9], None if i % 4 == 0 else "a", None if i % 7 == 3 else 1.0) for i in range(60)]
    df = sales(spark, rows)
    daily = nulls.detect_null_anomalies_daily(df, "day", 5.0, ["shop"])
    for day in D[:9]:
        single = nulls.detect_null_anomalies(df, "day", day, 5.0, ["shop"]).collect()
        assert sorted(daily.where(F.col("current_day") == F.lit(day)).drop("current_day").collect()) == sorted(single)


def test_null_keys_are_one_group(spark):
    df = sales(spark, [(D[0], None, 1.0), (D[0], None, 2.0), (D[0], "a", 1.0), (D[1], "a", 1.0)])
    row = duplicates.duplicate_summary(df, ["shop"], "day", D[0]).first()
    assert (row["duplicate_groups"], row["duplicate_records"], row["severity"]) == (1, 2, "warning")
    sample = duplicates.duplicate_samples(df, ["shop"], "day", D[0]).collect()
    assert [(r["shop"], r["duplicate_count"]) for r in sample] == [(None, 2)]


def test_no_duplicates(spark):
    row = duplicates.duplicate_summary(sales(spark, []), ["shop"], "day", D[0]).first()
    assert (row["duplicate_groups"], row["duplicate_records"], row["severity"]) == (0, 0, "ok")
    with pytest.raises(ValueError):
        duplicates.duplicate_summary(sales(spark, []), [], "day", D[0])


def test_freshness(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 1, 12),), (None,)], "at timestamp")
    late = freshness.detect_freshness(df, "at", 6.0, "2024-03-01 20:00:00").first()
    assert (late["delay_hours"], late["severity"]) == (8.0, "warning")
    ahead = freshness.detect_freshness(df, "at", 6.0, "2024-03-01 10:30:00").first()
    assert (ahead["delay_hours"], ahead["severity"]) == (-1.5, "ok")
    empty = freshness.detect_freshness(df.where("at is null"), "at").first()
    assert (empty["max_timestamp"], empty["delay_hours"], empty["severity"]) == (None, None, "critical")
    assert freshness.detect_freshness(df, "at").first()["severity"] == "critical"


def test_metrics(spark):
    df = sales(spark, [(D[0], "a", 10.0), (D[0], "b", 10.0), (D[1], "a", 25.0), (D[1], "b", None), (D[1], None, 1.0)])
    row = metrics.compare_metric_totals(df, "amount", "day", D[0], D[1]).first()
    assert (row["previous_total"], row["current_total"], row["percentage_change"]) == (20.0, 26.0, 30.0)
    assert row["severity"] == "critical"
    top = metrics.metric_contributors(df, "amount", "shop", "day", D[0], D[1]).collect()
    assert [(r["group_value"], r["difference"], r["percentage_change"]) for r in top] == [
        ("a", 15.0, 150.0),
        ("b", -10.0, -100.0),
        (None, 1.0, None),
    ]
    no_base = metrics.compare_metric_totals(df, "amount", "day", D[8], D[1]).first()
    assert (no_base["percentage_change"], no_base["severity"]) == (None, "warning")
    with pytest.raises(TypeError):
        metrics.compare_metric_totals(df, "shop", "day", D[0], D[1])


def test_contributors_of_one_hot_group_are_whole(spark):
    hot = spark.range(30000).select(
        F.lit(D[1]).alias("day"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("shop"),
        F.lit(1.0).alias("amount"),
    )
    top = metrics.metric_contributors(hot, "amount", "shop", "day", D[0], D[1]).first()
    assert (top["group_value"], top["current_value"]) == ("hot", 10000.0)


def test_failed_records(spark):
    df = sales(spark, [(D[0], None, float(i)) for i in range(30)] + [(D[0], "a", None)])
    assert failed.failed_records(df, "shop is null", 5).count() == 5
    with pytest.raises(ValueError):
        failed.failed_records(df, "shop is null", 0)
    row = failed.failed_count(df, failed.any_null(["shop", "amount"])).first()
    assert (row["failed_count"], row["total_count"]) == (31, 31)
    with pytest.raises(ValueError):
        failed.failed_records(df, "  ")
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        failed.failed_records(df, "1=1) UNION SELECT * FROM x --").collect()


def test_sample_is_clamped(spark):
    assert failed.sample_data(spark.range(500), 300).count() == 300
    with pytest.raises(ValueError):
        failed.sample_data(spark.range(500), -5)
