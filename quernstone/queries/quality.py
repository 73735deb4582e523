"""Data-quality queries over the events (and orders) table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import severity as sev
from ..operators import duplicates, failed, freshness, metrics, nulls, row_counts
from ..plans.report import dq_findings, dq_recommendations, dq_report, dq_report_daily
from ..plans.rules import TableRules, rules_for
from .tables import AS_OF, DAY, DAY_BEFORE, HOLED_EVENTS, holed_events, read

KEYS = ("user_id", "event_type")
RULES = TableRules(
    business_keys=KEYS,
    date_column="ts",
    freshness_column="ts",
    critical_columns=("event_type", "value"),
    metric_column="value",
    group_by_column="event_type",
)
FAILED = "value > 100 AND event_type <> 'view'"


def _report(spark, sf_dir):
    return dq_report(holed_events(spark, sf_dir), RULES, DAY, "events", as_of=AS_OF)


def _report_daily(spark, sf_dir):
    return dq_report_daily(holed_events(spark, sf_dir), RULES, "events")


def campaigns(spark, sf_dir):
    """Daily results per campaign, taking users in twenty groups as the audience of one campaign each."""
    events = read(spark, sf_dir, "events")
    campaign = F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string"))
    return events.groupBy(campaign.alias("campaign_id"), F.to_date("ts").alias("business_date")).agg(
        F.count(F.lit(1)).alias("sends"),
        F.count_if(F.col("event_type") == "view").alias("opens"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.max("ts").alias("updated_at"),
    )


def _campaign_report(spark, sf_dir):
    table = "main.email.campaign_performance"
    return dq_report(campaigns(spark, sf_dir), rules_for(table), DAY, table, as_of=AS_OF)


def _severity_of_daily_change(spark, sf_dir):
    daily = metrics.metric_totals_daily(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate")
    change = sev.pct_change(F.col("previous_total"), F.col("current_total"))
    return daily.select(
        "current_day",
        sev.severity_name(sev.by_pct_change(change, 20.0, 50.0)).alias("change_severity"),
        sev.severity_name(sev.by_drop(change, 20.0, 50.0)).alias("drop_severity"),
    )


def _severity_of_daily_nulls(spark, sf_dir):
    daily = (
        holed_events(spark, sf_dir)
        .groupBy(F.to_date("ts").alias("day"))
        .agg(
            (F.count_if(F.col("value").isNull()) / F.count(F.lit(1)) * 100).alias("value_pct"),
            (F.count_if(F.col("event_type").isNull()) / F.count(F.lit(1)) * 100).alias("type_pct"),
        )
    )
    return daily.select(
        "day",
        sev.severity_name(sev.by_deviation(F.col("value_pct"), F.lit(5.0), 8.0)).alias("usual"),
        sev.severity_name(sev.by_deviation(F.col("value_pct"), F.lit(5.0), 8.0, True)).alias("tightened"),
        sev.severity_name(sev.by_deviation(F.col("type_pct"), F.lit(None).cast("double"), 11.0)).alias("no_history"),
    )


QUERIES = {
    "severity_pct": _severity_of_daily_change,
    "severity_deviation": _severity_of_daily_nulls,
    "row_count_compare": lambda spark, d: row_counts.compare_row_counts(
        read(spark, d, "events"), "ts", DAY, DAY_BEFORE, 2.0, 5.0
    ),
    "row_counts_daily": lambda spark, d: row_counts.compare_row_counts_daily(
        read(spark, d, "orders"), "o_orderdate"
    ),
    "null_anomalies": lambda spark, d: nulls.detect_null_anomalies(
        holed_events(spark, d), "ts", DAY, 5.0, ("event_type", "value")
    ),
    "null_anomalies_daily": lambda spark, d: nulls.detect_null_anomalies_daily(
        holed_events(spark, d), "ts", 5.0, ("event_type", "value")
    ),
    "null_anomaly_summary": lambda spark, d: nulls.null_anomaly_summary(QUERIES["null_anomalies"](spark, d)),
    "null_anomaly_summary_daily": lambda spark, d: nulls.null_anomaly_summary(
        QUERIES["null_anomalies_daily"](spark, d)
    ),
    "duplicate_summary": lambda spark, d: duplicates.duplicate_summary(holed_events(spark, d), KEYS, "ts", DAY),
    "duplicate_samples": lambda spark, d: duplicates.duplicate_samples(holed_events(spark, d), KEYS, "ts", DAY),
    "duplicates_daily": lambda spark, d: duplicates.duplicate_summary_daily(holed_events(spark, d), KEYS, "ts"),
    "freshness": lambda spark, d: freshness.detect_freshness(read(spark, d, "events"), "ts", 6.0, AS_OF),
    "metric_totals": lambda spark, d: metrics.compare_metric_totals(
        holed_events(spark, d), "value", "ts", DAY_BEFORE, DAY
    ),
    "metric_totals_daily": lambda spark, d: metrics.metric_totals_daily(holed_events(spark, d), "value", "ts"),
    "metric_contributors": lambda spark, d: metrics.metric_contributors(
        holed_events(spark, d), "value", "user_id", "ts", DAY_BEFORE, DAY
    ),
    "metric_contributors_daily": lambda spark, d: metrics.metric_contributors_daily(
        holed_events(spark, d), "value", "user_id", "ts"
    ),
    "failed_records": lambda spark, d: failed.failed_records(holed_events(spark, d), FAILED, 100, ["event_id"]),
    "failed_count": lambda spark, d: failed.failed_count(holed_events(spark, d), FAILED),
    "critical_nulls": lambda spark, d: failed.failed_count(
        holed_events(spark, d), failed.any_null(["event_type", "value"])
    ),
    "sample_data": lambda spark, d: failed.sample_data(read(spark, d, "orders"), 500, ["o_orderkey"]),
    "dq_findings": lambda spark, d: dq_findings(_report(spark, d)).drop("evidence"),
    "dq_summary": lambda spark, d: _report(spark, d).select("business_date", "summary", "overall_severity"),
    "dq_recommendations": lambda spark, d: dq_recommendations(_report(spark, d)),
    "campaign_findings": lambda spark, d: dq_findings(_campaign_report(spark, d)).drop("evidence"),
    "dq_findings_daily": lambda spark, d: dq_findings(_report_daily(spark, d)).drop("evidence"),
    "dq_summary_daily": lambda spark, d: _report_daily(spark, d).select(
        "business_date", "summary", "overall_severity"
    ),
    "dq_recommendations_daily": lambda spark, d: dq_recommendations(_report_daily(spark, d)),
}


def _pct_severity(change: str, warning: float, critical: float) -> str:
    return (
        f"CASE WHEN {change} IS NULL THEN 'warning' WHEN abs({change}) >= {critical} THEN 'critical'"
        f" WHEN abs({change}) >= {warning} THEN 'warning' ELSE 'ok' END"
    )


def _drop_severity(change: str, warning: float, critical: float) -> str:
    return (
        f"CASE WHEN {change} <= -{critical} THEN 'critical' WHEN {change} <= -{warning} THEN 'warning' ELSE 'ok' END"
    )


def _deviation_severity(now: str, before: str, threshold: str, tight: str = "FALSE") -> str:
    gap = f"abs({now} - coalesce({before}, 0))"
    scale = f"(CASE WHEN {tight} THEN 0.5 ELSE 1.0 END)"
    return (
        f"CASE WHEN {now} >= 50 THEN 'critical' WHEN {gap} >= {scale} * 2 * {threshold} THEN 'critical'"
        f" WHEN {gap} >= {scale} * {threshold} THEN 'warning' ELSE 'ok' END"
    )


GROUP_SEVERITY = (
    "CASE WHEN duplicate_groups = 0 THEN 'ok' WHEN duplicate_groups >= 10 THEN 'critical' ELSE 'warning' END"
)
CHANGE = "CASE WHEN previous <> 0 THEN (current - previous) / nullif(previous, 0) * 100 END"
COUNT_CHANGE = (
    "coalesce(CASE WHEN previous <> 0 THEN (current - previous) / nullif(previous, 0)::DOUBLE * 100 END,"
    " CASE WHEN current > 0 THEN 100.0 ELSE 0.0 END)::DOUBLE"
)
CHECKED = ("event_id", "user_id", "event_type", "value", "props")


def _calendar(name: str, table: str, column: str) -> str:
    return (
        f"{name} AS (SELECT unnest(generate_series(min({column})::DATE, max({column})::DATE, INTERVAL 1 DAY))::DATE"
        f" AS day FROM {table})"
    )


def _counts_daily(table: str, column: str) -> str:
    """Every day up to the last that has rows or follows one that has."""
    return f"""{_calendar('days', table, column)},
counted AS (SELECT {column}::DATE AS day, count(*) AS n FROM {table} GROUP BY 1),
pairs AS (
  SELECT days.day, coalesce(a.n, 0) AS current, coalesce(b.n, 0) AS previous
  FROM days LEFT JOIN counted a ON a.day = days.day LEFT JOIN counted b ON b.day = days.day - 1
  WHERE a.n IS NOT NULL OR b.n IS NOT NULL)"""


def _sums_daily(table: str, column: str, metric: str) -> str:
    return f"""{_calendar('dates', table, column)},
summed AS (SELECT {column}::DATE AS day, coalesce(sum({metric}), 0) AS n FROM {table} GROUP BY 1),
moves AS (
  SELECT dates.day, coalesce(a.n, 0) AS current, coalesce(b.n, 0) AS previous
  FROM dates LEFT JOIN summed a ON a.day = dates.day LEFT JOIN summed b ON b.day = dates.day - 1
  WHERE a.n IS NOT NULL OR b.n IS NOT NULL)"""


def _null_rates(days: str) -> str:
    """now_pct and before_pct of every checked column on each of the days."""
    per_column = " UNION ALL ".join(
        f"""SELECT d.day, {i + 1} AS position, '{c}' AS column_name,
          count(*) FILTER (WHERE h.ts::DATE = d.day AND h.{c} IS NULL)
            / count(*) FILTER (WHERE h.ts::DATE = d.day) * 100.0 AS now_pct,
          round(count(*) FILTER (WHERE h.ts::DATE < d.day AND h.{c} IS NULL)
            / nullif(count(*) FILTER (WHERE h.ts::DATE < d.day), 0) * 100.0, 2) AS before_pct
        FROM ({days}) d JOIN holed h ON h.ts::DATE BETWEEN d.day - 7 AND d.day GROUP BY d.day"""
        for i, c in enumerate(CHECKED)
    )
    return f"""null_rates AS ({per_column}),
null_rows AS (
  SELECT *, {_deviation_severity('now_pct', 'before_pct', '5.0', "column_name IN ('event_type', 'value')")} AS severity
  FROM null_rates)"""


def _duplicate_days(days: str) -> str:
    return f"""repeated AS (
  SELECT ts::DATE AS day, user_id, event_type, count(*) AS n FROM holed
  WHERE ts::DATE IN (SELECT day FROM ({days})) GROUP BY ALL HAVING count(*) > 1),
dups AS (
  SELECT day, count(*) AS duplicate_groups, sum(n)::BIGINT AS duplicate_records FROM repeated GROUP BY day)"""


ONE_DAY = f"SELECT DATE '{DAY}' AS day"
ALL_DAYS = "SELECT DISTINCT ts::DATE AS day FROM holed"
NUMBER = "CASE WHEN {0} IS NULL THEN 'None' ELSE CAST(CAST({0} AS DOUBLE) AS VARCHAR) END"


def _report_sql(days: str, with_freshness: bool, all_days: bool, tail: str) -> str:
    """The findings of every check, and ``tail`` over them."""
    change = f"round({COUNT_CHANGE}, 2)"
    moved = f"round({CHANGE}, 2)"
    at = "day" if all_days else f"DATE '{DAY}'"
    critical_where = "" if all_days else "-- over all days"
    parts = [
        f"""SELECT day, 1 AS no, 'row_count_drop' AS issue_type,
          {_drop_severity(COUNT_CHANGE, 10.0, 30.0)} AS severity,
          'Row count changed ' || {NUMBER.format(change)} || '% vs ' || CAST(day - 1 AS VARCHAR) || ' ('
          || previous || ' -> ' || current || ').' AS description
        FROM pairs WHERE day IN (SELECT day FROM ({days}))""",
        """SELECT day, 2, 'null_anomaly',
          CASE max(CASE severity WHEN 'critical' THEN 3 ELSE 2 END) WHEN 3 THEN 'critical' ELSE 'warning' END,
          count(*) || ' column(s) show abnormal null rates on ' || CAST(day AS VARCHAR) || '.'
        FROM null_rows WHERE severity <> 'ok' GROUP BY day""",
        f"""SELECT day, 3, 'duplicate_records', {GROUP_SEVERITY},
          duplicate_groups || ' duplicate key group(s) (' || duplicate_records || ' records) found on '
          || CAST(day AS VARCHAR) || '.'
        FROM dups""",
        f"""SELECT day, 5, 'metric_trend_deviation', {_pct_severity(CHANGE, 10.0, 30.0)},
          'value moved ' || {NUMBER.format(moved)} || '% vs ' || CAST(day - 1 AS VARCHAR) || '.'
        FROM moves WHERE day IN (SELECT day FROM ({days}))""",
        f"""SELECT {at}, 6, 'critical_column_nulls', CASE WHEN count(*) > 0 THEN 'critical' ELSE 'ok' END,
          least(count(*), 20) || ' sampled record(s) have NULLs in a critical column (event_type, value).'
        FROM (SELECT ts::DATE AS day FROM holed WHERE event_type IS NULL OR value IS NULL) {critical_where}
        {"GROUP BY day" if all_days else ""}""",
    ]
    if with_freshness:
        parts.append(f"""SELECT DATE '{DAY}', 4, 'freshness_issue',
          CASE WHEN hours > 9 THEN 'critical' WHEN hours > 6 THEN 'warning' ELSE 'ok' END,
          'Latest ts is ' || CAST(hours AS VARCHAR) || 'h old (threshold 6.0h).'
        FROM (SELECT round((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts)))) / 3600.0, 2) AS hours FROM holed)""")
    return f"""WITH {HOLED_EVENTS}, {_counts_daily('holed', 'ts')}, {_sums_daily('holed', 'ts', 'value')},
{_null_rates(days)}, {_duplicate_days(days)},
findings AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE severity <> 'ok'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY no)::INTEGER AS position FROM findings),
reported AS (
  SELECT d.day, count(f.no) AS n, max(CASE f.severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 0 END) AS code,
         string_agg(DISTINCT f.issue_type, ', ' ORDER BY f.issue_type) AS types
  FROM ({days}) d LEFT JOIN findings f ON f.day = d.day GROUP BY d.day)
{tail}"""


FINDINGS_TAIL = "SELECT day AS business_date, position, issue_type, severity, description FROM numbered"
SUMMARY_TAIL = """SELECT day AS business_date,
  CASE WHEN n = 0 THEN 'No data quality issues detected for events on ' || CAST(day AS VARCHAR) || '.'
       ELSE n || ' finding(s) for events on ' || CAST(day AS VARCHAR) || ' (overall severity: '
            || CASE code WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'ok' END
            || '). Issue types: ' || types || '.' END AS summary,
  CASE code WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'ok' END AS overall_severity
FROM reported"""


def _advice_tail() -> str:
    from ..plans.report import ADVICE, NO_ADVICE

    quoted = [(types, text.replace("'", "''")) for types, text in ADVICE]
    table = ", ".join(f"({i}, '{t}', '{text}')" for i, (types, text) in enumerate(quoted) for t in types)
    return f""", advice(no, issue_type, text) AS (VALUES {table}),
given AS (
  SELECT DISTINCT f.day, a.no, a.text FROM findings f JOIN advice a ON a.issue_type = f.issue_type
  UNION ALL SELECT day, 0, '{NO_ADVICE}' FROM reported WHERE n = 0)
SELECT day AS business_date, row_number() OVER (PARTITION BY day ORDER BY no)::INTEGER AS position,
       text AS recommendation FROM given"""


MOVE_COLUMNS = f"""round(previous, 2) AS {{0}}, round(current, 2) AS {{1}},
  round(current - previous, 2) AS difference, round({CHANGE}, 2) AS percentage_change"""

TWO_DAYS = f"WHERE ts::DATE IN (DATE '{DAY_BEFORE}', DATE '{DAY}')"
SUM_BEFORE = f"coalesce(sum(value) FILTER (WHERE ts::DATE = DATE '{DAY_BEFORE}'), 0)"
SUM_NOW = f"coalesce(sum(value) FILTER (WHERE ts::DATE = DATE '{DAY}'), 0)"

CAMPAIGN_FINDINGS = f"""WITH perf AS (
  SELECT 'c' || (user_id % 20) AS campaign_id, ts::DATE AS business_date, count(*) AS sends,
         count(*) FILTER (WHERE event_type = 'view') AS opens, max(ts) AS updated_at
  FROM events GROUP BY ALL),
counts AS (
  SELECT count(*) FILTER (WHERE business_date = DATE '{DAY}') AS current,
         count(*) FILTER (WHERE business_date = DATE '{DAY_BEFORE}') AS previous FROM perf),
opens AS (
  SELECT coalesce(sum(opens) FILTER (WHERE business_date = DATE '{DAY}'), 0)::DOUBLE AS current,
         coalesce(sum(opens) FILTER (WHERE business_date = DATE '{DAY_BEFORE}'), 0)::DOUBLE AS previous FROM perf),
age AS (SELECT round((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(updated_at)))) / 3600.0, 2) AS hours FROM perf),
findings AS (
  SELECT 1 AS no, 'row_count_drop' AS issue_type, {_drop_severity(COUNT_CHANGE, 15.0, 40.0)} AS severity,
         'Row count changed ' || {NUMBER.format(f"round({COUNT_CHANGE}, 2)")} || '% vs {DAY_BEFORE} ('
           || previous || ' -> ' || current || ').' AS description FROM counts
  UNION ALL
  SELECT 4, 'freshness_issue',
         CASE WHEN hours > 18 THEN 'critical' WHEN hours > 12 THEN 'warning' ELSE 'ok' END,
         'Latest updated_at is ' || CAST(hours AS VARCHAR) || 'h old (threshold 12.0h).' FROM age
  UNION ALL
  SELECT 5, 'metric_trend_deviation', {_pct_severity(CHANGE, 10.0, 30.0)},
         'opens moved ' || {NUMBER.format(f"round({CHANGE}, 2)")} || '% vs {DAY_BEFORE}.' FROM opens)
SELECT DATE '{DAY}' AS business_date, row_number() OVER (ORDER BY no)::INTEGER AS position, issue_type, severity,
       description FROM findings WHERE severity <> 'ok'"""

WORST = """CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'warning') THEN 'warning'
  WHEN bool_or(severity = 'info') THEN 'info' ELSE 'ok' END"""

ORACLES = {
    "campaign_findings": CAMPAIGN_FINDINGS,
    "severity_pct": f"""WITH {_sums_daily('orders', 'o_orderdate', 'o_totalprice')},
moved AS (SELECT day, {MOVE_COLUMNS.format('p', 'c')} FROM moves),
changed AS (SELECT day, CASE WHEN p <> 0 THEN (c - p) / nullif(p, 0) * 100 END AS change FROM moved)
SELECT day AS current_day, {_pct_severity('change', 20.0, 50.0)} AS change_severity,
       {_drop_severity('change', 20.0, 50.0)} AS drop_severity FROM changed""",
    "severity_deviation": f"""WITH {HOLED_EVENTS},
daily AS (
  SELECT ts::DATE AS day, count(*) FILTER (WHERE value IS NULL) / count(*) * 100 AS v,
         count(*) FILTER (WHERE event_type IS NULL) / count(*) * 100 AS t FROM holed GROUP BY 1)
SELECT day, {_deviation_severity('v', '5.0', '8.0')} AS usual,
       {_deviation_severity('v', '5.0', '8.0', 'TRUE')} AS tightened,
       {_deviation_severity('t', 'NULL', '11.0')} AS no_history FROM daily""",
    "row_count_compare": f"""WITH c AS (
  SELECT count(*) FILTER (WHERE ts::DATE = DATE '{DAY}') AS current,
         count(*) FILTER (WHERE ts::DATE = DATE '{DAY_BEFORE}') AS previous FROM events)
SELECT DATE '{DAY}' AS current_day, DATE '{DAY_BEFORE}' AS previous_day, current AS current_count,
       previous AS previous_count, current - previous AS difference, round({COUNT_CHANGE}, 2) AS percentage_change,
       {_drop_severity(COUNT_CHANGE, 2.0, 5.0)} AS severity FROM c""",
    "row_counts_daily": f"""WITH {_counts_daily('orders', 'o_orderdate')}
SELECT day AS current_day, day - 1 AS previous_day, current AS current_count, previous AS previous_count,
       current - previous AS difference, round({COUNT_CHANGE}, 2) AS percentage_change,
       {_drop_severity(COUNT_CHANGE, 10.0, 30.0)} AS severity FROM pairs""",
    "null_anomalies": f"""WITH {HOLED_EVENTS}, {_null_rates(ONE_DAY)}
SELECT position, column_name, round(now_pct, 2) AS null_percentage, before_pct AS historical_average, severity
FROM null_rows""",
    "null_anomalies_daily": f"""WITH {HOLED_EVENTS}, {_null_rates(ALL_DAYS)}
SELECT day AS current_day, position, column_name, round(now_pct, 2) AS null_percentage,
       before_pct AS historical_average, severity FROM null_rows""",
    "null_anomaly_summary": f"""WITH {HOLED_EVENTS}, {_null_rates(ONE_DAY)}
SELECT count(*) AS columns_checked, count(*) FILTER (severity <> 'ok') AS anomaly_count, {WORST} AS overall_severity
FROM null_rows""",
    "null_anomaly_summary_daily": f"""WITH {HOLED_EVENTS}, {_null_rates(ALL_DAYS)}
SELECT day AS current_day, count(*) AS columns_checked, count(*) FILTER (severity <> 'ok') AS anomaly_count,
       {WORST} AS overall_severity
FROM null_rows GROUP BY day""",
    "duplicate_summary": f"""WITH {HOLED_EVENTS}, {_duplicate_days(ONE_DAY)},
one AS (SELECT coalesce(sum(duplicate_groups), 0)::BIGINT AS duplicate_groups,
               coalesce(sum(duplicate_records), 0)::BIGINT AS duplicate_records FROM dups)
SELECT *, {GROUP_SEVERITY} AS severity FROM one""",
    "duplicate_samples": f"""WITH {HOLED_EVENTS}, {_duplicate_days(ONE_DAY)}
SELECT user_id, event_type, n AS duplicate_count FROM repeated
ORDER BY n DESC, user_id, event_type NULLS FIRST LIMIT 20""",
    "duplicates_daily": f"""WITH {HOLED_EVENTS}, {_duplicate_days(ALL_DAYS)}
SELECT day AS current_day, duplicate_groups, duplicate_records, {GROUP_SEVERITY} AS severity FROM dups""",
    "freshness": f"""WITH f AS (
  SELECT max(ts) AS newest, round((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts)))) / 3600.0, 2) AS hours
  FROM events)
SELECT CAST(newest AS VARCHAR) AS max_timestamp, hours AS delay_hours, 6.0::DOUBLE AS threshold_hours,
       CASE WHEN hours IS NULL OR hours > 9 THEN 'critical' WHEN hours > 6 THEN 'warning' ELSE 'ok' END AS severity
FROM f""",
    "metric_totals": f"""WITH {HOLED_EVENTS},
t AS (SELECT {SUM_BEFORE} AS previous, {SUM_NOW} AS current FROM holed)
SELECT {MOVE_COLUMNS.format('previous_total', 'current_total')}, {_pct_severity(CHANGE, 10.0, 30.0)} AS severity
FROM t""",
    "metric_totals_daily": f"""WITH {HOLED_EVENTS}, {_sums_daily('holed', 'ts', 'value')}
SELECT day AS current_day, day - 1 AS previous_day, {MOVE_COLUMNS.format('previous_total', 'current_total')},
       {_pct_severity(CHANGE, 10.0, 30.0)} AS severity FROM moves""",
    "metric_contributors": f"""WITH {HOLED_EVENTS},
g AS (SELECT user_id, {SUM_BEFORE} AS previous, {SUM_NOW} AS current FROM holed {TWO_DAYS} GROUP BY 1)
SELECT user_id AS group_value, {MOVE_COLUMNS.format('previous_value', 'current_value')} FROM g
ORDER BY round(abs(current - previous), 6) DESC, user_id LIMIT 10""",
    "metric_contributors_daily": f"""WITH {HOLED_EVENTS},
summed AS (SELECT ts::DATE AS day, user_id, coalesce(sum(value), 0) AS n FROM holed GROUP BY ALL),
both_days AS (
  SELECT day, user_id, n AS current, 0 AS previous FROM summed
  UNION ALL SELECT day + 1, user_id, 0, n FROM summed),
g AS (SELECT day, user_id, sum(current) AS current, sum(previous) AS previous FROM both_days
      WHERE day <= (SELECT max(day) FROM summed) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(abs(current - previous), 6) DESC, user_id) AS r FROM g)
SELECT day AS current_day, r::INTEGER AS rank, user_id AS group_value,
       {MOVE_COLUMNS.format('previous_value', 'current_value')} FROM ranked WHERE r <= 10""",
    "failed_records": f"WITH {HOLED_EVENTS} SELECT * FROM holed WHERE {FAILED} ORDER BY event_id LIMIT 100",
    "failed_count": f"""WITH {HOLED_EVENTS}
SELECT count(*) FILTER (WHERE {FAILED}) AS failed_count, count(*) AS total_count FROM holed""",
    "critical_nulls": f"""WITH {HOLED_EVENTS}
SELECT count(*) FILTER (WHERE event_type IS NULL OR value IS NULL) AS failed_count, count(*) AS total_count
FROM holed""",
    "sample_data": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 500",
    "dq_findings": _report_sql(ONE_DAY, True, False, FINDINGS_TAIL),
    "dq_summary": _report_sql(ONE_DAY, True, False, SUMMARY_TAIL),
    "dq_recommendations": _report_sql(ONE_DAY, True, False, _advice_tail()),
    "dq_findings_daily": _report_sql(ALL_DAYS, False, True, FINDINGS_TAIL),
    "dq_summary_daily": _report_sql(ALL_DAYS, False, True, SUMMARY_TAIL),
    "dq_recommendations_daily": _report_sql(ALL_DAYS, False, True, _advice_tail()),
}
