"""The data-quality report: every check of a table in one plan.

Each source of facts is an aggregate of one row (or, for the daily report, one
row per day). The rows are stacked and folded into one, and findings, summary
and advice are expressions over it. So a report is one Spark job that returns
one row per reported day, whatever the size of the table:

* one scan of the last ``lookback_days + 1`` days for row counts, null rates
  and metric sums together,
* one scan of the day grouped by business key for duplicates,
* one scan of two days grouped for the metric's contributors,
* one scan of the freshness and critical columns of all days, and one that
  stops early for a sample of the rows with critical nulls.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.calendar import business_day, days_before, in_days, on_day
from ..operators.delivery import TIMES
from ..operators import duplicates, failed, freshness, metrics, nulls, row_counts
from .rules import TableRules

EVIDENCE_SAMPLES, FAILED_SAMPLES = 5, 20

# What to do next, by issue types. The types and their order are fixed values; the sentences are this library's own.
ADVICE = (
    (
        ("row_count_drop",),
        "Rows are missing: see whether every load of the day ran to its end, and whether part of the day's data is still to come.",
    ),
    (
        ("null_anomaly", "critical_column_nulls"),
        "Values are missing: take the rows of failed_records and follow the empty columns back to the step that should fill them.",
    ),
    (
        ("duplicate_records",),
        "Keys repeat: compare the rows of duplicate_samples; a load that was started twice is the usual reason.",
    ),
    (
        ("freshness_issue",),
        "The newest record is old: see when the table's load last ran, and whether it still waits or failed.",
    ),
    (
        ("metric_trend_deviation",),
        "The metric moved: metric_contributors names the groups behind it; read their rows with failed_records.",
    ),
)
NO_ADVICE = "Every check is within its limits."

FINDING = "struct<issue_type:string,severity:string,severity_code:int,description:string,evidence:string>"


def dq_report(
    df: DataFrame,
    rules: TableRules,
    day: dt.date | str,
    table: str = "table",
    as_of: dt.datetime | str | None = None,
    with_samples: bool = True,
) -> DataFrame:
    """One row: business_date, summary, overall_severity, findings, recommendations.

    A check that cannot be set up (a column is missing or of a type that it
    cannot use) becomes a warning finding and leaves the others standing, as
    does a newest record whose text is no timestamp. Without
    ``with_samples`` the evidence holds no rows, which saves reading every
    column of the row groups that have critical nulls.
    """
    day, before = days_before(day, 0), days_before(day, 1)
    first = days_before(day, rules.lookback_days)
    checks = _Checks(df)
    recent: list[Column] = []  # aggregates of the scan over the days looked back on
    overall: list[Column] = []  # aggregates of the scan over all days
    rows: list[DataFrame] = []  # further one-row sources of facts

    with checks("row_count_check_error"):
        checks.need(rules.date_column)
        today, yesterday = on_day(df, rules.date_column, day), on_day(df, rules.date_column, before)
        recent += checks.possible(row_counts.count_aggregates(today, yesterday))
        checks.add(_row_count_finding(rules))

    with checks("null_check_error"):
        checks.need(rules.date_column)
        columns = _checked_columns(df, rules)
        history = in_days(df, rules.date_column, days_before(day, rules.lookback_days), before)
        recent += checks.possible(nulls.null_aggregates(columns, on_day(df, rules.date_column, day), history))
        checks.add(_null_finding(rules, columns))

    with checks("duplicate_check_error"):
        checks.need(rules.date_column, *rules.duplicate_keys)
        groups = duplicates.duplicate_groups(df, rules.duplicate_keys, rules.date_column, day)
        rows.append(groups.agg(*duplicates.duplicate_aggregates()))
        if with_samples:
            sample = groups.orderBy(F.desc("duplicate_count"), *[f"`{k}`" for k in rules.duplicate_keys])
            rows.append(_as_json(sample.limit(EVIDENCE_SAMPLES), "duplicate_sample"))
        checks.add(_duplicate_finding())

    with checks("freshness_check_error"):
        checks.need(rules.freshness_column)
        overall += checks.possible([F.max(F.col(f"`{rules.freshness_column}`")).alias("newest")])
        checks.add(_freshness_finding(rules, as_of))

    if rules.metric_column and rules.group_by_column:
        with checks("metric_check_error"):
            checks.need(rules.date_column, rules.metric_column, rules.group_by_column)
            metrics.require_numeric(df, rules.metric_column)
            today, yesterday = on_day(df, rules.date_column, day), on_day(df, rules.date_column, before)
            recent += checks.possible(metrics.metric_aggregates(df, rules.metric_column, yesterday, today))
            top = metrics.metric_contributors(
                df, rules.metric_column, rules.group_by_column, rules.date_column, before, day, EVIDENCE_SAMPLES
            )
            rows.append(_as_json(top, "contributors"))
            checks.add(_metric_finding(rules))

    if rules.critical_columns:
        with checks("failed_records_error"):
            checks.need(*rules.critical_columns)
            broken = failed.any_null(rules.critical_columns)
            overall += checks.possible([F.count_if(broken).alias("critical_nulls")])
            if with_samples:
                rows.append(_as_json(failed.failed_records(df, broken, FAILED_SAMPLES), "critical_sample"))
            checks.add(_critical_finding(rules))

    if recent:
        rows.append(df.where(in_days(df, rules.date_column, first, day)).agg(*recent))
    if overall:
        rows.append(df.agg(*overall))
    day_columns = [F.lit(day).alias("current_day"), F.lit(before).alias("previous_day")]
    stacked = [r.select(*day_columns, "*") for r in rows] or [df.sparkSession.range(1).select(*day_columns)]
    return _report(stacked, checks, table)


def dq_report_daily(df: DataFrame, rules: TableRules, table: str = "table") -> DataFrame:
    """``dq_report`` of every day that has rows or follows one that has, from three grouped passes.

    Row counts, null rates, metric sums and critical nulls are summed per day
    in one pass, and each day's sums are sent to the days that look back on
    it. Freshness is a property of the whole table and is left to ``dq_report``.
    """
    checks = _Checks(df)
    if rules.date_column not in df.columns:
        raise ValueError(f"no such column: {rules.date_column}")
    measures: list[Column] = []  # sums of one day
    recent: list[Column] = []  # what they add up to, seen from each day
    rows: list[DataFrame] = []
    now, before = F.col("lag") == 0, F.col("lag") == 1

    with checks("null_check_error"):
        columns = _checked_columns(df, rules)
        measures += nulls.daily_null_counts(columns)
        recent += nulls.daily_null_aggregates(columns)
    measures = measures or [F.count(F.lit(1)).alias("n")]
    recent += [
        row_counts.lagged_sum("n", now).alias("current_count"),
        row_counts.lagged_sum("n", before).alias("previous_count"),
    ]
    checks.add(_row_count_finding(rules))
    if len(measures) > 1:
        checks.add(_null_finding(rules, columns))

    with checks("duplicate_check_error"):
        checks.need(*rules.duplicate_keys)
        rows.append(duplicates.daily_duplicate_facts(df, rules.duplicate_keys, rules.date_column))
        checks.add(_duplicate_finding())

    if rules.metric_column and rules.group_by_column:
        with checks("metric_check_error"):
            checks.need(rules.metric_column, rules.group_by_column)
            metrics.require_numeric(df, rules.metric_column)
            top = metrics.metric_contributors_daily(
                df, rules.metric_column, rules.group_by_column, rules.date_column, EVIDENCE_SAMPLES
            )
            ordered = F.sort_array(F.collect_list(F.struct(*top.columns[1:])))  # by rank, at most a handful
            rows.append(top.groupBy("current_day").agg(_to_json(ordered).alias("contributors")))
            measures.append(metrics.daily_metric_sum(df, rules.metric_column).alias("m"))
            recent += [
                row_counts.lagged_sum("m", before).alias("previous_total"),
                row_counts.lagged_sum("m", now).alias("current_total"),
            ]
            checks.add(_metric_finding(rules))

    if rules.critical_columns:
        with checks("failed_records_error"):
            checks.need(*rules.critical_columns)
            measures.append(F.count_if(failed.any_null(rules.critical_columns)).alias("broken"))
            recent.append(row_counts.lagged_sum("broken", now).alias("critical_nulls"))
            checks.add(_critical_finding(rules))

    daily = df.groupBy(business_day(df, rules.date_column).alias("day")).agg(*measures)
    sent = row_counts.look_back(daily.where("day is not null"), rules.lookback_days)
    facts = sent.groupBy("current_day").agg(*recent).where("current_count + previous_count > 0")
    stacked = [r.withColumn("previous_day", F.date_sub("current_day", 1)) for r in (facts, *rows)]
    return _report(stacked, checks, table)


def dq_findings(report: DataFrame) -> DataFrame:
    """One row per finding of a report, in the order of the checks."""
    found = _numbered(report, "findings", "finding")
    return found.select(
        "business_date",
        "position",
        *[f"finding.{name}" for name in ("issue_type", "severity", "description", "evidence")],
    )


def dq_recommendations(report: DataFrame) -> DataFrame:
    """One row per piece of advice of a report, in order."""
    return _numbered(report, "recommendations", "recommendation")


def _numbered(report: DataFrame, array: str, element: str) -> DataFrame:
    # The outer form: from the plain one Spark infers a filter on the array's size, pushes it
    # through every step of the report, and so works the whole report out twice.
    each = report.select("business_date", F.posexplode_outer(array).alias("at", element)).where("at is not null")
    return each.select("business_date", (F.col("at") + 1).alias("position"), element)


class _Check:
    """A finding worded over the facts in two steps: shared values first, then code, description and evidence."""

    def __init__(self, issue_type: str, values: dict[str, Column], code: Column, description: Column, evidence: Column):
        self.issue_type, self.values = issue_type, values
        self.code, self.description, self.evidence = code, description, evidence


class _Checks:
    """The checks of a report; one that fails to set up leaves a warning instead."""

    def __init__(self, df: DataFrame) -> None:
        self.found: list[_Check] = []
        self._df = df
        self._columns = set(df.columns)
        self._error = ""

    def need(self, *columns: str) -> None:
        missing = [c for c in columns if c not in self._columns]
        if missing:
            raise ValueError(f"no such column: {', '.join(missing)}")

    def possible(self, aggregates: list[Column]) -> list[Column]:
        """The aggregates, once it is known that the table has the types they need."""
        self._df.agg(*aggregates).schema  # noqa: B018 - analysed now, so that this check alone fails
        return aggregates

    def __call__(self, error_type: str) -> _Checks:
        self._error = error_type
        return self

    def __enter__(self) -> None:
        pass

    def __exit__(self, kind, problem, trace) -> bool:
        if kind is None or not issubclass(kind, (AnalysisException, TypeError, ValueError)):
            return False
        text = str(problem).split("\n")[0]
        self.add(_Check(self._error, {}, F.lit(sev.WARNING), F.lit(text), F.lit("{}")))
        return True

    def add(self, check: _Check) -> None:
        self.found.append(check)

    def findings(self, facts: DataFrame) -> DataFrame:
        """Add ``findings``. Each step is a projection of its own, so that no value is worked out twice."""
        staged = facts.withColumns({name: c for check in self.found for name, c in check.values.items()})
        codes = {
            f"__code_{i}": F.coalesce(check.code, F.lit(sev.OK)).cast("int") for i, check in enumerate(self.found)
        }
        staged = staged.withColumns(codes) if codes else staged
        structs = [
            F.when(
                F.col(f"__code_{i}") > sev.OK,
                F.struct(
                    F.lit(check.issue_type).alias("issue_type"),
                    sev.severity_name(F.col(f"__code_{i}")).alias("severity"),
                    F.col(f"__code_{i}").alias("severity_code"),
                    check.description.alias("description"),
                    check.evidence.alias("evidence"),
                ),
            )
            for i, check in enumerate(self.found)
        ]
        found = F.array_compact(F.array(*structs)) if structs else F.array()
        return staged.withColumn("findings", found.cast(f"array<{FINDING}>"))


def _checked_columns(df: DataFrame, rules: TableRules) -> list[str]:
    columns = nulls.checked_columns(df, rules.date_column)
    if not columns:
        raise ValueError("there is no column besides the date column to check for nulls")
    return columns


def _text(*parts: str | Column) -> Column:
    """Parts joined to one string; a missing value reads None."""
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    )


def _to_json(value: Column) -> Column:
    """JSON text with nulls, and times with all their digits."""
    return F.to_json(value, {"ignoreNullFields": "false", **TIMES})


def _json(values: dict[str, Column], name: str, raw: str) -> Column:
    """A JSON object of some values and of a fact that is JSON text already."""
    fields = [_to_json(F.struct(value.alias(key))) for key, value in values.items()]
    inner = [F.concat(F.substring(f, F.lit(2), F.length(f) - 2), F.lit(", ")) for f in fields]
    return F.concat(F.lit("{"), *inner, F.lit(f'"{name}":'), F.coalesce(F.col(raw), F.lit("null")), F.lit("}"))


def _as_json(few_rows: DataFrame, name: str) -> DataFrame:
    """The rows of a frame already limited to a handful, as one JSON array."""
    return few_rows.agg(_to_json(F.collect_list(F.struct("*"))).alias(name))


def _row_count_finding(rules: TableRules) -> _Check:
    columns = row_counts.count_columns(rules.row_count_drop_warning_pct, rules.row_count_drop_critical_pct)
    counts = F.col("__counts")
    return _Check(
        "row_count_drop",
        {"__counts": F.when(F.col("current_count").isNotNull(), F.struct(*columns))},
        counts.severity_code,
        _text(
            "Row count changed ", counts.percentage_change, "% vs ", F.col("previous_day"), " (",
            counts.previous_count, " -> ", counts.current_count, ").",
        ),
        _to_json(counts),
    )


def _null_finding(rules: TableRules, columns: list[str]) -> _Check:
    rates = F.transform(nulls.null_counts(columns, rules.critical_columns), nulls.null_rates)
    grades = F.transform(rates, lambda r: nulls.null_grade(r, rules.null_anomaly_threshold_pct))
    flagged = F.col("__flagged")
    listed = F.transform(
        flagged,
        lambda s: F.struct(
            s.column_name.alias("column"),
            s.null_percentage.alias("null_percentage"),
            s.historical_average.alias("historical_average"),
            sev.severity_name(s.severity_code).alias("status"),
        ),
    )
    return _Check(
        "null_anomaly",
        {
            "__flagged": F.when(
                F.col("rows_now").isNotNull(), F.filter(grades, lambda s: s.severity_code > sev.OK)
            )
        },
        F.array_max(F.transform(flagged, lambda s: s.severity_code)),
        _text(F.size(flagged), " column(s) show abnormal null rates on ", F.col("current_day"), "."),
        _to_json(F.struct(listed.alias("flagged_columns"))),
    )


def _duplicate_finding() -> _Check:
    groups = F.col("duplicate_groups")
    return _Check(
        "duplicate_records",
        {},
        F.when(groups.isNotNull(), sev.by_group_count(groups)),
        _text(
            groups, " duplicate key group(s) (", F.col("duplicate_records"), " records) found on ",
            F.col("current_day"), ".",
        ),
        _json({}, "sample_duplicate_records", "duplicate_sample"),
    )


def _freshness_finding(rules: TableRules, as_of: dt.datetime | str | None) -> _Check:
    hours, limit = F.col("__hours"), float(rules.freshness_threshold_hours)
    unknown = F.col("newest").isNotNull() & hours.isNull()
    evidence = F.struct(
        F.col("newest").cast("string").alias("max_timestamp"),
        hours.alias("delay_hours"),
        F.lit(limit).alias("threshold_hours"),
    )
    return _Check(
        "freshness_issue",
        {"__hours": freshness.delay_hours(F.col("newest"), as_of)},
        F.when(unknown, sev.WARNING).otherwise(sev.by_delay(hours, limit)),
        F.when(unknown, _text(f"Latest {rules.freshness_column} is no timestamp: ", F.col("newest"), ".")).otherwise(
            _text(f"Latest {rules.freshness_column} is ", hours, f"h old (threshold {limit}h).")
        ),
        _to_json(evidence),
    )


def _metric_finding(rules: TableRules) -> _Check:
    totals = F.col("__totals")
    return _Check(
        "metric_trend_deviation",
        {"__totals": F.when(F.col("current_total").isNotNull(), F.struct(*metrics.total_columns()))},
        totals.severity_code,
        _text(f"{rules.metric_column} moved ", totals.percentage_change, "% vs ", F.col("previous_day"), "."),
        _json(
            {name: totals[name] for name in ("previous_total", "current_total", "difference", "percentage_change")},
            "largest_contributors",
            "contributors",
        ),
    )


def _critical_finding(rules: TableRules) -> _Check:
    found = F.coalesce(F.col("critical_nulls"), F.lit(0))
    names = ", ".join(rules.critical_columns)
    return _Check(
        "critical_column_nulls",
        {},
        F.when(found > 0, sev.CRITICAL),
        _text(
            F.least(found, F.lit(FAILED_SAMPLES)),
            f" sampled record(s) have NULLs in a critical column ({names}).",
        ),
        _json(
            {
                "condition": F.lit(" OR ".join(f"{c} IS NULL" for c in rules.critical_columns)),
                "failed_count": found,
            },
            "sample_records",
            "critical_sample",
        ),
    )


# Facts a report may lack: it can be made without row samples, and the daily one is.
OPTIONAL_FACTS = ("duplicate_sample", "critical_sample")


def _report(stacked: list[DataFrame], checks: _Checks, table: str) -> DataFrame:
    """Fold the stacked facts of each day into one row and word the report over it."""
    facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    for name in OPTIONAL_FACTS:
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast("string"))
    names = [c for c in facts.columns if c not in ("current_day", "previous_day")]
    # Every fact comes from one source row per day, so its maximum is its value.
    folded = facts.groupBy("current_day", "previous_day").agg(*[F.max(c).alias(c) for c in names])
    found = checks.findings(folded)
    issues = F.transform("findings", lambda f: f.issue_type)
    code = F.coalesce(F.array_max(F.transform("findings", lambda f: f.severity_code)), F.lit(sev.OK))
    found = found.withColumn("issue_types", F.array_sort(F.array_distinct(issues)))
    found = found.withColumn("overall_severity", sev.severity_name(code))
    found = found.withColumn("__advice", _advice(F.col("issue_types")))
    where = _text(f" for {table} on ", F.col("current_day"))
    summary = F.when(
        F.size("findings") == 0, F.concat(F.lit("No data quality issues detected"), where, F.lit("."))
    ).otherwise(
        F.concat(
            _text(F.size("findings"), " finding(s)"),
            where,
            _text(" (overall severity: ", F.col("overall_severity"), "). Issue types: "),
            F.array_join("issue_types", ", "),
            F.lit("."),
        )
    )
    return found.select(
        F.lit(table).alias("table"),
        F.col("current_day").alias("business_date"),
        summary.alias("summary"),
        "overall_severity",
        "findings",
        F.when(F.size("__advice") == 0, F.array(F.lit(NO_ADVICE))).otherwise(F.col("__advice")).alias(
            "recommendations"
        ),
    )


def _advice(issue_types: Column) -> Column:
    """The pieces of advice whose issues were found, in their fixed order."""
    given = [
        F.when(F.arrays_overlap(issue_types, F.array(*[F.lit(i) for i in types])), F.lit(text))
        for types, text in ADVICE
    ]
    return F.array_compact(F.array(*given))
