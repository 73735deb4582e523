"""Severity codes as Spark columns.

Inside a plan a severity is a small int, so that "worst" is a plain ``max``;
``severity_name`` turns it into its label at the edge of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, INFO, WARNING, CRITICAL = 0, 1, 2, 3

# Labels in ascending order of severity.
LABELS = ("ok", "info", "warning", "critical")


def severity_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in LABELS]), code.cast("int") + 1)


def worst(code: Column) -> Column:
    """Aggregate: the highest severity code, ``ok`` over no rows."""
    return F.coalesce(F.max(code), F.lit(OK))


def by_pct_change(pct: Column, warning_pct: float, critical_pct: float) -> Column:
    """Severity of a relative change; an unknown change is a warning."""
    size = F.abs(pct)
    return (
        F.when(pct.isNull(), F.lit(WARNING))
        .when(size >= critical_pct, F.lit(CRITICAL))
        .when(size >= warning_pct, F.lit(WARNING))
        .otherwise(F.lit(OK))
    )


def by_drop(pct: Column, warning_pct: float, critical_pct: float) -> Column:
    """As ``by_pct_change``, but rises never raise it."""
    return by_pct_change(F.least(pct, F.lit(0.0)), warning_pct, critical_pct)


def by_deviation(
    current_pct: Column, baseline_pct: Column, threshold_pct: float, critical_column: Column | bool = False
) -> Column:
    """Severity of a null rate against its history (no history counts as 0 %).

    Half of a column's values or more being null is always critical. Columns
    marked critical warn and alarm at half of the usual distance.
    """
    tightened = critical_column if isinstance(critical_column, Column) else F.lit(critical_column)
    distance = F.abs(current_pct - F.coalesce(baseline_pct, F.lit(0.0)))
    scale = F.when(tightened, F.lit(0.5)).otherwise(F.lit(1.0))
    return (
        F.when(current_pct >= 50.0, F.lit(CRITICAL))
        .when(distance >= scale * (2.0 * threshold_pct), F.lit(CRITICAL))
        .when(distance >= scale * threshold_pct, F.lit(WARNING))
        .otherwise(F.lit(OK))
    )


def by_group_count(groups: Column) -> Column:
    """Severity of duplicated keys: none, a few, or ten and more."""
    return F.when(groups == 0, F.lit(OK)).when(groups >= 10, F.lit(CRITICAL)).otherwise(F.lit(WARNING))


def by_delay(delay_hours: Column, threshold_hours: float) -> Column:
    """Severity of a delay; no timestamp at all is critical."""
    return (
        F.when(delay_hours.isNull() | (delay_hours > threshold_hours * 1.5), F.lit(CRITICAL))
        .when(delay_hours > threshold_hours, F.lit(WARNING))
        .otherwise(F.lit(OK))
    )


def pct_change(previous: Column, current: Column) -> Column:
    """Change in percent, null when there is no base to compare with."""
    base = previous.cast("double")
    return F.when(base != 0, (current - base) / F.nullif(base, F.lit(0.0)) * 100)
