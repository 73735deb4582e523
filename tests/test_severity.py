import pytest
from pyspark.sql import functions as F

from quernstone.functions import severity as sev


def graded(spark, column):
    return spark.range(1).select(sev.severity_name(column)).first()[0]


@pytest.mark.parametrize(
    "pct, expected",
    [(None, "warning"), (0.0, "ok"), (9.99, "ok"), (10.0, "warning"), (-10.0, "warning"), (30.0, "critical"), (-31.0, "critical")],
)
def test_pct_change(spark, pct, expected):
    assert graded(spark, sev.by_pct_change(F.lit(pct).cast("double"), 10.0, 30.0)) == expected


@pytest.mark.parametrize("pct, expected", [(500.0, "ok"), (0.0, "ok"), (-9.0, "ok"), (-10.0, "warning"), (-30.0, "critical")])
def test_only_drops_count(spark, pct, expected):
    assert graded(spark, sev.by_drop(F.lit(pct), 10.0, 30.0)) == expected


@pytest.mark.parametrize(
    "now, before, critical, expected",
    [
        (50.0, 50.0, False, "critical"),
        (4.9, None, False, "ok"),
        (5.0, None, False, "warning"),
        (10.0, None, False, "critical"),
        (0.0, 5.0, False, "warning"),
        (2.5, 0.0, True, "warning"),
        (5.0, 0.0, True, "critical"),
        (2.4, 0.0, True, "ok"),
    ],
)
def test_deviation(spark, now, before, critical, expected):
    column = sev.by_deviation(F.lit(now), F.lit(before).cast("double"), 5.0, critical)
    assert graded(spark, column) == expected


@pytest.mark.parametrize("groups, expected", [(0, "ok"), (1, "warning"), (9, "warning"), (10, "critical")])
def test_groups(spark, groups, expected):
    assert graded(spark, sev.by_group_count(F.lit(groups))) == expected


@pytest.mark.parametrize("hours, expected", [(None, "critical"), (-3.0, "ok"), (6.0, "ok"), (6.1, "warning"), (9.0, "warning"), (9.1, "critical")])
def test_delay(spark, hours, expected):
    assert graded(spark, sev.by_delay(F.lit(hours).cast("double"), 6.0)) == expected


def test_worst_of_nothing_is_ok(spark):
    assert spark.range(0).agg(sev.severity_name(sev.worst(F.col("id")))).first()[0] == "ok"
    assert spark.range(3).agg(sev.severity_name(sev.worst(F.col("id")))).first()[0] == "warning"
