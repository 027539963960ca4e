from datetime import date

import pytest
from pyspark.sql import functions as F

from spendkit.operators import notify

INPUTS = (
    "client_id long, as_of_date date, utilization_pct double, projected_utilization_pct double, mtd_spend_usd double, "
    "monthly_limit_usd double, remaining_budget_usd double, days_to_limit_estimate long, overspend_risk boolean"
)
DAY = date(2010, 2, 10)


@pytest.fixture(scope="module")
def inputs(spark):
    def make(util=None, projected=None, mtd=None, limit=None, remaining=None, days=None, risk=False):
        return spark.createDataFrame([(1, DAY, util, projected, mtd, limit, remaining, days, risk)], INPUTS)

    return make


@pytest.fixture(scope="module")
def tip(spark):
    return spark.createDataFrame([(1, 1, "Cut Dining", "Cook"), (1, 2, "Other", "x")], "client_id long, rank int, title string, action string")


def events(df, recs=None):
    return notify.notifications(df, recs).orderBy("display_rank").collect()


def test_crossed(spark):
    df = spark.createDataFrame([(0, None), (1, 0.5), (2, 0.7), (3, 0.9), (4, 0.99)], "i int, u double")
    got = [r.c for r in df.select("i", notify.crossed_thresholds(F.col("u")).alias("c")).orderBy("i").collect()]
    assert got == [[], [], [0.7], [0.7, 0.85], [0.7, 0.85, 0.95]]


def test_quiet(inputs):
    assert events(inputs(0.28, 0.30)) == []
    assert events(inputs()) == []


def test_one_threshold_and_a_tip(inputs, tip):
    rows = events(inputs(0.72, 0.80, 72.0, 100.0, 28.0), tip)
    assert [(r.kind, r.threshold_pct, r.severity) for r in rows] == [("budget_threshold", 0.7, "info"), ("tip", None, "info")]
    assert rows[0].channels == ["app", "email"]
    assert rows[0].message == (
        "You have passed the 70% discretionary budget threshold. As of 2010-02-10, month-to-date spend is $72.00 of "
        "$100.00 (72% utilization). Remaining budget: $28.00."
    )
    assert rows[0].title == "Past 70% budget threshold" and rows[1].message == "Cut Dining — Cook"


def test_critical_comes_first(inputs):
    rows = events(inputs(0.96, 1.10, risk=True))
    assert [r.threshold_pct for r in rows if r.kind == "budget_threshold"] == [0.95, 0.85, 0.7]
    assert rows[0].severity == "critical"
    assert [(r.kind, r.severity) for r in rows] == [
        ("budget_threshold", "critical"), ("warning", "critical"), ("budget_threshold", "warning"), ("budget_threshold", "info"),
    ]


def test_projected_only(inputs):
    rows = events(inputs(0.50, 0.86, 50.0, 100.0))
    assert [r.title for r in rows] == ["Projected to pass 85% budget threshold", "Projected to pass 70% budget threshold"]
    assert rows[0].message == (
        "Projected month-end utilization (86%) is at or above the 85% threshold. "
        "MTD spend is currently $50.00 of $100.00 (50% utilization)."
    )


def test_runway(inputs):
    rows = [r for r in events(inputs(0.55, 0.60, days=3, remaining=45.0)) if r.kind == "warning"]
    assert [r.title for r in rows] == ["Only 3 day(s) of discretionary runway left"]
    assert events(inputs(0.55, 0.60, days=8)) == [] and events(inputs(0.55, 0.60, days=-1)) == []
    both = [r.title for r in events(inputs(0.1, 1.0, days=3)) if r.kind == "warning"]
    assert both == ["Projected to exceed your discretionary limit"]


def test_inputs_fall_through_zero(spark):
    limit = "monthly_discretionary_limit_usd"
    budget = spark.createDataFrame([(1, DAY, 0.71, 0.0, None)], f"client_id long, as_of_date date, utilization_pct double, mtd_discretionary_spend_usd double, {limit} double")
    runway = spark.createDataFrame(
        [(1, date(2010, 2, 11), 360.0, 1000.0, 0.9, 640.0, 12, None), (2, date(2010, 2, 11), 1.0, 2.0, 0.5, 1.0, None, True)],
        f"client_id long, as_of_date date, mtd_discretionary_spend_usd double, {limit} double, projected_utilization_pct double, "
        "remaining_budget_usd double, days_to_limit_estimate long, overspend_risk boolean",
    )
    rows = {r.client_id: r for r in notify.notification_inputs(budget, runway).collect()}
    assert (rows[1].as_of_date, rows[1].mtd_spend_usd, rows[1].monthly_limit_usd, rows[1].overspend_risk) == (DAY, 360.0, 1000.0, False)
    assert (rows[2].as_of_date, rows[2].utilization_pct, rows[2].overspend_risk) == (date(2010, 2, 11), None, True)
    given = notify.notification_inputs(budget, runway, as_of="2010-03-01").collect()
    assert {r.as_of_date for r in given} == {date(2010, 3, 1)}
    some = spark.createDataFrame([(1, date(2010, 3, 2))], "client_id long, as_of date")
    assert {r.client_id: r.as_of_date for r in notify.notification_inputs(budget, runway, some).collect()} == {1: date(2010, 3, 2), 2: date(2010, 2, 11)}


def test_channels(inputs):
    rows = notify.channel_events(notify.notifications(inputs(0.72))).collect()
    assert sorted(r.channel for r in rows) == ["app", "email"]


def test_status(inputs):
    rows = notify.threshold_status(inputs(0.75, 0.9)).collect()
    assert [(r.label, r.status, r.mtd_hit, r.projected_hit) for r in rows] == [
        ("70%", "crossed", True, True), ("85%", "projected", False, True), ("95%", "ok", False, False),
    ]


def test_order_of_ties(inputs, tip):
    rows = events(inputs(0.72, 0.8), tip)
    assert [r.display_rank for r in rows] == [1, 2]
