import math
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendkit.constants import FEATURES, TARGET
from spendkit.operators import forecast

LIMIT = "monthly_discretionary_limit_usd"


@pytest.fixture(scope="module")
def daily(spark):
    """Two clients, 51 days, every 13th day of the second one negative."""
    rows = []
    for i in range(51):
        day = date(2010, 1, 1) + timedelta(days=i)
        rows.append((1, day, Decimal(2 + i % 5)))
        rows.append((2, day, Decimal(-10) if i % 13 == 0 else Decimal(5 + i % 7)))
    return spark.createDataFrame(rows, "client_id long, day date, discretionary_spend_usd decimal(18,2)")


@pytest.fixture(scope="module")
def samples(daily, make_limits):
    return forecast.training_samples(daily, make_limits(c1=120, c2=240)).cache()


def test_samples_against_pandas(daily, samples):
    want = daily.toPandas()
    want["spend"] = want["discretionary_spend_usd"].astype(float).clip(lower=0)
    want["ym"] = pd.to_datetime(want["day"]).dt.strftime("%Y-%m")
    want = want.sort_values(["client_id", "day"])
    by = want.groupby(["client_id", "ym"])["spend"]
    want["total"], want["mtd"] = by.transform("sum"), by.cumsum()
    for n in (7, 30):
        want[f"a{n}"] = by.rolling(n, min_periods=1).mean().reset_index(level=[0, 1], drop=True)
    got = samples.orderBy("client_id", "day").toPandas()
    assert list(got.columns) == ["client_id", "day", "ym", TARGET, *FEATURES]
    for ours, theirs in ((TARGET, "total"), ("mtd_discretionary_spend_usd", "mtd"),
                         ("avg_daily_discretionary_spend_7d", "a7"), ("avg_daily_discretionary_spend_30d", "a30")):
        assert np.allclose(got[ours].astype(float), want[theirs])
    assert (got[TARGET].astype(float) >= 0).all()
    assert (got["days_remaining_in_month"] == got["days_in_month"] - got["day_of_month"]).all()


def closed_form(frame, cutoff):
    train = frame[frame["day"] <= cutoff]
    x, y = train[list(FEATURES)].astype(float).to_numpy(), train[TARGET].astype(float).to_numpy()
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
    every = (frame[list(FEATURES)].astype(float).to_numpy() - mean) / scale @ w + y.mean()
    return w, y.mean(), every


def test_ridge_against_closed_form(samples):
    cutoff = date(2010, 1, 25)
    model = forecast.fit_month_end_model(samples, cutoff)
    frame = samples.orderBy("client_id", "day").toPandas()
    w, intercept, want = closed_form(frame, cutoff)
    assert np.allclose(model.weight, w, atol=1e-6) and math.isclose(model.intercept, intercept, rel_tol=1e-9)
    got = forecast.predict_month_end(samples, model).orderBy("client_id", "day").toPandas()
    predicted = got["predicted_month_end_discretionary_spend_usd"].to_numpy()
    assert np.allclose(predicted, want, atol=1e-6)
    y, is_train = frame[TARGET].astype(float).to_numpy(), (frame["day"] <= cutoff).to_numpy()
    assert model.metrics["n_samples"] == 102 and model.metrics["n_train"] == 50 and model.metrics["n_test"] == 52
    assert math.isclose(model.metrics["mae_train_usd"], np.abs(y - want)[is_train].mean(), rel_tol=1e-6)
    assert math.isclose(model.metrics["mae_test_usd"], np.abs(y - want)[~is_train].mean(), rel_tol=1e-6)
    assert model.metrics["cutoff_day"] == "2010-01-25"


def test_split_quantile(samples):
    row = forecast.time_split(samples).first()
    days = pd.Series(pd.to_datetime(samples.toPandas()["day"]))
    cut = days.quantile(0.8)
    assert math.isclose(row.cutoff, (cut - pd.Timestamp("1970-01-01")) / pd.Timedelta(days=1))
    assert row.n_train == int((days <= cut).sum()) and row.n_train + row.n_test == row.n_samples == 102


def test_split_needs_rows_on_both_sides(samples):
    with pytest.raises(ValueError):
        forecast.fit_month_end_model(samples, date(2010, 1, 2))
    with pytest.raises(ValueError):
        forecast.fit_month_end_model(samples.where("client_id = 99"))


def test_model_round_trip(spark, samples):
    model = forecast.fit_month_end_model(samples, date(2010, 1, 25))
    again = forecast.MonthEndModel.from_frame(model.to_frame(spark), model.metrics)
    assert again == model
    with pytest.raises(ValueError):
        forecast.MonthEndModel.from_frame(model.to_frame(spark).where("position > 0"))


def test_limits_that_cannot_be_used(daily, make_limits):
    assert forecast.training_samples(daily, make_limits(c1=0, c2=None)).count() == 0


def test_latest_row_as_of(samples):
    def at(day):
        return {r.client_id: r.day for r in forecast.feature_row_as_of(samples, day).collect()}

    assert at("2010-02-10") == {1: date(2010, 2, 10), 2: date(2010, 2, 10)}
    assert at("2010-05-01") == {1: date(2010, 2, 20), 2: date(2010, 2, 20)}
    assert at("2009-12-31") == {}


def signals(spark, predicted, mtd, limit, day=date(2010, 2, 10)):
    df = spark.createDataFrame(
        [(predicted, mtd, limit, day, 28)],
        f"predicted_month_end_discretionary_spend_usd double, mtd_discretionary_spend_usd double, {LIMIT} double, as_of date, days_in_month int",
    )
    return forecast.overspend_signals(df).first()


def test_signals(spark):
    row = signals(spark, 999.0, 300.0, 200.0)
    assert row.days_to_limit_estimate == 0 and row.overspend_risk and row.remaining_budget_usd == -100.0
    row = signals(spark, 100.0, 100.0, 200.0)
    assert row.days_to_limit_estimate is None and not row.overspend_risk
    row = signals(spark, 280.0, 100.0, 200.0)
    assert row.days_to_limit_estimate == 10 and row.projected_utilization_pct == 1.4
    row = signals(spark, 300.0, 100.0, 200.0, date(2010, 2, 28))
    assert row.days_to_limit_estimate == 1


def test_scoring_takes_the_whole_day(make_tx, make_limits, samples):
    model = forecast.fit_month_end_model(samples, date(2010, 1, 25))
    tx = make_tx(
        (1, "2010-02-10 23:59", 5, "m", "Dining"), (1, "2010-02-11 00:00", 7, "m", "Dining"),
        (2, "2010-02-01 10:00", 5, "m", "Groceries"), (3, "2010-02-01 10:00", 5, "m", "Dining"),
    )
    out = forecast.score_clients(tx, make_limits(c1=100, c2=100, c3=None, c4=0), "2010-02-10", model)
    rows = {r.client_id: r for r in out.collect()}
    assert float(rows[1].mtd_discretionary_spend_usd) == 5.0 and rows[1].status == "scored"
    assert (rows[2].status, rows[3].status, rows[4].status) == ("no_history", "no_limit", "no_limit")


def test_scoring_with_a_date_per_client(spark, make_tx, make_limits, samples):
    model = forecast.fit_month_end_model(samples, date(2010, 1, 25))
    tx = make_tx((1, "2010-02-10 23:59", 5, "m", "Dining"), (1, "2010-02-12 00:00", 7, "m", "Dining"), (2, "2010-03-01 00:00", 9, "m", "Dining"))
    as_of = spark.createDataFrame([(1, date(2010, 2, 11)), (2, date(2010, 3, 2))], "client_id long, as_of date")
    rows = {r.client_id: float(r.mtd_discretionary_spend_usd) for r in forecast.score_clients(tx, make_limits(c1=100, c2=100), as_of, model).collect()}
    assert rows == {1: 5.0, 2: 9.0}


def test_labels_can_decide_what_counts(make_tx):
    tx = make_tx((1, "2010-02-10 10:00", 5, "m", "Dining"), (1, "2010-02-10 10:00", 7, "m", "Groceries"))
    relabelled = tx.withColumn("category", F.lit("Travel"))
    assert float(forecast.daily_discretionary(relabelled, "category").first().discretionary_spend_usd) == 12.0
    assert float(forecast.daily_discretionary(relabelled).first().discretionary_spend_usd) == 5.0


def test_compare_fills_zero(spark):
    df = spark.createDataFrame([(1, 5.0, None, 9.0)], f"client_id long, mtd_discretionary_spend_usd double, predicted_month_end_discretionary_spend_usd double, {LIMIT} double")
    got = {r.label: r.spend_usd for r in forecast.forecast_compare(df).collect()}
    assert got == {"MTD actual": 5.0, "Projected month-end": 0.0, "Monthly limit": 9.0}
