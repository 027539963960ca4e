"""Rollups per load, every day of a range at once, and the model from sums per day."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from spendkit import jobs
from spendkit.operators import budget, forecast, recommend, rollup
from spendkit.session import cut_lineage

FIRST, LAST = "2010-03-01", "2010-03-31"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for client in (1, 2, 3):
        for d in range(75):
            day = date(2010, 1, 10) + timedelta(days=d)
            if client == 3 and d > 20 or rng.random() < 0.3:
                continue
            for _ in range(rng.randrange(1, 4)):
                at = rng.choice(["00:00", "00:01", "13:30", "23:59"])
                out.append((client, f"{day} {at}", rng.choice([5, 7.25, -3, 12.99, None]), rng.choice(["a", "b", None, "sub"]),
                            rng.choice(["Dining", "Groceries", "Shopping", "Subscriptions"])))
    return out


@pytest.fixture(scope="module")
def tx(make_tx, rows):
    return cut_lineage(make_tx(*rows))


@pytest.fixture(scope="module")
def limits(make_limits):
    return make_limits(c1=300, c2="120.50", c3=80, c4=50, c5=None, c6=0)


def every(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def days():
    day = date.fromisoformat(FIRST)
    while day <= date.fromisoformat(LAST):
        yield day
        day += timedelta(days=1)


@pytest.mark.parametrize("inclusive", [False, True])
def test_budget_of_every_day(tx, limits, inclusive):
    columns = ["client_id", "as_of_date", "month_start", budget.LIMIT, forecast.MTD, "utilization_pct"]
    got = every(rollup.budget_days(rollup.daily_partials(tx), limits, FIRST, LAST, inclusive), *columns)
    want = None
    for day in list(days())[::5]:
        one = budget.budget_utilization(tx, limits, str(day), inclusive)
        want = one if want is None else want.unionByName(one)
    wanted = every(want, *columns)
    assert len(got) == 6 * 31 and set(wanted) <= set(got) and len({r[4] for r in wanted}) > 5


def test_runway_of_every_day(tx, limits):
    daily = cut_lineage(forecast.daily_discretionary(tx, "category"))
    model = forecast.fit_month_end_model(forecast.training_samples(daily, limits), "2010-02-20")
    got = every(rollup.score_days(daily, limits, FIRST, LAST, model), *forecast.RUNWAY_COLUMNS, "status")
    want = None
    for day in list(days())[::6]:
        one = forecast.score_daily(daily, limits, str(day), model)
        want = one if want is None else want.unionByName(one)
    wanted = every(want, *forecast.RUNWAY_COLUMNS, "status")
    assert len(got) == 6 * 31 and set(wanted) <= set(got)
    assert {r[-1] for r in wanted} == {"scored", "no_limit", "no_history"}
    before = every(rollup.score_days(daily, limits, "2009-12-30", "2010-01-02", model), "client_id", "status")
    assert len(before) == 6 * 4 and {s for c, s in before if c == 1} == {"no_history"}


def test_partials_of_loads_add_up(spark, tx, limits, tmp_path):
    out = str(tmp_path)
    parts = [tx.where(F.month("transaction_dt") == 1), tx.where(F.month("transaction_dt") > 1)]
    jobs.store_partials(tx, out, "b")  # a load that is stored again is replaced
    for name, part in zip("ab", parts):
        jobs.store_partials(part, out, name)
    merged, merchants = jobs.load_partials(spark, out)
    names = [*rollup.DAY_KEYS, "spend_usd", "transactions"]
    assert every(merged, *names) == every(rollup.daily_partials(tx), *names)
    names = [*rollup.MERCHANT_KEYS, "spend_usd", "transactions", "first_dt"]
    assert every(merchants, *names) == every(rollup.merchant_partials(tx), *names)

    model = jobs.train_on_partials(spark, out, limits, "2010-02-20")
    daily = forecast.daily_discretionary(tx)
    whole = forecast.fit_month_end_model(cut_lineage(forecast.training_samples(daily, limits)), "2010-02-20")
    assert model.weight == pytest.approx(whole.weight) and model.metrics == pytest.approx(whole.metrics)

    as_of = "2010-03-15"
    log = spark.createDataFrame([(1, "x", "dismissed", 1)], "client_id long, rec_id string, status string, seq int")
    fresh = jobs.alerts_on_partials(spark, out, limits, as_of, model, log, feedback_order=["seq"])
    direct = jobs.alerts(tx, limits, as_of, model, log, feedback_order=["seq"])
    plain = recommend.recommendations(tx, as_of)
    columns = ["client_id", "rec_id", "title", "rule", "estimated_monthly_savings_usd", "rank"]
    assert every(fresh["recommendations"], *columns) == every(direct["recommendations"], *columns) == every(plain, *columns)
    assert plain.count() > 0
    for name in ("budget", "runway", "events", "coach_context"):
        columns = [c for c in direct[name].columns if c != "channels"]
        assert every(fresh[name], *columns) == every(direct[name], *columns)
    assert every(direct["budget"], forecast.MTD) == every(budget.budget_utilization(tx, limits, as_of), forecast.MTD)


def test_month_to_date_by_category(tx):
    from spendkit.operators import spend

    got = every(rollup.category_days(rollup.daily_partials(tx), "2010-02-14"), "client_id", "category", "spend_usd")
    assert got == every(spend.mtd_category_spend(tx, "2010-02-14"), "client_id", "category", "spend_usd") and got


def test_open_items_are_those_without_a_last_dismissal(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "d")], "client_id long, rec_id string")
    log = spark.createDataFrame(
        [(1, "a", "dismissed", 1), (1, "a", "accepted", 2), (1, "b", "accepted", 1), (1, "b", "dismissed", 2), (2, "x", "dismissed", 9),
         (2, "c", "dismissed", 1), (3, "d", None, 4), (3, "d", "dismissed", 3)], "client_id long, rec_id string, status string, seq int")
    got = every(recommend.open_items(items, log, ["seq"]), "client_id", "rec_id")
    latest = recommend.latest_feedback(log, ["seq"])
    assert got == every(recommend.drop_dismissed(items, latest), "client_id", "rec_id")
    assert (1, "a") in got and (1, "b") not in got and (2, "a") in got and (2, "c") not in got


def test_moments_of_days_add_up_and_give_the_weights_of_a_solver(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = random.Random(2)
    names = ("year", "x", "y", "same")
    data = [(date(2010, 1, 1) + timedelta(days=rng.randrange(60)), 2000 + rng.randrange(12), rng.uniform(0, 1e4), rng.gauss(3, 0.01), 7.5) for _ in range(800)]
    rows = [(d, y, a, b, c, 3 * a - 100 * b + 5 * y + rng.gauss(0, 50)) for d, y, a, b, c in data]
    samples = spark.createDataFrame(rows, f"day date, year int, x double, y double, same double, {forecast.TARGET} double")
    day = date(2010, 2, 1)
    halves = [forecast.day_moments(samples.where(F.col("day") < str(day)), names), forecast.day_moments(samples.where(F.col("day") >= str(day)), names)]
    for cutoff in ("2010-02-01", "2010-02-20"):
        model = forecast.ridge_of_moments(halves[0].unionByName(halves[1]), cutoff, 1.0, names)
        train = samples.where(F.col("day") <= cutoff)
        stats = train.agg(*[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names], F.stddev_pop(forecast.TARGET), F.count("*")).first()
        scale = [s if s > 1e-9 else 1.0 for s in stats[4:8]]
        scaled = train.select(F.col(forecast.TARGET).alias("label"), *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(names, stats[:4], scale)])
        fit = LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, regParam=1.0 * stats[8] / stats[9]).fit(
            VectorAssembler(inputCols=list(names), outputCol="features").transform(scaled).select("label", "features"))
        assert model.mean == pytest.approx(stats[:4]) and model.scale == pytest.approx(scale)
        assert model.weight == pytest.approx(list(fit.coefficients), rel=1e-6, abs=1e-6) and model.intercept == pytest.approx(fit.intercept)
        assert (model.metrics["n_train"], model.metrics["n_samples"]) == (stats[9], 800)
