"""Queries over spend analytics, budget and forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FEATURES, RIDGE_ALPHA, TARGET
from ..operators import budget, forecast, labeling, rollup, spend
from ..session import cut_lineage, stored
from ..sources import bucketed
from .registry import big, dbl, query
from .views import AS_OF, EVENTS_AS_OF, STORED_VIEWS, VIEW_SQL, Views, with_views


@query("spend_by_category", "SELECT client_id, category, CAST(sum(spend) AS DOUBLE) AS spend_usd FROM ctx GROUP BY 1, 2")
def spend_by_category(v: Views):
    return spend.spend_by_category(v.categorised()).select("client_id", "category", dbl("spend_usd"))


@query("spend_by_mcc", """
    SELECT client_id, mcc_code, mcc_description, CAST(sum(spend) AS DOUBLE) AS spend_usd FROM ctx GROUP BY 1, 2, 3""")
def spend_by_mcc(v: Views):
    return spend.spend_by_mcc(v.tx(place=False)).select("client_id", "mcc_code", "mcc_description", dbl("spend_usd"))


@query("top_mcc", """
    SELECT client_id, mcc_code, mcc_description, CAST(sum(spend) AS DOUBLE) AS spend_usd,
           row_number() OVER (PARTITION BY client_id ORDER BY sum(spend) DESC, mcc_code) AS rank
    FROM ctx GROUP BY 1, 2, 3 QUALIFY rank <= 50""")
def top_mcc(v: Views):
    return spend.top_mcc(v.tx(place=False)).select("client_id", "mcc_code", "mcc_description", dbl("spend_usd"), big("rank"))


@query("spend_by_month", """
    SELECT client_id, strftime(transaction_dt, '%Y-%m') AS month, CAST(sum(spend) AS DOUBLE) AS spend_usd FROM ctx GROUP BY 1, 2""")
def spend_by_month(v: Views):
    return spend.spend_by_month(v.tx(place=False)).select("client_id", "month", dbl("spend_usd"))


@query("avg_daily_spend_by_dow", """
    SELECT client_id, dayname(day) AS dow, round(CAST(sum(s) AS DOUBLE) / count(*), 6) AS avg_daily_spend_usd
    FROM (SELECT client_id, CAST(transaction_dt AS DATE) AS day, sum(spend) AS s FROM etx GROUP BY 1, 2) GROUP BY 1, 2""")
def avg_daily_spend_by_dow(v: Views):
    return spend.avg_daily_spend_by_dow(v.etx()).select("client_id", "dow", dbl("avg_daily_spend_usd", digits=6))


@query("spend_by_dow_total", """
    SELECT client_id, dayname(transaction_dt) AS dow, CAST(sum(spend) AS DOUBLE) AS spend_usd FROM ctx GROUP BY 1, 2""")
def spend_by_dow_total(v: Views):
    return spend.spend_by_dow_total(v.tx(place=False)).select("client_id", "dow", dbl("spend_usd"))


@query("top_merchants", """
    SELECT client_id, merchant_id, merchant_city, merchant_state, CAST(s AS DOUBLE) AS spend_usd, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY s DESC, merchant_id NULLS FIRST,
               merchant_city NULLS FIRST, merchant_state NULLS FIRST) AS rank
      FROM (SELECT client_id, merchant_id, merchant_city, merchant_state, sum(spend) AS s FROM ctx GROUP BY 1, 2, 3, 4))
    WHERE rank <= 25""")
def top_merchants(v: Views):
    return spend.top_merchants(v.tx()).select(
        "client_id", "merchant_id", "merchant_city", "merchant_state", dbl("spend_usd"), big("rank"))


@query("total_spend", "SELECT client_id, CAST(sum(spend) AS DOUBLE) AS total_spend_usd FROM ctx GROUP BY 1")
def total_spend(v: Views):
    return spend.total_spend(v.tx(place=False)).select("client_id", dbl("total_spend_usd"))


def _budget(v: Views, as_of: str = AS_OF):
    return budget.budget_utilization(v.categorised(), v.limits(), as_of)


@query("budget_utilization", """
    SELECT client_id, as_of_date, month_start, CAST(monthly_limit AS DOUBLE) AS monthly_discretionary_limit_usd,
           CAST(mtd AS DOUBLE) AS mtd_discretionary_spend_usd, round(util, 6) AS utilization_pct FROM budget""")
def budget_utilization(v: Views):
    return _budget(v).select(
        "client_id", "as_of_date", "month_start", dbl("monthly_discretionary_limit_usd"),
        dbl("mtd_discretionary_spend_usd"), dbl("utilization_pct", digits=6))


@query("budget_at_last_date", """
    SELECT r.client_id, r.as_of AS as_of_date, CAST(coalesce(sum(e.spend) FILTER (e.is_discretionary
             AND e.transaction_dt >= date_trunc('month', r.as_of) AND e.transaction_dt <= CAST(r.as_of AS TIMESTAMP)), 0) AS DOUBLE) AS mtd_discretionary_spend_usd
    FROM (SELECT client_id, CAST(max(transaction_dt) AS DATE) AS as_of FROM etx GROUP BY 1) r
    JOIN etx e ON r.client_id = e.client_id GROUP BY 1, 2""")
def budget_at_last_date(v: Views):
    tx = labeling.with_rule_category(v.etx())
    out = budget.budget_utilization(tx, v.event_limits(), spend.default_as_of(v.etx()))
    return out.select("client_id", "as_of_date", dbl("mtd_discretionary_spend_usd"))


@query("category_source_mix", "SELECT client_id, category_source, count(*) AS transactions FROM otx GROUP BY 1, 2")
def category_source_mix(v: Views):
    return spend.category_source_mix(_overlaid(v)).select("client_id", "category_source", "transactions")


def _overlaid(v: Views):
    return labeling.overlay_labels(v.tx(place=False), labeling.latest_labels(v.labels(), ["seq"]))


@query("category_source_share", """
    SELECT client_id, category_source, count(*) AS transactions,
           round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY client_id), 6) AS share FROM otx GROUP BY 1, 2""")
def category_source_share(v: Views):
    return spend.category_source_share(_overlaid(v)).select("client_id", "category_source", "transactions", dbl("share", digits=6))


@query("client_date_range", "SELECT client_id, min(transaction_dt) AS min_dt, max(transaction_dt) AS max_dt FROM etx GROUP BY 1")
def client_date_range(v: Views):
    return spend.client_date_range(v.etx())


@query("baseline_limits", """
    SELECT t.client_id, CAST(max(l.monthly_limit) AS DOUBLE) AS monthly_discretionary_limit_usd
    FROM tx t LEFT JOIN limits l ON t.client_id = l.client_id GROUP BY 1""")
def baseline_limits(v: Views):
    rows = v.tx(place=False).join(v.limits(), "client_id", "left")
    return budget.baseline_limits(rows).select("client_id", dbl("monthly_discretionary_limit_usd"))


@query("effective_limit", """
    SELECT l.client_id, CAST(coalesce(o.lim, l.monthly_limit) AS DOUBLE) AS monthly_discretionary_limit_usd,
           o.lim IS NOT NULL AS is_override
    FROM limits l LEFT JOIN (
      SELECT c_custkey // 30 AS client_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(abs(c_acctbal) * 50 AS DECIMAL(18,2)) END AS lim
      FROM customer WHERE c_mktsegment <> 'MACHINERY'
      QUALIFY row_number() OVER (PARTITION BY c_custkey // 30 ORDER BY c_custkey DESC) = 1) o ON l.client_id = o.client_id""")
def effective_limit(v: Views):
    overrides = budget.latest_limit_overrides(v.limit_changes(), ["seq"])
    return budget.effective_limits(v.limits(), overrides).select(
        "client_id", dbl("monthly_discretionary_limit_usd"), "is_override")


_BY_CATEGORY = "(SELECT client_id, category, sum(spend) AS s FROM ctx GROUP BY 1, 2)"


@query("category_share", f"""
    SELECT client_id, is_other, category, CAST(sum(s) AS DOUBLE) AS spend_usd,
           round(100 * CAST(sum(s) AS DOUBLE) / any_value(total), 6) AS share_pct
    FROM (SELECT client_id, rn > 5 AS is_other, CASE WHEN rn > 5 THEN 'Other' ELSE category END AS category, s, total
          FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY s DESC, category) AS rn,
                       CAST(sum(s) OVER (PARTITION BY client_id) AS DOUBLE) AS total FROM {_BY_CATEGORY}))
    GROUP BY 1, 2, 3""")
def category_share(v: Views):
    return spend.category_share(spend.spend_by_category(v.categorised())).select(
        "client_id", "is_other", "category", dbl("spend_usd"), dbl("share_pct", digits=6))


@query("category_breakdown", f"""
    SELECT client_id, category, CAST(s AS DOUBLE) AS spend_usd,
           round(100 * CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY client_id) AS DOUBLE), 6) AS share_pct
    FROM {_BY_CATEGORY}""")
def category_breakdown(v: Views):
    return spend.category_breakdown(spend.spend_by_category(v.categorised())).select(
        "client_id", "category", dbl("spend_usd"), dbl("share_pct", digits=6))


_MTD_EVENTS = """(SELECT client_id, category, sum(spend) AS s FROM etx WHERE transaction_dt >= TIMESTAMP '2024-01-01'
                    AND transaction_dt <= TIMESTAMP '2024-01-20' GROUP BY 1, 2 HAVING sum(spend) > 0)"""


@query("mtd_category_spend", f"SELECT client_id, category, CAST(s AS DOUBLE) AS spend_usd FROM {_MTD_EVENTS}")
def mtd_category_spend(v: Views):
    tx = labeling.with_rule_category(v.etx())
    return spend.mtd_category_spend(tx, EVENTS_AS_OF).select("client_id", "category", dbl("spend_usd"))


@query("mtd_or_lifetime_spend", """
    SELECT client_id, category, has_mtd AS is_mtd, CAST(CASE WHEN has_mtd THEN m ELSE s END AS DOUBLE) AS spend_usd FROM (
      SELECT *, bool_or(m > 0) OVER (PARTITION BY client_id) AS has_mtd FROM (
        SELECT client_id, category, sum(spend) AS s, coalesce(sum(spend) FILTER (transaction_dt >= TIMESTAMP '2024-01-01'
                 AND transaction_dt <= TIMESTAMP '2024-01-02'), 0) AS m FROM etx GROUP BY 1, 2))
    WHERE m > 0 OR NOT has_mtd""")
def mtd_or_lifetime_spend(v: Views):
    tx = labeling.with_rule_category(v.etx())
    return spend.mtd_or_lifetime_spend(tx, "2024-01-02").select("client_id", "category", "is_mtd", dbl("spend_usd"))


@query("monthly_category_trend", f"""
    SELECT client_id, strftime(transaction_dt, '%Y-%m') AS month, category, CAST(sum(spend) AS DOUBLE) AS spend_usd
    FROM ctx JOIN (SELECT client_id, category FROM {_BY_CATEGORY}
                   QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY s DESC, category) <= 4) t USING (client_id, category)
    GROUP BY 1, 2, 3""")
def monthly_category_trend(v: Views):
    return spend.monthly_category_trend(v.categorised(), top_n=4).select("client_id", "month", "category", dbl("spend_usd"))


@query("transaction_view", """
    SELECT client_id, transaction_dt, CAST(amount_usd AS DOUBLE) AS amount_usd, category, merchant_city, merchant_state, mcc_code, use_chip
    FROM ctx WHERE transaction_dt >= TIMESTAMP '2000-03-01' AND transaction_dt <= TIMESTAMP '2000-06-15' AND category = 'Dining'""")
def transaction_view(v: Views):
    return spend.transaction_view(v.categorised(place=True), "2000-03-01", AS_OF, "Dining").select(
        "client_id", "transaction_dt", dbl("amount_usd"), "category", "merchant_city", "merchant_state", "mcc_code", "use_chip")


@query("user_limits", "SELECT client_id, CAST(monthly_limit AS DOUBLE) AS monthly_discretionary_limit_usd FROM limits")
def user_limits(v: Views):
    return v.limits().select("client_id", dbl("monthly_discretionary_limit_usd"))


@query("daily_discretionary", "SELECT client_id, day, CAST(spend AS DOUBLE) AS discretionary_spend_usd FROM daily")
def daily_discretionary(v: Views):
    return forecast.daily_discretionary(v.tx(place=False)).select("client_id", "day", dbl("discretionary_spend_usd"))


@query("daily_discretionary_labelled", """
    SELECT client_id, CAST(transaction_dt AS DATE) AS day, CAST(sum(spend) AS DOUBLE) AS discretionary_spend_usd
    FROM otx WHERE is_discretionary GROUP BY 1, 2""")
def daily_discretionary_labelled(v: Views):
    return forecast.daily_discretionary(_overlaid(v), "category").select("client_id", "day", dbl("discretionary_spend_usd"))


@query("month_samples", """
    SELECT client_id, day, ym, CAST(month_total AS DOUBLE) AS month_total, CAST(mtd AS DOUBLE) AS mtd FROM msamples""")
def month_samples(v: Views):
    return forecast.month_samples(forecast.daily_discretionary(v.tx(place=False))).select(
        "client_id", "day", "ym", dbl(TARGET, "month_total"), dbl(forecast.MTD, "mtd"))


@query("rolling_spend", "SELECT client_id, day, round(a7, 6) AS avg7, round(a30, 6) AS avg30 FROM msamples")
def rolling_spend(v: Views):
    return forecast.month_samples(forecast.daily_discretionary(v.tx(place=False))).select(
        "client_id", "day", dbl("avg_daily_discretionary_spend_7d", "avg7", 6),
        dbl("avg_daily_discretionary_spend_30d", "avg30", 6))


def _samples(v: Views):
    return forecast.training_samples(forecast.daily_discretionary(v.tx(place=False)), v.limits())


@query("training_samples", """
    SELECT client_id, day, ym, month_total, year, month, dom, dim, rem, mtd, round(a7, 6) AS a7, round(a30, 6) AS a30, lim,
           round(mtd_util, 6) AS mtd_util, round(a7_util, 6) AS a7_util FROM samples""")
def training_samples(v: Views):
    return _samples(v).select(
        "client_id", "day", "ym", dbl(TARGET, "month_total"), big("year"), big("month"), big("day_of_month", "dom"),
        big("days_in_month", "dim"), big("days_remaining_in_month", "rem"), dbl(forecast.MTD, "mtd"),
        dbl("avg_daily_discretionary_spend_7d", "a7", 6), dbl("avg_daily_discretionary_spend_30d", "a30", 6),
        dbl(budget.LIMIT, "lim"), dbl("mtd_utilization_pct", "mtd_util", 6), dbl("avg7d_utilization_pct", "a7_util", 6))


@query("time_split", """
    SELECT round(cutoff, 4) AS cutoff, count(*) AS n_samples, count(*) FILTER (d <= cutoff) AS n_train, count(*) FILTER (d > cutoff) AS n_test
    FROM (SELECT date_diff('day', DATE '1970-01-01', day) AS d FROM samples),
         (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', day) AS DOUBLE), 0.8) AS cutoff FROM samples)
    GROUP BY cutoff""")
def time_split(v: Views):
    return forecast.time_split(_samples(v)).select(dbl("cutoff", digits=4), "n_samples", "n_train", "n_test")


# Ridge in SQL: standardise, build the normal equations, solve them by elimination.
_NAMES = ("year", "month", "dom", "dim", "rem", "mtd", "a7", "a30", "lim", "mtd_util", "a7_util")
_N = len(_NAMES)
_UNPIVOT = f"""unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in _NAMES)}]) AS x, unnest(range(1, {_N + 1})) AS j"""
RIDGE_VIEWS = {
    "numbered": "SELECT *, row_number() OVER () AS r, date_diff('day', DATE '1970-01-01', day) AS d FROM samples",
    "cut": "SELECT quantile_cont(CAST(d AS DOUBLE), 0.8) AS c FROM numbered",
    "train": "SELECT numbered.*, c FROM numbered JOIN cut ON d <= c",
    "long": f"SELECT r, j, x FROM (SELECT r, {_UNPIVOT} FROM train)",
    "stats": "SELECT j, avg(x) AS mean, stddev_pop(x) AS scale FROM long GROUP BY 1",
    "z": "SELECT r, j, (x - mean) / scale AS v FROM long JOIN stats USING (j)",
    "gram": f"""
        SELECT a.j AS i, b.j AS j, sum(a.v * b.v) + CASE WHEN a.j = b.j THEN {RIDGE_ALPHA} ELSE 0 END AS g
        FROM z a JOIN z b USING (r) GROUP BY 1, 2
        UNION ALL SELECT z.j, {_N + 1}, sum(z.v * t.month_total) FROM z JOIN train t USING (r) GROUP BY 1""",
    "matrix": "SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS line FROM gram GROUP BY 1)",
    "gauss": f"""
        SELECT 0 AS k, m FROM matrix
        UNION ALL
        SELECT k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1
            THEN list_transform(line, lambda x: x / line[k + 1])
            ELSE list_transform(line, lambda x, j: x - line[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
        FROM gauss WHERE k < {_N}""",
    "weights": f"SELECT j, m[j][{_N + 1}] AS w FROM gauss, unnest(range(1, {_N + 1})) AS t(j) WHERE k = {_N}",
    "model": "SELECT j, mean, scale, w, (SELECT avg(month_total) FROM train) AS intercept FROM weights JOIN stats USING (j)",
    "fitted": f"""
        SELECT r, any_value(intercept) + sum((x - mean) / scale * w) AS predicted
        FROM (SELECT r, {_UNPIVOT} FROM numbered) JOIN model USING (j) GROUP BY 1""",
}
VIEW_SQL.update(RIDGE_VIEWS)
STORED_VIEWS.update({"numbered", "cut", "train", "stats", "z", "weights", "model", "fitted"})


@query("ridge_fit")
def ridge_fit(v: Views):
    """The weights need one pass over the samples."""
    model = forecast.ridge_of_moments(cut_lineage(forecast.day_moments(_samples(v))))
    return model.to_frame(v.spark).select(
        big("position"), "feature", dbl("mean", digits=4), dbl("scale", digits=4), dbl("weight", digits=3))


@query("ridge_metrics")
def ridge_metrics(v: Views):
    m = forecast.fit_month_end_model(cut_lineage(_samples(v))).metrics
    return v.spark.range(1).select(
        F.lit(m["cutoff_day"]).alias("cutoff_day"), F.lit(m["n_samples"]).cast("bigint").alias("n_samples"),
        F.lit(m["n_train"]).cast("bigint").alias("n_train"), F.lit(m["n_test"]).cast("bigint").alias("n_test"),
        F.round(F.lit(m["mae_train_usd"]), 3).alias("mae_train_usd"), F.round(F.lit(m["mae_test_usd"]), 3).alias("mae_test_usd"))


@query("feature_row_asof", """
    SELECT client_id, day, mtd, dom, dim, round(a7, 6) AS a7 FROM samples WHERE day <= DATE '2000-06-15'
    QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY day DESC) = 1""")
def feature_row_asof(v: Views):
    return forecast.feature_row_as_of(_samples(v), AS_OF).select(
        "client_id", "day", dbl(forecast.MTD, "mtd"), big("day_of_month", "dom"), big("days_in_month", "dim"),
        dbl("avg_daily_discretionary_spend_7d", "a7", 6))


@query("predict_month_end")
def predict_month_end(v: Views):
    samples = cut_lineage(_samples(v))
    scored = forecast.predict_month_end(samples, forecast.fit_month_end_model(samples))
    return scored.select("client_id", "day", dbl("predicted_month_end_discretionary_spend_usd", "predicted", 2))


def daily_rollup(v: Views):
    """Budget and forecast both come from this rollup, which is stored; the transactions are read once."""
    return cut_lineage(rollup.daily_partials(v.categorised()))


def forecasts(v: Views, as_of: str = AS_OF, days=None):
    """The fitted model's forecast of every client with a sample, with its signals."""
    days = daily_rollup(v) if days is None else days
    samples = cut_lineage(forecast.training_samples(rollup.discretionary_days(days, "rule_category"), v.limits()))
    rows = forecast.predict_month_end(forecast.feature_row_as_of(samples, as_of), forecast.fit_month_end_model(samples))
    return forecast.overspend_signals(rows).withColumn("as_of_date", F.col("as_of"))


@query("overspend_risk", """
    SELECT client_id, lim, mtd, round(predicted, 2) AS predicted, round(projected, 4) AS projected, risk,
           days, round(remaining, 4) AS remaining FROM signals""")
def overspend_risk(v: Views):
    return forecasts(v).select(
        "client_id", dbl(budget.LIMIT, "lim"), dbl(forecast.MTD, "mtd"),
        dbl("predicted_month_end_discretionary_spend_usd", "predicted", 2),
        dbl("projected_utilization_pct", "projected", 4), F.col("overspend_risk").alias("risk"),
        F.col("days_to_limit_estimate").alias("days"), dbl("remaining_budget_usd", "remaining", 4))


def _runway(v: Views):
    # One rollup serves the fit and the scores.
    daily = cut_lineage(forecast.daily_discretionary(v.categorised()))
    model = forecast.fit_month_end_model(cut_lineage(forecast.training_samples(daily, v.limits())))
    return forecast.score_daily(daily, v.limits(), AS_OF, model)


# Every day of a month at once.
FIRST_DAY, LAST_DAY = "2000-06-01", "2000-06-30"
VIEW_SQL.update({
    "each_day": f"SELECT CAST(d AS DATE) AS as_of FROM generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY) t(d)",
    "budget_each": """
        SELECT l.client_id, a.as_of AS as_of_date, any_value(l.monthly_limit) AS monthly_limit, coalesce(sum(spend), 0) AS mtd,
               CAST(coalesce(sum(spend), 0) AS DOUBLE) / nullif(CAST(any_value(l.monthly_limit) AS DOUBLE), 0) AS util
        FROM limits l CROSS JOIN each_day a
        LEFT JOIN ctx c ON c.client_id = l.client_id AND is_discretionary AND transaction_dt >= date_trunc('month', a.as_of)
          AND transaction_dt <= CAST(a.as_of AS TIMESTAMP)
        GROUP BY 1, 2""",
    "signals_each": """
        SELECT *, predicted / lim AS projected, predicted > lim AS risk, lim - mtd AS remaining,
               CASE WHEN lim - mtd <= 0 THEN 0
                    WHEN predicted - mtd > 0 THEN CAST(ceil((lim - mtd) / ((predicted - mtd) / greatest(dim - day(as_of), 1))) AS BIGINT)
               END AS days
        FROM (SELECT client_id, as_of, lim, mtd, dim, predicted FROM numbered JOIN fitted USING (r) CROSS JOIN each_day WHERE day <= as_of
              QUALIFY row_number() OVER (PARTITION BY client_id, as_of ORDER BY day DESC) = 1)""",
    "inputs_each": """
        SELECT b.client_id, b.as_of_date, b.util, s.projected, coalesce(s.risk, FALSE) AS risk, s.days
        FROM budget_each b LEFT JOIN signals_each s ON b.client_id = s.client_id AND b.as_of_date = s.as_of""",
})
STORED_VIEWS.update({"budget_each", "signals_each"})


def budget_of_month(v: Views, days):
    return rollup.budget_days(days, v.limits(), FIRST_DAY, LAST_DAY)


def runway_of_month(v: Views, days):
    daily = rollup.discretionary_days(days, "rule_category")
    model = forecast.fit_month_end_model(cut_lineage(forecast.training_samples(daily, v.limits())))
    return rollup.score_days(rollup.discretionary_days(days), v.limits(), FIRST_DAY, LAST_DAY, model)


@query("budget_each_day", """
    SELECT client_id, as_of_date, CAST(monthly_limit AS DOUBLE) AS lim, CAST(mtd AS DOUBLE) AS mtd, round(util, 6) AS util FROM budget_each""")
def budget_each_day(v: Views):
    return budget_of_month(v, rollup.daily_partials(v.categorised())).select(
        "client_id", "as_of_date", dbl(budget.LIMIT, "lim"), dbl(forecast.MTD, "mtd"), dbl("utilization_pct", "util", 6))


@query("runway_each_day")
def runway_each_day(v: Views):
    return _runway_columns(runway_of_month(v, daily_rollup(v)))


@query("rollup_of_loads", """
    SELECT client_id, CAST(transaction_dt AS DATE) AS day, transaction_dt = CAST(transaction_dt AS DATE) AS at_midnight, category,
           CAST(sum(spend) AS DOUBLE) AS spend_usd, count(*) AS transactions
    FROM ctx GROUP BY 1, 2, 3, 4""")
def rollup_of_loads(v: Views):
    """The rollups of three loads, each stored, merged on read: a task holds groups of one load, or a share of theirs."""
    tx = v.categorised()
    loads = [stored(rollup.daily_partials(tx.where(F.coalesce(F.col("l_returnflag"), F.lit("")) == flag)), f"load-{flag}") for flag in ("A", "N", "R")]
    parts = bucketed.buckets_for(sum(load.count() for load in loads), least=8)
    whole = rollup.merged(loads[0].unionByName(loads[1]).unionByName(loads[2]).repartition(parts, *rollup.DAY_KEYS))
    return whole.select("client_id", "day", "at_midnight", "category", dbl("spend_usd"), "transactions")


def _runway_columns(rows):
    return rows.select(
        "client_id", "as_of_date", dbl(budget.LIMIT, "lim"), dbl(forecast.MTD, "mtd"),
        dbl("predicted_month_end_discretionary_spend_usd", "predicted", 2),
        dbl("projected_utilization_pct", "projected", 4), F.col("overspend_risk").alias("risk"),
        F.col("days_to_limit_estimate").alias("days"), dbl("remaining_budget_usd", "remaining", 2), "status")


@query("runway")
def runway(v: Views):
    return _runway_columns(_runway(v))


@query("runway_at_last_date")
def runway_at_last_date(v: Views):
    """Each client as of the day of its last transaction; the days, the fit and the scores read the joined rows as stored."""
    used = ("client_id", "transaction_dt", "amount_usd", "mcc_code", "mcc_description", "category")
    tx = stored(v.categorised().select(*used), "transactions")
    samples = forecast.training_samples(forecast.daily_discretionary(tx), v.limits())
    model = forecast.fit_month_end_model(stored(samples, "samples"))
    return _runway_columns(forecast.score_clients(tx, v.limits(), cut_lineage(spend.default_as_of(tx)), model))


@query("forecast_compare", """
    SELECT client_id, 'MTD actual' AS label, round(mtd, 2) AS spend_usd FROM signals
    UNION ALL SELECT client_id, 'Projected month-end', round(predicted, 2) FROM signals
    UNION ALL SELECT client_id, 'Monthly limit', lim FROM signals""")
def forecast_compare(v: Views):
    return forecast.forecast_compare(forecasts(v)).select("client_id", "label", dbl("spend_usd", digits=2))


_LABELS = "['(intercept)', " + ", ".join(f"'{n}'" for n in FEATURES) + "]"
RIDGE_CHECKS = {
    "ridge_fit": with_views(f"""
        SELECT 0 AS position, '(intercept)' AS feature, 0.0 AS mean, 1.0 AS scale, round(any_value(intercept), 3) AS weight FROM model
        UNION ALL SELECT j, {_LABELS}[j + 1], round(mean, 4), round(scale, 4), round(w, 3) FROM model"""),
    "ridge_metrics": with_views("""
        SELECT CAST(DATE '1970-01-01' + CAST(floor(any_value(c)) AS INTEGER) AS VARCHAR) AS cutoff_day, count(*) AS n_samples,
               count(*) FILTER (d <= c) AS n_train, count(*) FILTER (d > c) AS n_test,
               round(avg(abs(month_total - predicted)) FILTER (d <= c), 3) AS mae_train_usd,
               round(avg(abs(month_total - predicted)) FILTER (d > c), 3) AS mae_test_usd
        FROM numbered JOIN fitted USING (r) CROSS JOIN cut"""),
    "predict_month_end": with_views("SELECT client_id, day, round(predicted, 2) AS predicted FROM numbered JOIN fitted USING (r)"),
    "runway": with_views("""
        SELECT l.client_id, DATE '2000-06-15' AS as_of_date, CASE WHEN s.r IS NOT NULL THEN s.lim END AS lim, s.mtd,
               round(predicted, 2) AS predicted, round(predicted / s.lim, 4) AS projected, predicted > s.lim AS risk,
               CASE WHEN s.lim - s.mtd <= 0 THEN 0
                    WHEN predicted - s.mtd > 0 THEN CAST(ceil((s.lim - s.mtd) / ((predicted - s.mtd) / greatest(dim - 15, 1))) AS BIGINT)
               END AS days, round(s.lim - s.mtd, 2) AS remaining,
               CASE WHEN monthly_limit IS NULL OR monthly_limit <= 0 THEN 'no_limit' WHEN s.r IS NULL THEN 'no_history' ELSE 'scored' END AS status
        FROM (SELECT DISTINCT c_custkey // 30 AS client_id FROM customer) l
        LEFT JOIN (SELECT client_id, CASE WHEN min_by(c_acctbal, c_custkey) > 0 THEN 1 END AS monthly_limit
                   FROM (SELECT *, c_custkey // 30 AS client_id FROM customer) GROUP BY 1) h ON l.client_id = h.client_id
        LEFT JOIN (SELECT * FROM numbered JOIN fitted USING (r) WHERE day <= DATE '2000-06-15'
                   QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY day DESC) = 1) s ON l.client_id = s.client_id"""),
    "runway_each_day": with_views("""
        SELECT l.client_id, a.as_of AS as_of_date, CASE WHEN s.as_of IS NOT NULL THEN s.lim END AS lim, s.mtd,
               round(predicted, 2) AS predicted, round(projected, 4) AS projected, risk, days, round(remaining, 2) AS remaining,
               CASE WHEN monthly_limit IS NULL OR monthly_limit <= 0 THEN 'no_limit' WHEN s.as_of IS NULL THEN 'no_history' ELSE 'scored' END AS status
        FROM limits l CROSS JOIN each_day a LEFT JOIN signals_each s ON l.client_id = s.client_id AND a.as_of = s.as_of"""),
    "runway_at_last_date": with_views("""
        SELECT l.client_id, a.as_of AS as_of_date, CASE WHEN s.r IS NOT NULL THEN s.lim END AS lim, s.mtd,
               round(predicted, 2) AS predicted, round(predicted / s.lim, 4) AS projected, predicted > s.lim AS risk,
               CASE WHEN s.lim - s.mtd <= 0 THEN 0
                    WHEN predicted - s.mtd > 0 THEN CAST(ceil((s.lim - s.mtd) / ((predicted - s.mtd) / greatest(dim - day(a.as_of), 1))) AS BIGINT)
               END AS days, round(s.lim - s.mtd, 2) AS remaining,
               CASE WHEN monthly_limit IS NULL OR monthly_limit <= 0 THEN 'no_limit' WHEN s.r IS NULL THEN 'no_history' ELSE 'scored' END AS status
        FROM limits l JOIN last_day a ON l.client_id = a.client_id
        LEFT JOIN (SELECT * FROM numbered JOIN fitted USING (r) JOIN last_day USING (client_id) WHERE day <= as_of
                   QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY day DESC) = 1) s ON l.client_id = s.client_id"""),
}
