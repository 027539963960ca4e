"""Daily rollups that are stored per load and merged on read, and what is computed from them for ranges of days.

A rollup holds sums, counts and least times only, so the rollups of two loads add up to that of both. A refresh after a
load rolls up the new rows; nothing older is read again but the stored partials.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import DISCRETIONARY_CATEGORIES
from ..functions.calendar import midnight, month_start
from ..functions.category import is_discretionary, is_subscription, mcc_category
from ..functions.money import ratio
from .budget import LIMIT
from .common import AsOf, day_literal, require_columns, with_as_of
from .forecast import (
    DAILY, MTD, RUNWAY_COLUMNS, MonthEndModel, overspend_signals, predict_month_end, training_samples,
)
from .spend import dated_spend

DAY_KEYS = ("client_id", "day", "at_midnight", "category", "rule_category")
MERCHANT_KEYS = (
    "client_id", "day", "at_midnight", "category", "merchant_id", "merchant_city", "merchant_state", "is_discretionary", "is_subscription",
)


def _dated(tx: DataFrame) -> DataFrame:
    moment = F.col("transaction_dt")
    rows = dated_spend(tx).withColumn("day", F.to_date(moment))
    return rows.withColumn("at_midnight", moment == midnight(F.col("day")))


def daily_partials(tx: DataFrame) -> DataFrame:
    """Spend and rows per client, day and category: that in use (`category`) and that of the MCC rule.

    What is dated at midnight stands apart, because an as-of day counts up to its midnight in the budget.
    """
    require_columns(tx, ["client_id", "transaction_dt", "amount_usd", "category", "mcc_code", "mcc_description"])
    rows = _dated(tx).withColumn("rule_category", mcc_category(F.col("mcc_code"), F.col("mcc_description")))
    return rows.groupBy(*DAY_KEYS).agg(F.sum("spend_usd").alias("spend_usd"), F.count(F.lit(1)).alias("transactions"))


def merchant_partials(tx: DataFrame) -> DataFrame:
    """Spend per client, day, category and merchant with its place; `first_dt` is the first time in the group."""
    require_columns(tx, ["client_id", "transaction_dt", "amount_usd", "category", "merchant_id", "mcc_description", "is_discretionary"])
    rows = _dated(tx).withColumn("is_subscription", is_subscription(F.col("category"), F.col("mcc_description")))
    return rows.groupBy(*MERCHANT_KEYS).agg(
        F.sum("spend_usd").alias("spend_usd"), F.count(F.lit(1)).alias("transactions"), F.min("transaction_dt").alias("first_dt"),
    )


def merged(partials: DataFrame) -> DataFrame:
    """Partials of several loads as one rollup: sums and counts add up, of the first times the least stays."""
    keys = [c for c in (DAY_KEYS if "rule_category" in partials.columns else MERCHANT_KEYS)]
    values = {"spend_usd": F.sum, "transactions": F.sum, "first_dt": F.min}
    return partials.groupBy(*keys).agg(*[f(c).alias(c) for c, f in values.items() if c in partials.columns])


def discretionary_days(days: DataFrame, category: str = "category") -> DataFrame:
    """`forecast.daily_discretionary` from a rollup; `rule_category` is what the model is trained on."""
    rows = days.where(is_discretionary(F.col(category)) & F.col("client_id").isNotNull())
    return rows.groupBy("client_id", "day").agg(F.sum("spend_usd").alias(DAILY))


def category_days(days: DataFrame, as_of: AsOf) -> DataFrame:
    """Positive month-to-date spend by category up to midnight of the as-of day, from a rollup."""
    rows = with_as_of(days, as_of)
    inside = (F.col("day") < F.col("as_of")) | ((F.col("day") == F.col("as_of")) & F.col("at_midnight"))
    rows = rows.where((F.col("day") >= month_start(F.col("as_of"))) & inside)
    return rows.groupBy("client_id", "category").agg(F.sum("spend_usd").alias("spend_usd")).where("spend_usd > 0")


def days_between(first: date | str, last: date | str) -> Column:
    """Every day of a range, as an array."""
    return F.sequence(day_literal(first), day_literal(last), F.expr("interval 1 day"))


def as_of_days(clients: DataFrame, first: date | str, last: date | str) -> DataFrame:
    """(client_id, as_of) for every client and every day of a range."""
    return clients.select("client_id").withColumn("as_of", F.explode(days_between(first, last)))


def budget_days(days: DataFrame, limits: DataFrame, first: date | str, last: date | str, as_of_inclusive: bool = False) -> DataFrame:
    """`budget.budget_utilization` for every client of `limits` and every day of a range, from one read of the rollup.

    The spend of a day is two events, what is dated at midnight and the rest, with the question of that day between them;
    a running sum over a client's month answers all days. A window partition has at most three rows per day of a month.
    """
    low = F.trunc(day_literal(first), "month")
    rows = days.where(F.col("day").between(low, day_literal(last)) & is_discretionary(F.col("category")))
    order = F.when(F.col("at_midnight") | F.lit(as_of_inclusive), 0).otherwise(2)
    spent = rows.groupBy("client_id", "day", order.alias("at")).agg(F.sum("spend_usd").alias("spend_usd"))
    asked = limits.select("client_id", LIMIT).withColumn("day", F.explode(days_between(first, last)))
    events = asked.withColumns({"at": F.lit(1), "spend_usd": F.lit(None).cast(spent.schema["spend_usd"].dataType)}).unionByName(
        spent.withColumn(LIMIT, F.lit(None).cast(limits.schema[LIMIT].dataType))
    )
    month = month_start(F.col("day"))
    until = Window.partitionBy("client_id", month).orderBy("day", "at").rowsBetween(Window.unboundedPreceding, 0)
    told = events.withColumn("_mtd", F.sum("spend_usd").over(until)).where("at = 1")
    mtd = F.coalesce("_mtd", F.lit(0)).cast("decimal(28,2)")
    return told.select(
        "client_id", F.col("day").alias("as_of_date"), month.alias("month_start"), LIMIT, mtd.alias(MTD),
        ratio(mtd, F.col(LIMIT)).alias("utilization_pct"),
        F.array(*[F.lit(c) for c in sorted(DISCRETIONARY_CATEGORIES)]).alias("discretionary_categories"),
    )


def latest_as_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """For every (client_id, as_of) of `asked` the latest of `rows` (client_id, day, ...) up to that day, if there is one.

    Rows and questions of a client are merged in the order of days and every question takes the last row before it, so
    many days of a client cost one pass over its rows.
    """
    names = [c for c in rows.columns if c != "client_id"]
    known = rows.select("client_id", F.col("day").alias("_at"), F.lit(0).alias("_kind"), F.struct(*names).alias("_row"))
    empty = F.lit(None).cast(known.schema["_row"].dataType)
    every = known.unionByName(asked.select("client_id", F.col("as_of").alias("_at"), F.lit(1).alias("_kind"), empty.alias("_row")))
    before = Window.partitionBy("client_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    told = every.withColumn("_row", F.last("_row", ignorenulls=True).over(before)).where("_kind = 1")
    return told.select("client_id", F.col("_at").alias("as_of"), "_row.*")


def score_days(daily: DataFrame, limits: DataFrame, first: date | str, last: date | str, model: MonthEndModel) -> DataFrame:
    """`forecast.score_clients` for every client of `limits` and every day of a range, from one read of daily spend.

    Of the time before the range only each client's last month with spend is needed.
    """
    start = F.trunc(day_literal(first), "month")
    known = daily.where(F.col("day") <= day_literal(last))
    older = F.max(F.when(F.col("day") < start, F.col("day"))).over(Window.partitionBy("client_id"))
    recent = known.withColumn("_older", older).where((F.col("day") >= start) | (F.trunc("day", "month") == F.trunc("_older", "month"))).drop("_older")
    samples = training_samples(recent, limits)
    asked = as_of_days(limits, first, last)
    scored = overspend_signals(predict_month_end(latest_as_of(samples, asked).drop("_limit"), model))
    usable = limits.select("client_id", F.col(LIMIT).alias("_limit"))
    status = (
        F.when(F.col("_limit").isNull() | (F.col("_limit") <= 0), "no_limit")
        .when(F.col(MTD).isNull(), "no_history")
        .otherwise("scored")
    )
    return scored.withColumnRenamed("as_of", "as_of_date").join(usable, "client_id").select(*RUNWAY_COLUMNS, status.alias("status"))
