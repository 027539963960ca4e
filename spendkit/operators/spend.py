"""Spend analytics per client.

All money sums are partial aggregates over decimals: exact, independent of row order, and small
before they are shuffled. Windows run over aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import midnight, month_label, month_start, next_midnight, weekday_name
from ..functions.money import spend
from .common import AsOf, between_days, day_literal, ranked, with_as_of


def _per_client():
    return Window.partitionBy("client_id")


def valid_spend(tx: DataFrame) -> DataFrame:
    """Rows with an amount, plus `spend_usd`."""
    return tx.where(F.col("amount_usd").isNotNull()).withColumn("spend_usd", spend(F.col("amount_usd")))


def dated_spend(tx: DataFrame) -> DataFrame:
    return valid_spend(tx).where(F.col("transaction_dt").isNotNull())


def _total(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy("client_id", *keys).agg(F.sum("spend_usd").alias("spend_usd"))


def spend_by_category(tx: DataFrame) -> DataFrame:
    return _total(valid_spend(tx), "category")


def spend_by_mcc(tx: DataFrame) -> DataFrame:
    return _total(valid_spend(tx), "mcc_code", "mcc_description")


def spend_by_month(tx: DataFrame) -> DataFrame:
    return _total(dated_spend(tx), month_label(F.col("transaction_dt")).alias("month"))


def daily_spend(tx: DataFrame) -> DataFrame:
    return _total(dated_spend(tx), F.to_date("transaction_dt").alias("day"))


def avg_daily_spend_by_dow(tx: DataFrame) -> DataFrame:
    """Mean spend per weekday over the dates that have a row."""
    daily = daily_spend(tx)
    return (
        daily.groupBy("client_id", weekday_name(F.col("day")).alias("dow"), F.weekday("day").alias("dow_no"))
        .agg((F.sum("spend_usd").cast("double") / F.count("*")).alias("avg_daily_spend_usd"))
    )


def spend_by_dow_total(tx: DataFrame) -> DataFrame:
    """Lifetime spend per weekday."""
    return _total(dated_spend(tx), weekday_name(F.col("transaction_dt")).alias("dow"))


def total_spend(tx: DataFrame) -> DataFrame:
    return dated_spend(tx).groupBy("client_id").agg(F.sum("spend_usd").alias("total_spend_usd"))


def top_merchants(tx: DataFrame, n: int = 25) -> DataFrame:
    place = ["merchant_id", "merchant_city", "merchant_state"]
    order = [F.col("spend_usd").desc()] + [F.col(c) for c in place]
    return ranked(_total(dated_spend(tx), *place), ["client_id"], order, n)


def top_mcc(tx: DataFrame, n: int = 50) -> DataFrame:
    order = [F.col("spend_usd").desc(), F.col("mcc_code"), F.col("mcc_description")]
    return ranked(spend_by_mcc(tx), ["client_id"], order, n)


def client_date_range(tx: DataFrame) -> DataFrame:
    """First and last transaction; clients without a date are left out."""
    return (
        tx.groupBy("client_id")
        .agg(F.min("transaction_dt").alias("min_dt"), F.max("transaction_dt").alias("max_dt"))
        .where(F.col("max_dt").isNotNull())
    )


def default_as_of(tx: DataFrame) -> DataFrame:
    """The last transaction date of every client, as an `as_of` frame."""
    return client_date_range(tx).select("client_id", F.to_date("max_dt").alias("as_of"))


def category_source_mix(tx: DataFrame) -> DataFrame:
    """Rows per label source."""
    return dated_spend(tx).groupBy("client_id", "category_source").agg(F.count("*").alias("transactions"))


def category_source_share(tx: DataFrame) -> DataFrame:
    source = F.coalesce("category_source", F.lit("mcc")).alias("category_source")
    counts = tx.groupBy("client_id", source).agg(F.count("*").alias("transactions"))
    share = F.col("transactions") / F.sum("transactions").over(_per_client())
    return counts.withColumn("share", share)


def category_breakdown(by_category: DataFrame) -> DataFrame:
    """Share of every category in the client's total; 0 where the total is not positive."""
    total = F.sum("spend_usd").over(_per_client()).cast("double")
    share = F.when(total > 0, F.col("spend_usd").cast("double") * 100 / total).otherwise(0.0)
    return by_category.withColumn("share_pct", share)


def category_share(by_category: DataFrame, top_n: int = 5) -> DataFrame:
    """The top categories and one `Other` bucket for the rest, with shares.

    Where the total is not positive every category stays, with share 0.
    """
    order = _per_client().orderBy(F.col("spend_usd").desc(), F.col("category"))
    parts = by_category.withColumns(
        {
            "_rank": F.row_number().over(order),
            "_total": F.sum("spend_usd").over(_per_client()).cast("double"),
        }
    )
    tail = (F.col("_total") > 0) & (F.col("_rank") > top_n)
    label = F.when(tail, "Other").otherwise(F.col("category"))
    return (
        parts.groupBy("client_id", "_total", tail.alias("is_other"), label.alias("category"))
        .agg(F.sum("spend_usd").alias("spend_usd"))
        .withColumn(
            "share_pct",
            F.when(F.col("_total") > 0, F.col("spend_usd").cast("double") * 100 / F.col("_total"))
            .otherwise(0.0),
        )
        .drop("_total")
    )


def month_to_date(rows: DataFrame, as_of: AsOf, *keys: str, inclusive: bool = False) -> DataFrame:
    """Sum of `spend_usd` from the month start up to midnight of the as-of day, per client and key.

    `inclusive=True` takes the whole as-of day. One date for all clients becomes a filter that the
    scan understands. With a date per client the rows are first rolled up to days, with the
    midnight instants apart, so the join with the dates sees days and not transactions.
    """
    moment, day = F.col("transaction_dt"), F.col("as_of")
    if not isinstance(as_of, DataFrame):
        until = moment < next_midnight(day) if inclusive else moment <= midnight(day)
        return _total(between_days(with_as_of(rows, as_of), as_of, month_start(day), until), *keys)
    on = F.to_date(moment)
    days = _total(rows, *keys, on.alias("_day"), (moment == midnight(on)).alias("_at_midnight"))
    last = F.lit(True) if inclusive else F.col("_at_midnight")
    inside = (F.col("_day") < day) | ((F.col("_day") == day) & last)
    return _total(with_as_of(days, as_of).where((F.col("_day") >= month_start(day)) & inside), *keys)


def mtd_category_spend(tx: DataFrame, as_of: AsOf) -> DataFrame:
    """Positive month-to-date spend by category, up to midnight of the as-of day."""
    return month_to_date(dated_spend(tx), as_of, "category").where("spend_usd > 0")


def mtd_or_lifetime_spend(tx: DataFrame, as_of: AsOf) -> DataFrame:
    """Month-to-date category spend; clients with none fall back to lifetime spend."""
    mtd = mtd_category_spend(tx, as_of).withColumnRenamed("spend_usd", "_mtd")
    life = spend_by_category(tx)
    same = (F.col("l.client_id") == F.col("m.client_id")) & F.col("l.category").eqNullSafe(F.col("m.category"))
    both = life.alias("l").join(mtd.alias("m"), same, "left").select("l.*", "_mtd")
    has_mtd = F.max(F.col("_mtd").isNotNull()).over(_per_client())
    return (
        both.withColumn("is_mtd", has_mtd)
        .where(~F.col("is_mtd") | F.col("_mtd").isNotNull())
        .select("client_id", "category", "is_mtd", F.coalesce("_mtd", "spend_usd").alias("spend_usd"))
    )


def monthly_category_trend(tx: DataFrame, top_n: int = 8) -> DataFrame:
    """Monthly spend of each client's top categories.

    The transactions are read once. The windows run over the monthly sums, one row per client, month
    and category.
    """
    monthly = _total(
        dated_spend(tx), month_label(F.col("transaction_dt")).alias("month"), "category"
    )
    life = F.sum("spend_usd").over(Window.partitionBy("client_id", "category"))
    order = _per_client().orderBy(F.col("_life").desc(), F.col("category"))
    return (
        monthly.withColumn("_life", life)
        .withColumn("_rank", F.dense_rank().over(order))
        .where(F.col("_rank") <= top_n)
        .drop("_life", "_rank")
    )


def spending_patterns(tx: DataFrame, merchants: int = 25) -> DataFrame:
    """One nested record per client: total, months, weekdays and top merchants.

    Only for the sink. The lists hold one entry per month, per weekday and per top merchant.
    """

    def packed(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        entries = F.sort_array(F.collect_list(F.struct(key, F.col(value).cast("double"))))
        return df.groupBy("client_id").agg(F.map_from_entries(entries).alias(name))

    months = packed(spend_by_month(tx), "month", "spend_usd", "by_month_usd")
    days = packed(avg_daily_spend_by_dow(tx), "dow", "avg_daily_spend_usd", "avg_daily_spend_by_day_of_week_usd")
    entry = F.struct("rank", "merchant_id", "merchant_city", "merchant_state", F.col("spend_usd").cast("double").alias("spend_usd"))
    top = top_merchants(tx, merchants).groupBy("client_id").agg(
        F.sort_array(F.collect_list(entry)).alias("top_merchants_usd")
    )
    return total_spend(tx).join(months, "client_id").join(days, "client_id").join(top, "client_id")


VIEW_COLUMNS = (
    "client_id", "transaction_dt", "amount_usd", "category", "category_source", "merchant_city",
    "merchant_state", "mcc_code", "mcc_description", "use_chip",
)


def transaction_view(
    tx: DataFrame,
    start=None,
    end=None,
    category: str | None = None,
    newest_first: bool = False,
) -> DataFrame:
    """Rows between two dates, the end up to its midnight, optionally of one category."""
    if start is not None:
        tx = tx.where(F.col("transaction_dt") >= midnight(day_literal(start)))
    if end is not None:
        tx = tx.where(F.col("transaction_dt") <= midnight(day_literal(end)))
    if category is not None:
        tx = tx.where(F.col("category") == category)
    out = tx.select(*[c for c in VIEW_COLUMNS if c in tx.columns])
    return out.orderBy(F.col("transaction_dt").desc()) if newest_first else out


def client_ids(users: DataFrame, column: str = "id") -> DataFrame:
    """Distinct numeric ids, ascending; anything else is dropped."""
    number = F.col(column).cast("string").try_cast("double").cast("bigint")
    return users.select(number.alias("client_id")).where("client_id is not null").distinct().orderBy("client_id")
