"""Monthly limits and budget utilization."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import DISCRETIONARY_CATEGORIES
from ..functions.calendar import month_start
from ..functions.money import parse_money, ratio
from .common import AsOf, best_rows, require_columns, with_as_of
from .spend import dated_spend, month_to_date

LIMIT = "monthly_discretionary_limit_usd"


def user_limits(users: DataFrame) -> DataFrame:
    """`client_id`, limit. Users whose id is not a number are dropped."""
    require_columns(users, ["id", "monthly_discretionary_limits"])
    return users.select(
        F.col("id").cast("string").try_cast("double").cast("bigint").alias("client_id"),
        parse_money(F.col("monthly_discretionary_limits")).alias(LIMIT),
    ).where("client_id is not null")


def baseline_limits(tx: DataFrame) -> DataFrame:
    """The limit that enriched rows carry; it is the same on all rows of a client."""
    return tx.groupBy("client_id").agg(F.max(LIMIT).alias(LIMIT))


def latest_limit_overrides(changes: DataFrame, order_by: list[str]) -> DataFrame:
    """Current overrides out of an append-only change table.

    The last change of a client wins; a null limit clears the override; text that is not a number
    is skipped.
    """
    limit = F.col("limit_usd").cast("string")
    typed = changes.withColumn("_limit", limit.try_cast("decimal(18,2)"))
    usable = typed.where(limit.isNull() | F.col("_limit").isNotNull())
    last = best_rows(usable, ["client_id"], [F.col(c).desc() for c in order_by])
    return last.where("_limit is not null").select("client_id", F.col("_limit").alias("limit_usd"))


def effective_limits(baseline: DataFrame, overrides: DataFrame) -> DataFrame:
    """The override where there is one, else the baseline."""
    own = overrides.select("client_id", F.col("limit_usd").alias("_override"))
    return baseline.join(own, "client_id", "left").select(
        "client_id",
        F.coalesce("_override", LIMIT).alias(LIMIT),
        F.col("_override").isNotNull().alias("is_override"),
    )


def budget_records(budget: DataFrame, source_mix: DataFrame) -> DataFrame:
    """Budget rows with the row counts per label source as a map. Only for the sink."""
    entries = F.sort_array(F.collect_list(F.struct("category_source", "transactions")))
    mix = source_mix.where("category_source is not null").groupBy("client_id").agg(
        F.map_from_entries(entries).alias("category_source_mix")
    )
    return budget.join(mix, "client_id", "left")


def budget_utilization(
    tx: DataFrame,
    limits: DataFrame,
    as_of: AsOf,
    as_of_inclusive: bool = False,
) -> DataFrame:
    """Month-to-date discretionary spend against the limit, one row per client of `limits`.

    Rows count up to midnight of the as-of day; `as_of_inclusive=True` takes the whole day. The
    utilization is null where the limit is null or zero. With one date for all clients the month
    window is pushed into the scan, so only that month is read.
    """
    counted = dated_spend(tx).where("is_discretionary")
    mtd = month_to_date(counted, as_of, inclusive=as_of_inclusive).withColumnRenamed("spend_usd", "_mtd")
    out = with_as_of(limits.select("client_id", LIMIT), as_of).join(mtd, "client_id", "left")
    spent = F.coalesce("_mtd", F.lit(0).cast("decimal(18,2)"))
    return out.select(
        "client_id",
        F.col("as_of").alias("as_of_date"),
        month_start(F.col("as_of")).alias("month_start"),
        LIMIT,
        spent.alias("mtd_discretionary_spend_usd"),
        ratio(spent, F.col(LIMIT)).alias("utilization_pct"),
        F.array(*[F.lit(c) for c in sorted(DISCRETIONARY_CATEGORIES)]).alias("discretionary_categories"),
    )
