"""Saving recommendations per client: recurring merchants, category cutbacks, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import (
    CUTBACK_LOOKBACK_DAYS,
    CUTBACK_SHARE,
    CUTBACK_TRIES,
    MAX_RECOMMENDATIONS,
    RECURRING_LOOKBACK_DAYS,
    RECURRING_MAX_CV,
    RECURRING_MIN_MONTHLY_USD,
    RECURRING_MIN_MONTHS,
)
from ..functions.calendar import midnight, month_label
from ..functions.category import is_subscription
from ..functions.identity import stable_id
from ..functions.money import money_label, percent_label, ratio
from ..session import cut_lineage
from .common import AsOf, best_rows, between_days, day_literal, ranked, require_columns, with_as_of
from .spend import dated_spend

SUBSCRIPTION_RULE = "recurring_subscription"
CUTBACK_RULE = "cutback_top_category_merchant"


_ROLLED = ("category", "merchant_id", "merchant_city", "merchant_state", "is_discretionary", "is_subscription")


def spending_rollup(
    tx: DataFrame, as_of: AsOf, lookback_days: int = RECURRING_LOOKBACK_DAYS, recent_days: int = CUTBACK_LOOKBACK_DAYS,
) -> DataFrame:
    """Spend per client, category, merchant with its place, and month, from `lookback_days` before the as-of day up to
    its midnight, in hash aggregates over the rows.

    Recurring merchants and category cutbacks are both computed from it. `is_recent` marks the last `recent_days`;
    `first_dt` is the first time in the group. With one date the window reaches the scan. With a date per client the
    scan is bounded by the first and last of them, and rows are rolled up to days, the midnight instants apart,
    before the join with the dates, so a hot client joins days and not transactions.
    """
    require_columns(tx, ["transaction_dt", "amount_usd", "merchant_id", "category", "mcc_description"])
    rows, at, day = dated_spend(tx), F.col("transaction_dt"), F.col("as_of")
    for column, kind in (("merchant_city", "string"), ("merchant_state", "string"), ("is_discretionary", "boolean")):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(kind))
    rows = rows.withColumn("is_subscription", is_subscription(F.col("category"), F.col("mcc_description")))
    if isinstance(as_of, DataFrame):
        first, last = as_of.agg(F.min(F.to_date("as_of")), F.max(F.to_date("as_of"))).first()
        if first is None:
            rows = rows.limit(0)
        else:
            rows = rows.where((at >= midnight(F.date_sub(day_literal(first), lookback_days))) & (at <= midnight(day_literal(last))))
        on = F.to_date(at)
        days = rows.groupBy("client_id", *_ROLLED, on.alias("_day"), (at == midnight(on)).alias("_at_midnight")).agg(
            F.sum("spend_usd").alias("spend_usd"), F.min(at).alias("transaction_dt"),
        )
        inside = (F.col("_day") < day) | ((F.col("_day") == day) & F.col("_at_midnight"))
        rows = with_as_of(days, as_of).where((F.col("_day") >= F.date_sub(day, lookback_days)) & inside)
    else:
        rows = between_days(with_as_of(rows, as_of), as_of, F.date_sub(day, lookback_days), at <= midnight(day))
    return rows.groupBy(
        "client_id", *_ROLLED, month_label(at).alias("month"), (at >= midnight(F.date_sub(day, recent_days))).alias("is_recent"),
    ).agg(F.sum("spend_usd").alias("spend_usd"), F.min(at).alias("first_dt"))


def rollup_of_days(
    days: DataFrame, as_of: AsOf, lookback_days: int = RECURRING_LOOKBACK_DAYS, recent_days: int = CUTBACK_LOOKBACK_DAYS,
) -> DataFrame:
    """`spending_rollup` from stored sums per day, `rollup.merchant_partials`."""
    day, at = F.col("as_of"), F.col("first_dt")
    inside = (F.col("day") < day) | ((F.col("day") == day) & F.col("at_midnight"))
    rows = with_as_of(days, as_of).where((F.col("day") >= F.date_sub(day, lookback_days)) & inside)
    return rows.groupBy(
        "client_id", *_ROLLED, month_label(at).alias("month"), (F.col("day") >= F.date_sub(day, recent_days)).alias("is_recent"),
    ).agg(F.sum("spend_usd").alias("spend_usd"), F.min(at).alias("first_dt"))


def recurring_of(rollup: DataFrame) -> DataFrame:
    """Merchants with steady monthly spend. Rows without a merchant are left out."""
    monthly = rollup.where(F.col("merchant_id").isNotNull()).groupBy("client_id", "merchant_id", "month").agg(
        F.sum("spend_usd").alias("monthly"), F.bool_or("is_subscription").alias("is_subscription"),
    )
    spent = F.col("monthly").cast("double")
    total = F.sum("monthly").alias("total_spend_usd")
    per_merchant = monthly.groupBy("client_id", "merchant_id").agg(
        F.count("*").alias("active_months"),
        (F.sum("monthly").cast("double") / F.count("*")).alias("avg_monthly_spend_usd"),
        total,
        F.stddev_samp(spent).alias("std_monthly_spend_usd"),
        F.bool_or("is_subscription").alias("is_subscription"),
    )
    cv = ratio(F.col("std_monthly_spend_usd"), F.col("avg_monthly_spend_usd"))
    return per_merchant.withColumn("cv_monthly_spend", cv).where(
        (F.col("active_months") >= RECURRING_MIN_MONTHS)
        & (F.col("avg_monthly_spend_usd") >= RECURRING_MIN_MONTHLY_USD)
        & (F.coalesce("cv_monthly_spend", F.lit(0.0)) <= RECURRING_MAX_CV)
    )


def recurring_merchants(
    tx: DataFrame, as_of: AsOf, lookback_days: int = RECURRING_LOOKBACK_DAYS
) -> DataFrame:
    return recurring_of(spending_rollup(tx, as_of, lookback_days))


def categories_of(rollup: DataFrame, recent_days: int = CUTBACK_LOOKBACK_DAYS, discretionary_only: bool = True) -> DataFrame:
    """Every category of a client over the recent days, ranked by spend from 1, with its top merchant.

    The rollup goes through two aggregates: client, category and merchant, then client and category, which picks
    the top merchant on the way. Rows without a merchant count for the category but cannot be its top
    merchant. A merchant's place is the first that is known, by time and then by name.
    """
    rows = rollup.where("is_recent")
    if discretionary_only:
        rows = rows.where("is_discretionary")

    def first_known(column: str):
        order = F.when(F.col(column).isNotNull(), F.struct("first_dt", column))
        return F.min_by(F.col(column), order).alias(column)

    merchants = rows.groupBy("client_id", "category", "merchant_id").agg(
        F.sum("spend_usd").alias("merchant_spend_usd"),
        first_known("merchant_city"),
        first_known("merchant_state"),
    )
    spent, merchant = F.col("merchant_spend_usd"), F.col("merchant_id")
    best = F.when(merchant.isNotNull() & (spent > 0), F.struct(-spent, merchant))
    top = F.struct("merchant_id", "merchant_city", "merchant_state", "merchant_spend_usd")
    categories = merchants.groupBy("client_id", "category").agg(
        F.sum(spent).alias("category_spend_usd"), F.min_by(top, best).alias("_top")
    )
    order = Window.partitionBy("client_id").orderBy(F.col("category_spend_usd").desc(), "category")
    months = max(recent_days / 30.0, 1.0)
    return (
        categories.withColumn("category_rank", F.row_number().over(order))
        .where((F.col("category_spend_usd") > 0) & F.col("_top.merchant_id").isNotNull())
        .select("client_id", "category", "category_spend_usd", "category_rank", "_top.*")
        .withColumns(
            {
                "merchant_share_of_category": ratio(spent, F.col("category_spend_usd")),
                "lookback_days": F.lit(recent_days),
                "estimated_monthly_savings_usd": spent.cast("double") / months * CUTBACK_SHARE,
            }
        )
    )


def top_category_merchants(
    tx: DataFrame,
    as_of: AsOf,
    lookback_days: int = CUTBACK_LOOKBACK_DAYS,
    discretionary_only: bool = True,
) -> DataFrame:
    return categories_of(spending_rollup(tx, as_of, lookback_days, lookback_days), lookback_days, discretionary_only)


def _item(rec_id, title, action, rationale, saving, rule, preference, **meta):
    names = ("category", "merchant_id", "merchant_city", "merchant_state", "category_spend_usd",
             "merchant_spend_usd", "lookback_days", "active_months")
    types = {"category_spend_usd": "decimal(28,2)", "merchant_spend_usd": "decimal(28,2)",
             "lookback_days": "int", "active_months": "bigint"}
    fields = [meta.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n) for n in names]
    return [
        F.col("client_id"),
        rec_id.alias("rec_id"),
        title.alias("title"),
        action.alias("action"),
        rationale.alias("rationale"),
        saving.cast("double").alias("estimated_monthly_savings_usd"),
        F.lit(rule).alias("rule"),
        F.struct(*fields).alias("meta"),
        preference.cast("int").alias("preference"),
    ]


def subscription_items(recurring: DataFrame) -> DataFrame:
    """The costliest recurring subscription of each client, as an item to pause or cancel."""
    top = best_rows(
        recurring.where("is_subscription"),
        ["client_id"],
        [F.col("avg_monthly_spend_usd").desc(), F.col("merchant_id")],
    )
    merchant, months = F.col("merchant_id"), F.col("active_months")
    # Fixed texts.
    return top.select(
        *_item(
            rec_id=stable_id(F.lit(SUBSCRIPTION_RULE), F.col("client_id"), merchant),
            title=F.lit("Pause or cancel your top subscription"),
            action=F.concat(
                F.lit("Cancel, pause, or downgrade merchant `"), merchant, F.lit("` (~"),
                money_label(F.col("avg_monthly_spend_usd")), F.lit("/mo)."),
            ),
            rationale=F.concat(
                F.lit("This merchant shows recurring monthly spend across "),
                months.cast("string"), F.lit(" month(s)."),
            ),
            saving=F.col("avg_monthly_spend_usd"),
            rule=SUBSCRIPTION_RULE,
            preference=F.lit(0),
            merchant_id=merchant,
            active_months=months,
        )
    )


def cutback_items(hits: DataFrame, tries: int = CUTBACK_TRIES) -> DataFrame:
    """Cutback items for the first `tries` categories of the walk: ranks 1, 3, 5, 7 and 9.

    The walk over candidates raises the rank and drops the category it has used, so it visits every
    other category. Dismissed items advance it too, so the ranks do not depend on feedback.
    """
    rank = F.col("category_rank")
    visited = hits.where((rank % 2 == 1) & (rank <= 2 * tries - 1))
    category, merchant = F.col("category"), F.col("merchant_id")
    place = F.concat_ws(" / ", merchant, "merchant_city", "merchant_state")
    days = F.col("lookback_days")
    months = F.greatest(days / 30.0, F.lit(1.0))
    monthly = F.col("merchant_spend_usd").cast("double") / months
    # Fixed texts.
    return visited.select(
        *_item(
            rec_id=stable_id(F.lit(CUTBACK_RULE), F.col("client_id"), category, merchant),
            title=F.concat(F.lit("Cut "), category, F.lit(" spend at your top merchant")),
            action=F.concat(
                F.lit("Reduce visits or ticket size at `"), place, F.lit("` (~"),
                money_label(monthly), F.lit("/mo in "), category, F.lit(")."),
            ),
            rationale=F.concat(
                F.lit("In the last ~"), days.cast("string"), F.lit(" days, `"), category,
                F.lit("` is a top discretionary category ("), money_label(F.col("category_spend_usd")),
                F.lit("). Merchant `"), merchant, F.lit("` alone is "),
                money_label(F.col("merchant_spend_usd")), F.lit(" ("),
                percent_label(F.col("merchant_share_of_category")), F.lit(" of that category)."),
            ),
            saving=F.col("estimated_monthly_savings_usd"),
            rule=CUTBACK_RULE,
            preference=rank,
            category=category,
            merchant_id=merchant,
            merchant_city=F.col("merchant_city"),
            merchant_state=F.col("merchant_state"),
            category_spend_usd=F.col("category_spend_usd"),
            merchant_spend_usd=F.col("merchant_spend_usd"),
            lookback_days=days,
        )
    )


def latest_feedback(feedback: DataFrame, order_by: list[str]) -> DataFrame:
    """Current feedback per recommendation out of an append-only table; the last entry wins."""
    return best_rows(feedback, ["client_id", "rec_id"], [F.col(c).desc() for c in order_by])


def drop_dismissed(items: DataFrame, feedback: DataFrame) -> DataFrame:
    """Leave out dismissed items.

    An anti join would be pushed below the union of item kinds and read the feedback once per kind.
    """
    dismissed = feedback.where("status = 'dismissed'").select("client_id", "rec_id").distinct()
    marked = dismissed.withColumn("_dismissed", F.lit(True))
    return items.join(marked, ["client_id", "rec_id"], "left").where("_dismissed is null").drop("_dismissed")


def choose(items: DataFrame, n: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """The first `n` items in order of preference, then ranked by saving."""
    kept = best_rows(items, ["client_id"], [F.col("preference")], n)
    order = [F.col("estimated_monthly_savings_usd").desc(), F.col("preference")]
    return ranked(kept, ["client_id"], order, n)


def open_items(items: DataFrame, changes: DataFrame, order_by: list[str]) -> DataFrame:
    """Items whose last entry in the feedback log does not dismiss them.

    Only entries on these items, a handful per client, are looked at; the log as a whole is neither ranked nor sorted.
    """
    keys = ["client_id", "rec_id"]
    own = items.select(*keys)
    entries = changes.join(own, keys, "left_semi").groupBy(*keys).agg(F.max_by("status", F.struct(*order_by)).alias("_status"))
    return items.join(entries, keys, "left").where("_status is null or _status <> 'dismissed'").drop("_status")


def items_of(rollup: DataFrame) -> DataFrame:
    """All candidate items of a stored rollup, at most six per client, stored."""
    return cut_lineage(subscription_items(recurring_of(rollup)).unionByName(cutback_items(categories_of(rollup))))


def recommendations(
    tx: DataFrame,
    as_of: AsOf,
    feedback: DataFrame | None = None,
    n: int = MAX_RECOMMENDATIONS,
    order_by: list[str] | None = None,
) -> DataFrame:
    """At most `n` items per client: the top subscription first, then category cutbacks.

    If the top subscription is dismissed the next one is not tried. `tx` carries `category` and
    `is_discretionary`. `feedback` holds the current status per item, or, with `order_by`, all entries in the order of these
    columns. The transactions are read once, for a rollup that is stored and read by both kinds of items.
    """
    return choose_open(items_of(cut_lineage(spending_rollup(tx, as_of))), feedback, n, order_by)


def choose_open(items: DataFrame, feedback: DataFrame | None, n: int = MAX_RECOMMENDATIONS, order_by: list[str] | None = None) -> DataFrame:
    """The chosen of the items that are not dismissed."""
    if feedback is not None:
        items = open_items(items, feedback, order_by) if order_by else drop_dismissed(items, feedback)
    return choose(items, n)
