"""Budget alerts and tips per client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ALERT_CHANNELS, ALERT_THRESHOLDS, SHORT_RUNWAY_DAYS
from ..functions.identity import stable_id
from ..functions.money import money_label, percent_label
from .budget import LIMIT
from .common import AsOf, day_literal

MTD = "mtd_discretionary_spend_usd"


def crossed_thresholds(utilization: Column, thresholds=ALERT_THRESHOLDS) -> Column:
    """Thresholds reached, ascending, as an array; empty for null."""
    steps = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    return F.coalesce(F.filter(steps, lambda t: utilization >= t), F.array().cast("array<double>"))


def _or_else(first: Column, second: Column) -> Column:
    """`first` unless it is null or zero."""
    number = first.cast("double")
    return F.coalesce(F.when(number != 0, number), second.cast("double"))


def notification_inputs(budget: DataFrame, runway: DataFrame, as_of: AsOf | None = None, per_day: bool = False) -> DataFrame:
    """One row per client from budget and forecast; a zero in the budget falls through to the forecast.

    With `per_day` both hold several days of a client and a row is one client and day.
    """
    b = budget.select(
        "client_id", F.col("as_of_date").alias("b_day"), F.col("utilization_pct").alias("b_util"),
        F.col(MTD).alias("b_mtd"), F.col(LIMIT).alias("b_limit"),
    )
    p = runway.select(
        "client_id", F.col("as_of_date").alias("p_day"), F.col(MTD).alias("p_mtd"),
        F.col(LIMIT).alias("p_limit"), "projected_utilization_pct", "remaining_budget_usd",
        "days_to_limit_estimate", "overspend_risk",
    )
    day = F.coalesce("b_day", "p_day")
    if per_day:
        joined = b.withColumn("_day", F.col("b_day")).join(p.withColumn("_day", F.col("p_day")), ["client_id", "_day"], "full")
    else:
        joined = b.join(p, "client_id", "full")
    if isinstance(as_of, DataFrame):
        joined = joined.join(as_of.select("client_id", F.to_date("as_of").alias("g_day")), "client_id", "left")
        day = F.coalesce("g_day", day)
    elif as_of is not None:
        day = day_literal(as_of)
    return joined.select(
        "client_id",
        day.alias("as_of_date"),
        F.col("b_util").cast("double").alias("utilization_pct"),
        F.col("projected_utilization_pct").cast("double").alias("projected_utilization_pct"),
        _or_else(F.col("b_mtd"), F.col("p_mtd")).alias("mtd_spend_usd"),
        _or_else(F.col("b_limit"), F.col("p_limit")).alias("monthly_limit_usd"),
        F.col("remaining_budget_usd").cast("double").alias("remaining_budget_usd"),
        F.col("days_to_limit_estimate").cast("bigint").alias("days_to_limit_estimate"),
        F.coalesce("overspend_risk", F.lit(False)).alias("overspend_risk"),
    )


def threshold_status(inputs: DataFrame, thresholds=ALERT_THRESHOLDS) -> DataFrame:
    """One row per client and threshold: crossed, projected or ok."""
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    thr = F.col("threshold_pct")
    rows = inputs.withColumn("threshold_pct", F.explode(steps)).withColumns(
        {
            "mtd_hit": F.coalesce(F.col("utilization_pct") >= thr, F.lit(False)),
            "projected_hit": F.coalesce(F.col("projected_utilization_pct") >= thr, F.lit(False)),
        }
    )
    status = F.when(F.col("mtd_hit"), "crossed").when(F.col("projected_hit"), "projected").otherwise("ok")
    return rows.withColumn("label", percent_label(thr)).withColumn("status", status)


_EVENT_TYPE = (
    "struct<severity_no:int,minus_threshold:double,kind:string,title:string,event_id:string,"
    "severity:string,message:string,threshold_pct:double>"
)
_SEVERITIES = ("critical", "warning", "info")


def _day() -> Column:
    return F.col("as_of_date").cast("string")


def _used(c: str) -> Column:
    return percent_label(F.coalesce(F.col(c), F.lit(0.0)))


def _event(kind, severity, title, message, id_parts, threshold=None) -> Column:
    """One event; its first fields are the display order."""
    thr = F.lit(threshold).cast("double")
    return F.struct(
        F.lit(_SEVERITIES.index(severity)), -F.coalesce(thr, F.lit(0.0)), F.lit(kind), title,
        stable_id(*id_parts), F.lit(severity), message, thr,
    ).cast(_EVENT_TYPE)


def _threshold_event(threshold: float) -> Column:
    """Reached by spend or, failing that, by the projection."""
    severity = "critical" if threshold >= 0.95 else "warning" if threshold >= 0.85 else "info"
    label = percent_label(F.lit(threshold))
    passed = F.coalesce(F.col("utilization_pct") >= threshold, F.lit(False))
    ahead = F.coalesce(F.col("projected_utilization_pct") >= threshold, F.lit(False))
    of_limit = F.concat(
        money_label(F.col("mtd_spend_usd")), F.lit(" of "), money_label(F.col("monthly_limit_usd")),
        F.lit(" ("), _used("utilization_pct"), F.lit(" utilization)."),
    )
    # Fixed texts.
    title = F.concat(F.when(passed, "Past ").otherwise("Projected to pass "), label, F.lit(" budget threshold"))
    past = F.concat(
        F.lit("You have passed the "), label, F.lit(" discretionary budget threshold. As of "), _day(),
        F.lit(", month-to-date spend is "), of_limit, F.lit(" Remaining budget: "),
        money_label(F.col("remaining_budget_usd")), F.lit("."),
    )
    projected = F.concat(
        F.lit("Projected month-end utilization ("), _used("projected_utilization_pct"),
        F.lit(") is at or above the "), label, F.lit(" threshold. MTD spend is currently "), of_limit,
    )
    id_parts = (F.lit("threshold"), F.col("client_id"), _day(), F.lit(f"{threshold:.2f}"))
    message = F.when(passed, past).otherwise(projected)
    return F.when(passed | ahead, _event("budget_threshold", severity, title, message, id_parts, threshold))


def _overspends() -> Column:
    return F.col("overspend_risk") | F.coalesce(F.col("projected_utilization_pct") >= 1.0, F.lit(False))


def _overspend_event() -> Column:
    # Fixed texts.
    title = F.lit("Projected to exceed your discretionary limit")
    message = F.concat(
        F.lit("Projected month-end utilization is "), _used("projected_utilization_pct"),
        F.lit(". Consider cutting discretionary spend before month end."),
    )
    id_parts = (F.lit("warning"), F.lit("overspend"), F.col("client_id"), _day())
    return F.when(_overspends(), _event("warning", "critical", title, message, id_parts))


def _runway_event() -> Column:
    days = F.col("days_to_limit_estimate")
    # Fixed texts.
    title = F.concat(F.lit("Only "), days.cast("string"), F.lit(" day(s) of discretionary runway left"))
    message = F.concat(
        F.lit("At the current pace you may hit your limit in about "), days.cast("string"),
        F.lit(" day(s). Remaining budget: "), money_label(F.col("remaining_budget_usd")), F.lit("."),
    )
    id_parts = (F.lit("warning"), F.lit("runway"), F.col("client_id"), _day())
    short = ~_overspends() & days.between(0, SHORT_RUNWAY_DAYS)
    return F.when(short, _event("warning", "warning", title, message, id_parts))


def _tip_event() -> Column:
    title = F.lit("Personalized tip")
    message = F.concat_ws(" — ", "tip_title", "tip_action")
    id_parts = (F.lit("tip"), F.col("client_id"), _day(), F.col("tip_title"))
    return F.when(F.col("tip_title").isNotNull(), _event("tip", "info", title, message, id_parts))


def _expand(inputs: DataFrame, events: list[Column]) -> DataFrame:
    """Rows of `inputs` to rows of events, in display order, without a shuffle."""
    ordered = F.array_sort(F.array_compact(F.array(*events)))
    return (
        inputs.select("client_id", "as_of_date", "utilization_pct", "projected_utilization_pct",
                      F.posexplode(ordered).alias("_pos", "e"))
        .select(
            "e.event_id", "client_id", "as_of_date", "e.kind", "e.severity", "e.title", "e.message",
            "e.threshold_pct", "utilization_pct", "projected_utilization_pct",
            (F.col("_pos") + 1).alias("display_rank"),
        )
    )


def _with_tip(inputs: DataFrame, recommendations: DataFrame) -> DataFrame:
    top = recommendations.where("rank = 1 and title <> ''").select(
        "client_id", F.col("title").alias("tip_title"), F.nullif(F.col("action"), F.lit("")).alias("tip_action")
    )
    return inputs.join(top, "client_id", "left")


def threshold_events(inputs: DataFrame, thresholds=ALERT_THRESHOLDS) -> DataFrame:
    """An event per threshold that spend or projection has reached."""
    return _expand(inputs, [_threshold_event(t) for t in thresholds])


def overspend_events(inputs: DataFrame) -> DataFrame:
    """A critical warning where the forecast is above the limit."""
    return _expand(inputs, [_overspend_event()])


def runway_events(inputs: DataFrame) -> DataFrame:
    """Short runway, for clients without an overspend warning."""
    return _expand(inputs, [_runway_event()])


def tip_events(inputs: DataFrame, recommendations: DataFrame) -> DataFrame:
    """The top recommendation of each client as a tip."""
    return _expand(_with_tip(inputs, recommendations), [_tip_event()])


def notifications(
    inputs: DataFrame,
    recommendations: DataFrame | None = None,
    thresholds=ALERT_THRESHOLDS,
    channels=ALERT_CHANNELS,
) -> DataFrame:
    """All events of every client, ordered by severity, threshold, kind and title.

    Each input row yields its events in place, so inputs and recommendations are computed once.
    """
    events = [*[_threshold_event(t) for t in thresholds], _overspend_event(), _runway_event()]
    if recommendations is not None:
        inputs = _with_tip(inputs, recommendations)
        events.append(_tip_event())
    return _expand(inputs, events).withColumn("channels", F.array(*[F.lit(c) for c in channels]))


def channel_events(events: DataFrame) -> DataFrame:
    """One row per event and channel."""
    return events.withColumn("channel", F.explode("channels")).drop("channels")
