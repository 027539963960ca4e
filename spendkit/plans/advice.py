"""Queries over recommendations, notifications and coach answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, coach, notify, recommend, rollup, spend
from ..session import cut_lineage
from .registry import big, dbl, query
from .spending import _budget, budget_of_month, daily_rollup, forecasts, runway_of_month
from .views import AS_OF, LATE_AS_OF, Views


@query("recurring_merchants", """
    SELECT client_id, merchant_id, active_months, round(avg_m, 4) AS avg_monthly, CAST(total AS DOUBLE) AS total,
           round(std_m, 4) AS std_monthly, round(cv, 6) AS cv, is_subscription FROM recurring""")
def recurring_merchants(v: Views):
    return recommend.recurring_merchants(v.categorised(), AS_OF).select(
        "client_id", "merchant_id", "active_months", dbl("avg_monthly_spend_usd", "avg_monthly", 4),
        dbl("total_spend_usd", "total"), dbl("std_monthly_spend_usd", "std_monthly", 4),
        dbl("cv_monthly_spend", "cv", 6), "is_subscription")


@query("top_category_merchant", """
    SELECT client_id, category, category_rank, merchant_id, city AS merchant_city, state AS merchant_state,
           CAST(category_spend AS DOUBLE) AS category_spend, CAST(merchant_spend AS DOUBLE) AS merchant_spend,
           round(CAST(merchant_spend AS DOUBLE) / CAST(category_spend AS DOUBLE), 6) AS share,
           round(0.15 * (CAST(merchant_spend AS DOUBLE) / 3.0), 4) AS saving FROM hits""")
def top_category_merchant(v: Views):
    return recommend.top_category_merchants(v.categorised(place=True), AS_OF).select(
        "client_id", "category", big("category_rank"), "merchant_id", "merchant_city", "merchant_state",
        dbl("category_spend_usd", "category_spend"), dbl("merchant_spend_usd", "merchant_spend"),
        dbl("merchant_share_of_category", "share", 6), dbl("estimated_monthly_savings_usd", "saving", 4))


@query("subscription_recs", """
    SELECT client_id, rec_id, title, merchant_id, round(saving, 4) AS saving, rule FROM items WHERE preference = 0""")
def subscription_recs(v: Views):
    return recommend.subscription_items(recommend.recurring_merchants(v.categorised(), AS_OF)).select(
        "client_id", "rec_id", "title", F.col("meta.merchant_id").alias("merchant_id"),
        dbl("estimated_monthly_savings_usd", "saving", 4), "rule")


@query("cutback_recs", """
    SELECT client_id, rec_id, title, action, category, round(saving, 4) AS saving, preference FROM items WHERE preference > 0""")
def cutback_recs(v: Views):
    return recommend.cutback_items(recommend.top_category_merchants(v.categorised(place=True), AS_OF)).select(
        "client_id", "rec_id", "title", "action", F.col("meta.category").alias("category"),
        dbl("estimated_monthly_savings_usd", "saving", 4), big("preference"))


def _feedback(v: Views):
    return recommend.latest_feedback(v.feedback(), ["transaction_dt", "id"])


@query("feedback_latest", "SELECT client_id, rec_id, status FROM last_feedback")
def feedback_latest(v: Views):
    return _feedback(v).select("client_id", "rec_id", "status")


@query("recs_after_feedback", "SELECT client_id, rec_id, rule, preference FROM open_items")
def recs_after_feedback(v: Views):
    items = recommend.items_of(cut_lineage(recommend.spending_rollup(v.categorised(place=True), AS_OF)))
    return recommend.open_items(items, v.feedback(), ["transaction_dt", "id"]).select("client_id", "rec_id", "rule", big("preference"))


def _recommendations(v: Views):
    return recommend.recommendations(v.categorised(place=True), AS_OF, v.feedback(), order_by=["transaction_dt", "id"])


@query("recommendations", "SELECT client_id, rec_id, title, rule, round(saving, 4) AS saving, rank FROM recs")
def recommendations(v: Views):
    return _recommendations(v).select(
        "client_id", "rec_id", "title", "rule", dbl("estimated_monthly_savings_usd", "saving", 4), big("rank"))


@query("recommendations_at_last_date", "SELECT client_id, rec_id, title, rule, round(saving, 4) AS saving, rank FROM recs_last")
def recommendations_at_last_date(v: Views):
    """Each client as of the day of its last transaction."""
    tx = v.categorised(place=True)
    return recommend.recommendations(tx, spend.default_as_of(tx)).select(
        "client_id", "rec_id", "title", "rule", dbl("estimated_monthly_savings_usd", "saving", 4), big("rank"))


@query("crossed_thresholds", """
    SELECT client_id, round(util, 6) AS utilization, CAST(coalesce(util >= 0.7, FALSE) AS BIGINT) + CAST(coalesce(util >= 0.85, FALSE) AS BIGINT)
             + CAST(coalesce(util >= 0.95, FALSE) AS BIGINT) AS n_crossed,
           CAST(CASE WHEN util >= 0.95 THEN 0.95 WHEN util >= 0.85 THEN 0.85 WHEN util >= 0.7 THEN 0.7 END AS DOUBLE) AS highest FROM budget""")
def crossed_thresholds(v: Views):
    hit = notify.crossed_thresholds(F.col("utilization_pct"))
    return _budget(v).select(
        "client_id", dbl("utilization_pct", "utilization", 6), F.size(hit).cast("bigint").alias("n_crossed"),
        F.array_max(hit).alias("highest"))


def _inputs(v: Views, as_of: str = AS_OF):
    """Budget and forecast from one stored rollup."""
    days = daily_rollup(v)
    return notify.notification_inputs(rollup.budget_days(days, v.limits(), as_of, as_of), forecasts(v, as_of, days))


@query("notification_inputs", """
    SELECT client_id, as_of_date, round(util, 6) AS utilization, round(projected, 4) AS projected, mtd_spend, limit_usd,
           round(remaining, 4) AS remaining, days, risk FROM inputs""")
def notification_inputs(v: Views):
    return _inputs(v).select(
        "client_id", "as_of_date", dbl("utilization_pct", "utilization", 6), dbl("projected_utilization_pct", "projected", 4),
        F.col("mtd_spend_usd").alias("mtd_spend"), F.col("monthly_limit_usd").alias("limit_usd"),
        dbl("remaining_budget_usd", "remaining", 4), F.col("days_to_limit_estimate").alias("days"),
        F.col("overspend_risk").alias("risk"))


_STEPS = "(SELECT unnest([0.7, 0.85, 0.95]) AS thr) t"


@query("threshold_status", f"""
    SELECT client_id, CAST(thr AS DOUBLE) AS threshold_pct, CAST(CAST(round(thr * 100) AS INTEGER) AS VARCHAR) || '%' AS label,
           CASE WHEN util >= thr THEN 'crossed' WHEN projected >= thr THEN 'projected' ELSE 'ok' END AS status,
           coalesce(util >= thr, FALSE) AS mtd_hit, coalesce(projected >= thr, FALSE) AS projected_hit
    FROM inputs CROSS JOIN {_STEPS}""")
def threshold_status(v: Views):
    return notify.threshold_status(_inputs(v)).select("client_id", "threshold_pct", "label", "status", "mtd_hit", "projected_hit")


_THRESHOLD_EVENTS = f"""
    SELECT substr(sha256('threshold|' || client_id || '|2000-06-15|' || format('{{:.2f}}', CAST(thr AS DOUBLE))), 1, 16) AS event_id, client_id,
           'budget_threshold' AS kind, CASE WHEN thr >= 0.95 THEN 'critical' WHEN thr >= 0.85 THEN 'warning' ELSE 'info' END AS severity,
           CASE WHEN util >= thr THEN 'Past ' ELSE 'Projected to pass ' END || CAST(round(thr * 100) AS INTEGER) || '% budget threshold' AS title,
           CAST(thr AS DOUBLE) AS threshold_pct
    FROM inputs CROSS JOIN {_STEPS} WHERE util >= thr OR projected >= thr"""
_OVERSPEND_EVENTS = """
    SELECT substr(sha256('warning|overspend|' || client_id || '|2000-06-15'), 1, 16) AS event_id, client_id, 'warning' AS kind,
           'critical' AS severity, 'Projected to exceed your discretionary limit' AS title, CAST(NULL AS DOUBLE) AS threshold_pct
    FROM inputs WHERE risk OR projected >= 1.0"""
_RUNWAY_EVENTS = """
    SELECT substr(sha256('warning|runway|' || client_id || '|2000-06-15'), 1, 16) AS event_id, client_id, 'warning' AS kind,
           'warning' AS severity, 'Only ' || days || ' day(s) of discretionary runway left' AS title, CAST(NULL AS DOUBLE) AS threshold_pct
    FROM inputs WHERE NOT (risk OR coalesce(projected >= 1.0, FALSE)) AND days BETWEEN 0 AND 7"""
_TIP_EVENTS = """
    SELECT substr(sha256('tip|' || i.client_id || '|2000-06-15|' || r.title), 1, 16) AS event_id, i.client_id, 'tip' AS kind,
           'info' AS severity, 'Personalized tip' AS title, CAST(NULL AS DOUBLE) AS threshold_pct
    FROM inputs i JOIN recs r ON i.client_id = r.client_id WHERE r.rank = 1"""
_EVENT = ["event_id", "client_id", "kind", "severity", "title", "threshold_pct"]


@query("threshold_events", _THRESHOLD_EVENTS)
def threshold_events(v: Views):
    return notify.threshold_events(_inputs(v)).select(*_EVENT)


@query("threshold_messages", f"""
    SELECT client_id, CAST(thr AS DOUBLE) AS threshold_pct,
           CASE WHEN util >= thr
                THEN 'You have passed the ' || pct || ' discretionary budget threshold. As of 2000-06-15, month-to-date spend is '
                     || spent || ' Remaining budget: ' || coalesce('$' || format('{{:,.2f}}', round(remaining, 2)), 'N/A') || '.'
                ELSE 'Projected month-end utilization (' || format('{{:.0f}}', projected * 100) || '%) is at or above the ' || pct
                     || ' threshold. MTD spend is currently ' || spent END AS message
    FROM (SELECT *, CAST(round(thr * 100) AS INTEGER) || '%' AS pct,
                 '$' || format('{{:,.2f}}', mtd_spend) || ' of $' || format('{{:,.2f}}', limit_usd) || ' (' || format('{{:.0f}}', util * 100) || '% utilization).' AS spent
          FROM inputs CROSS JOIN {_STEPS} WHERE util >= thr OR projected >= thr)""")
def threshold_messages(v: Views):
    return notify.threshold_events(_inputs(v)).select("client_id", "threshold_pct", "message")


@query("overspend_events", _OVERSPEND_EVENTS)
def overspend_events(v: Views):
    return notify.overspend_events(_inputs(v)).select(*_EVENT)


@query("runway_events", _RUNWAY_EVENTS.replace("FROM inputs", "FROM inputs_late").replace("2000-06-15", LATE_AS_OF))
def runway_events(v: Views):
    return notify.runway_events(_inputs(v, LATE_AS_OF)).select(*_EVENT)


@query("tip_events", _TIP_EVENTS)
def tip_events(v: Views):
    return notify.tip_events(_inputs(v), _recommendations(v)).select(*_EVENT)


def _events(v: Views):
    return notify.notifications(_inputs(v), _recommendations(v))


_ALL_EVENTS = f"""
    SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
             coalesce(threshold_pct, 0) DESC, kind, title) AS display_rank
    FROM ({_THRESHOLD_EVENTS} UNION ALL {_OVERSPEND_EVENTS} UNION ALL {_RUNWAY_EVENTS} UNION ALL {_TIP_EVENTS})"""


@query("notifications", f"SELECT event_id, client_id, kind, severity, title, threshold_pct, display_rank FROM ({_ALL_EVENTS})")
def notifications(v: Views):
    return _events(v).select(*_EVENT, big("display_rank"))


_EACH_DAY = " UNION ALL ".join(
    sql.replace("FROM inputs", "FROM inputs_each").replace("|2000-06-15", "|' || as_of_date || '").replace("client_id,", "client_id, as_of_date,", 1)
    for sql in (_THRESHOLD_EVENTS, _OVERSPEND_EVENTS, _RUNWAY_EVENTS)
)


@query("events_each_day", f"""
    SELECT *, row_number() OVER (PARTITION BY client_id, as_of_date ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
             coalesce(threshold_pct, 0) DESC, kind, title) AS display_rank
    FROM ({_EACH_DAY})""")
def events_each_day(v: Views):
    """Events of every day of a month, from one read of the transactions."""
    days = daily_rollup(v)
    inputs = notify.notification_inputs(budget_of_month(v, days), runway_of_month(v, days).where("status = 'scored'"), per_day=True)
    return notify.notifications(inputs).select("as_of_date", *_EVENT, big("display_rank"))


@query("channel_events", f"""
    SELECT event_id, client_id, kind, channel FROM ({_ALL_EVENTS}) CROSS JOIN (SELECT unnest(['app', 'email']) AS channel) c""")
def channel_events(v: Views):
    return notify.channel_events(_events(v)).select("event_id", "client_id", "kind", "channel")


def _context(v: Views):
    days = daily_rollup(v)
    return coach.coach_context(rollup.budget_days(days, v.limits(), AS_OF, AS_OF), forecasts(v, AS_OF, days))


@query("coach_context", """
    SELECT client_id, as_of_date, mtd, lim, remaining, round(util, 6) AS util, round(predicted, 2) AS predicted,
           round(projected, 4) AS projected FROM context""")
def coach_context(v: Views):
    return _context(v).select(
        "client_id", "as_of_date", dbl(coach.MTD, "mtd"), dbl(budget.LIMIT, "lim"), dbl("remaining_budget_usd", "remaining"),
        dbl("utilization_pct", "util", 6), dbl(coach.PREDICTED, "predicted", 2), dbl("projected_utilization_pct", "projected", 4))


@query("coach_intent", """
    SELECT client_id, question_id, amount AS purchase_usd, is_empty, is_amount_only, is_affordability FROM intents""")
def coach_intent(v: Views):
    asked = v.questions().join(coach.last_assistant_turn(coach.valid_turns(v.turns())), "client_id", "left")
    return coach.question_intent(asked).select(
        "client_id", "question_id", "purchase_usd", "is_empty", "is_amount_only", "is_affordability")


@query("affordability", """
    SELECT client_id, question_id, amount AS purchase_usd, after AS remaining_after_usd,
           CASE WHEN remaining < 0 THEN 'over_limit' WHEN after < 0 THEN 'would_exceed' ELSE 'affordable' END AS verdict
    FROM answers WHERE route = 'affordability'""")
def affordability(v: Views):
    answered = coach.answer_questions(v.questions(), _context(v), v.turns())
    return answered.where("route = 'affordability'").select(
        "client_id", "question_id", "purchase_usd", "remaining_after_usd", "verdict")


_SUMMARY = """'LLM chat is unavailable (missing API key or disabled). Here’s what I can compute:' || chr(10) || chr(10)
    || '- As of 2000-06-15, MTD discretionary spend is $' || format('{:,.2f}', mtd) || chr(10)
    || '- Monthly limit is $' || format('{:,.2f}', lim) || chr(10)
    || '- Remaining budget is $' || format('{:,.2f}', remaining) || chr(10)
    || 'Ask: “Can I afford $X today?” for a deterministic answer.'"""


@query("coach_fallback", f"SELECT client_id, {_SUMMARY} AS answer FROM context")
def coach_fallback(v: Views):
    return _context(v).select("client_id", coach.summary_reply().alias("answer"))


@query("coach_answers", f"""
    SELECT client_id, question_id, replace(route, 'other', 'fallback') AS route,
           CASE route WHEN 'empty' THEN 'Ask a question about your discretionary spending.'
             WHEN 'no_context' THEN 'No monthly limit is known for you, so there is no budget to answer from.'
             WHEN 'other' THEN {_SUMMARY}
             ELSE CASE WHEN remaining < 0 THEN 'No. You are already over your discretionary limit.' || chr(10) || chr(10)
                       || '- Remaining budget: $' || format('{{:,.2f}}', remaining) || chr(10) || '- If you spend $'
                       || format('{{:,.2f}}', amount) || ' now: $' || format('{{:,.2f}}', after)
                  ELSE CASE WHEN after < 0 THEN 'No' ELSE 'Yes' END || '. If you spend $' || format('{{:,.2f}}', amount)
                       || ' now, your remaining discretionary budget becomes $' || format('{{:,.2f}}', after)
                       || ' (current remaining: $' || format('{{:,.2f}}', remaining) || ').' END END AS answer
    FROM answers""".replace("{{", "{").replace("}}", "}"))
def coach_answers(v: Views):
    answered = coach.answer_questions(v.questions(), _context(v), v.turns())
    return answered.select("client_id", "question_id", "route", "answer")


@query("coach_requests", """
    SELECT client_id, question_id, trim(question) AS asked, coalesce(said, '') AS history, CAST(mtd AS DOUBLE) AS mtd,
           CAST(lim AS DOUBLE) AS lim, remaining, round(util, 6) AS util, round(predicted, 2) AS predicted,
           round(projected, 4) AS projected, as_of_date::VARCHAR AS as_of, 7 AS n_required
    FROM answers LEFT JOIN (
      SELECT client_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS said FROM (
        SELECT * FROM turns WHERE role IN ('user', 'assistant') AND content IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY turn DESC) <= 10) GROUP BY 1) USING (client_id)
    WHERE route = 'other'""")
def coach_requests(v: Views):
    answered = coach.answer_questions(v.questions(), _context(v), v.turns(), model_available=True)
    numbers = (coach.MTD, budget.LIMIT, "remaining_budget_usd", "utilization_pct", coach.PREDICTED, "projected_utilization_pct")
    context = ",".join(["as_of_date:string", *(f"{n}:double" for n in numbers)])
    sent = F.from_json("payload", f"struct<question:string,required_fields:array<string>,context:struct<{context}>>")
    said = F.transform("history", lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    return coach.coach_requests(answered, v.turns()).select(
        "client_id", "question_id", sent["question"].alias("asked"), F.array_join(said, "\n").alias("history"),
        sent["context"][coach.MTD].alias("mtd"), sent["context"][budget.LIMIT].alias("lim"),
        sent["context"]["remaining_budget_usd"].alias("remaining"), F.round(sent["context"]["utilization_pct"], 6).alias("util"),
        F.round(sent["context"][coach.PREDICTED], 2).alias("predicted"),
        F.round(sent["context"]["projected_utilization_pct"], 4).alias("projected"),
        sent["context"]["as_of_date"].alias("as_of"), F.size(sent["required_fields"]).alias("n_required"))
