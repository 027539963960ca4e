import hashlib

import pytest

from spendkit.operators import recommend

AS_OF = "2011-06-15"


def sid(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


SUBS = [(1, f"2011-0{m}-05 10:00", 12.99, "MERCH_SUB", "Subscriptions") for m in (2, 3, 4, 5)]
DINING = [
    (1, "2011-04-10 10:00", 80, "A", "Dining"), (1, "2011-05-10 10:00", 90, "A", "Dining"),
    (1, "2011-06-10 10:00", 100, "A", "Dining"), (1, "2011-06-11 10:00", 40, "B", "Dining"),
]


def test_recurring(make_tx):
    rows = {r.merchant_id: r for r in recommend.recurring_merchants(make_tx(*SUBS, *DINING), AS_OF).collect()}
    assert set(rows) == {"MERCH_SUB", "A"}
    sub = rows["MERCH_SUB"]
    assert (sub.active_months, sub.avg_monthly_spend_usd, sub.is_subscription, sub.cv_monthly_spend) == (4, 12.99, True, 0.0)
    assert not rows["A"].is_subscription


@pytest.mark.parametrize("rows", [
    SUBS[:2],                                                                        # two months
    [(1, f"2011-0{m}-05 10:00", 9.5, "m", "Subscriptions") for m in (3, 4, 5)],        # below $10
    [(1, f"2011-0{m}-05 10:00", a, "m", "Subscriptions") for m, a in ((3, 1), (4, 1), (5, 100))],  # unsteady
    [(1, f"2010-0{m}-05 10:00", 20, "m", "Subscriptions") for m in (3, 4, 5)],         # too old
    [(1, f"2011-0{m}-05 10:00", 20, None, "Subscriptions") for m in (3, 4, 5)],        # no merchant
])
def test_not_recurring(make_tx, rows):
    assert recommend.recurring_merchants(make_tx(*rows), AS_OF).count() == 0


def test_window_ends_at_midnight(make_tx):
    tx = make_tx(*DINING[:1], (1, "2011-06-15 00:01", 500, "C", "Dining"), (1, "2011-06-15 00:00", 1, "A", "Dining"))
    hit = recommend.top_category_merchants(tx, AS_OF).first()
    assert float(hit.category_spend_usd) == 81.0


def test_top_category(make_tx):
    hit = recommend.top_category_merchants(make_tx(*SUBS, *DINING), AS_OF).where("category_rank = 1").first()
    assert (hit.category, hit.merchant_id, float(hit.merchant_spend_usd), float(hit.category_spend_usd)) == ("Dining", "A", 270.0, 310.0)
    assert abs(hit.estimated_monthly_savings_usd - 13.5) < 1e-9


def test_missing_merchant_counts_for_the_category_only(make_tx):
    tx = make_tx((1, "2011-06-01 10:00", 500, None, "Dining"), (1, "2011-06-01 10:00", 5, "A", "Dining"), (2, "2011-06-01 10:00", 5, None, "Dining"))
    hits = recommend.top_category_merchants(tx, AS_OF).collect()
    assert [(h.client_id, h.merchant_id, float(h.category_spend_usd)) for h in hits] == [(1, "A", 505.0)]


FIVE = [
    (1, "2011-06-01 10:00", 500, "A", "Dining"), (1, "2011-06-01 10:00", 400, "B", "Entertainment"),
    (1, "2011-06-01 10:00", 300, "C", "Shopping"), (1, "2011-06-01 10:00", 200, "D", "Subscriptions"),
]


def test_walk_visits_every_other_category(make_tx):
    rows = recommend.recommendations(make_tx(*FIVE), AS_OF).orderBy("rank").collect()
    assert [r.meta.category for r in rows] == ["Dining", "Shopping"]


def test_dismissal_moves_on_within_the_walk(spark, make_tx):
    gone = sid("cutback_top_category_merchant", "1", "Dining", "A")
    fb = spark.createDataFrame([(1, gone, "dismissed")], "client_id long, rec_id string, status string")
    rows = recommend.recommendations(make_tx(*FIVE), AS_OF, fb).collect()
    assert [r.meta.category for r in rows] == ["Shopping"]


def test_texts_and_order(make_tx):
    rows = recommend.recommendations(make_tx(*SUBS, *DINING), AS_OF).orderBy("rank").collect()
    assert [r.rule for r in rows] == ["cutback_top_category_merchant", "recurring_subscription"]
    cut, sub = rows
    assert sub.rec_id == sid("recurring_subscription", "1", "MERCH_SUB")
    assert sub.action == "Cancel, pause, or downgrade merchant `MERCH_SUB` (~$12.99/mo)."
    assert sub.rationale == "This merchant shows recurring monthly spend across 4 month(s)."
    assert cut.title == "Cut Dining spend at your top merchant"
    assert cut.action == "Reduce visits or ticket size at `A / Town / ST` (~$90.00/mo in Dining)."
    assert cut.rationale == (
        "In the last ~90 days, `Dining` is a top discretionary category ($310.00). "
        "Merchant `A` alone is $270.00 (87% of that category)."
    )
    assert cut.estimated_monthly_savings_usd > sub.estimated_monthly_savings_usd


def test_dismissed_subscription_is_not_replaced(spark, make_tx):
    second = [(1, f"2011-0{m}-06 10:00", 11, "SUB2", "Subscriptions") for m in (2, 3, 4, 5)]
    fb = spark.createDataFrame([(1, sid("recurring_subscription", "1", "MERCH_SUB"), "dismissed")], "client_id long, rec_id string, status string")
    rows = recommend.recommendations(make_tx(*SUBS, *second, *DINING), AS_OF, fb).collect()
    assert {r.rule for r in rows} == {"cutback_top_category_merchant"}


def test_feedback_last_entry_wins(spark):
    fb = spark.createDataFrame(
        [(1, "r", "dismissed", 1), (1, "r", "accepted", 2), (2, "r", "dismissed", 1)], "client_id long, rec_id string, status string, seq int"
    )
    last = recommend.latest_feedback(fb, ["seq"])
    assert {(r.client_id, r.status) for r in last.collect()} == {(1, "accepted"), (2, "dismissed")}
    items = spark.createDataFrame([(1, "r"), (2, "r")], "client_id long, rec_id string")
    assert [r.client_id for r in recommend.drop_dismissed(items, last).collect()] == [1]


def test_date_per_client(spark, make_tx):
    from datetime import date

    as_of = spark.createDataFrame([(1, date(2011, 6, 15))], "client_id long, as_of date")
    tx = make_tx(*SUBS, *DINING, (2, "2011-06-01 10:00", 5, "A", "Dining"))
    assert {r.client_id for r in recommend.recommendations(tx, as_of).collect()} == {1}
