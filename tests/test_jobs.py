"""From raw files to events, over files on disk."""

import json
from datetime import date, timedelta

import pytest

from spendkit import jobs
from spendkit.operators import budget
from spendkit.sources import readers, writers

HEADER = "id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,merchant_state,zip,mcc,errors"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bank")
    rows, n = [HEADER], 0
    for client in (1, 2):
        for i in range(120):
            day = date(2010, 1, 1) + timedelta(days=i)
            for mcc, amount in (("5812", 10 + i % 5 + client), ("5411", 30), ("5311", 7 * client)):
                n += 1
                rows.append(f"{n},{day} 12:00:00,{client},c{client},${amount}.50,Swipe Transaction,m{mcc},Bronx,NY,10464.0,{mcc}.0,")
    (root / "tx.csv").write_text("\n".join(rows))
    (root / "users.csv").write_text('id,current_age,address,monthly_discretionary_limits\n1,33,"1 Main St","$400 "\n2,34,"2 Main St","$9,000 "\n')
    (root / "cards.csv").write_text("id,client_id,card_brand,card_number,cvv,has_chip,credit_limit,card_on_dark_web\nc1,1,Visa,4000,123,YES,$19110,No\n")
    (root / "mcc.json").write_text(json.dumps({"5812": "Eating Places and Restaurants", "5411": "Grocery Stores, Supermarkets", "5311": "Department Stores"}))
    jobs.clean(spark, *[str(root / f) for f in ("tx.csv", "users.csv", "cards.csv", "mcc.json")], str(root / "out"))
    return root


def test_clean(spark, stored):
    qa = spark.read.json(str(stored / "out" / "qa_report")).first()
    assert (qa.transactions_rows_total_scanned, qa.card_join_misses, qa.user_join_misses) == (720, 360, 0)
    assert jobs.load(spark, str(stored / "out" / "enriched")).count() == 720
    assert jobs.load(spark, str(stored / "out" / "enriched"), client_id=2).count() == 360


def test_train_score_and_alert(spark, stored):
    enriched, users = str(stored / "out" / "enriched"), str(stored / "users.csv")
    model = jobs.train(spark, enriched, users, str(stored / "out"))
    assert jobs.load_model(spark, str(stored / "out")) == model
    tx, limits = jobs.load(spark, enriched), budget.user_limits(readers.read_users(spark, users))
    out = jobs.alerts(tx, limits, "2010-04-20", model)
    runway = {r.client_id: r for r in out["runway"].collect()}
    assert {r.status for r in runway.values()} == {"scored"}
    assert runway[1].overspend_risk and not runway[2].overspend_risk
    events = {}
    for r in out["events"].orderBy("client_id", "display_rank").collect():
        events.setdefault(r.client_id, []).append((r.kind, r.severity))
    assert events[1][0] == ("budget_threshold", "critical") and ("warning", "critical") in events[1]
    assert events[2] == [("tip", "info")]
    assert out["recommendations"].count() >= 2 and out["coach_context"].count() == 2
    kept = jobs.store_alerts(tx, limits, "2010-04-20", model, str(stored / "out" / "alerts"))
    for name, table in kept.items():
        assert table.schema.names == out[name].schema.names and table.exceptAll(out[name]).count() == 0
        assert table.count() == out[name].count()
    writers.write_runway(out["runway"], model, str(stored / "out" / "runway"))
    assert spark.read.json(str(stored / "out" / "runway")).first().model_cutoff_day == model.metrics["cutoff_day"]


def test_labels_change_the_budget(spark, stored, tmp_path):
    enriched = str(stored / "out" / "enriched")
    labels = tmp_path / "labels.jsonl"
    labels.write_text("\n".join(json.dumps({"id": str(i), "category": "Healthcare", "source": "llm"}) for i in range(1, 721)))
    tx = jobs.load(spark, enriched, str(labels))
    limits = budget.user_limits(readers.read_users(spark, str(stored / "users.csv")))
    assert {float(r.mtd_discretionary_spend_usd) for r in budget.budget_utilization(tx, limits, "2010-04-20").collect()} == {0.0}


def test_analytics_tables(spark, stored, tmp_path):
    tx = jobs.load(spark, str(stored / "out" / "enriched"))
    limits = budget.user_limits(readers.read_users(spark, str(stored / "users.csv")))
    jobs.analytics(tx, limits, "2010-04-20", str(tmp_path))
    patterns = {r.client_id: r for r in spark.read.parquet(str(tmp_path / "spending_patterns")).collect()}
    assert sorted(patterns[1].by_month_usd) == ["2010-01", "2010-02", "2010-03", "2010-04"]
    assert len(patterns[1].avg_daily_spend_by_day_of_week_usd) == 7
    assert [m["rank"] for m in patterns[1].top_merchants_usd] == [1, 2, 3]
    record = spark.read.parquet(str(tmp_path / "budget_utilization")).where("client_id = 1").first()
    assert record.category_source_mix == {"mcc": 360} and str(record.run_date) == "2010-04-20"
    assert len(record.discretionary_categories) == 5


def test_labelling_run(spark, stored, tmp_path):
    from spendkit.operators import labeling

    def label(payload):
        rows = json.loads(payload)["transactions"]
        return json.dumps({"results": [
            {"id": r["id"], "category": "Travel" if r["mcc_code"] == "5311" else "Dining", "confidence": 0.9} for r in rows
        ]})

    def fail(payload):
        raise RuntimeError("quota")

    enriched, out = str(stored / "out" / "enriched"), str(tmp_path / "l")
    jobs.request_labels(spark, enriched, out)
    requests = spark.read.parquet(f"{out}/label_requests")
    assert [r.n_transactions for r in requests.collect()] == [3]

    failed = labeling.call_labeler(requests, fail)
    assert [r.payload for r in failed.collect()] == [None]
    jobs.apply_labels(spark, enriched, out, failed, str(tmp_path / "cache0"))
    report = spark.read.json(f"{out}/categorization_report").first()
    assert report.degraded_run and report.calls_made == report.call_failures == 1 and report.coverage_pct == 100.0
    assert spark.read.parquet(str(tmp_path / "cache0")).count() == 0

    jobs.apply_labels(spark, enriched, out, labeling.call_labeler(requests, label), str(tmp_path / "cache1"), model="stub")
    labels = spark.read.json(f"{out}/transaction_categories")
    assert {(r.category, r.source, r.model, r["count"]) for r in labels.groupBy("category", "source", "model").count().collect()} == {
        ("Travel", "llm", "stub", 240), ("Dining", "llm", "stub", 480)}
    assert spark.read.parquet(str(tmp_path / "cache1")).count() == 3
    tx = jobs.load(spark, enriched, f"{out}/transaction_categories")
    assert tx.where("category = 'Travel' and is_discretionary").count() == 240

    cheap = jobs.load(spark, enriched, profile_labels=f"{out}/profile_labels")
    columns = ["id", "category", "category_source", "is_discretionary"]
    assert cheap.select(columns).exceptAll(tx.select(columns)).count() == 0 and cheap.count() == tx.count()

    jobs.request_labels(spark, enriched, out, cache=str(tmp_path / "cache1"))
    assert spark.read.parquet(f"{out}/label_requests").count() == 0


def test_chat_model(spark):
    from spendkit.operators import coach

    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "client_id long, payload string")

    def chat(payload):
        if payload == "bad":
            raise RuntimeError("down")
        return payload.upper()

    assert {r.client_id: r.answer for r in coach.model_replies(rows, chat).collect()} == {1: "OK", 2: None}
