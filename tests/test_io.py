import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from spendkit.operators import budget, cleaning, coach, forecast, labeling, notify, recommend, spend
from spendkit.sources import readers, writers

HEADER = "id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,merchant_state,zip,mcc,errors"


def line(i, amount="$1.00", mcc="5812", city="Bronx", client="1"):
    return f"{i},2010-01-01 00:07:00,{client},c1,{amount},Swipe Transaction,m,{city},NY,10464.0,{mcc},"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "tx").mkdir()
    (tmp_path / "tx" / "a.csv").write_text("\n".join([HEADER, line(1, "$1.00"), line(2, city='"New, York"'), line(3, mcc="NA")]))
    (tmp_path / "tx" / "b.csv").write_text("\n".join([HEADER, line(1, "$9.00"), line("nan"), line("NULL")]))
    (tmp_path / "users.csv").write_text('id,current_age,address,birth_year,monthly_discretionary_limits\n1,33,"1 Main St",1970,"$1,755 "\n')
    (tmp_path / "cards.csv").write_text("id,client_id,card_brand,card_number,cvv,has_chip,credit_limit,card_on_dark_web\nc1,1,Visa,4000,123,YES,$19110,No\n")
    (tmp_path / "mcc.json").write_text(json.dumps({"5812": "Eating Places and Restaurants", "5411": "Grocery Stores"}, indent=1))
    return tmp_path


def cleaned(spark, files):
    return cleaning.clean_transactions(
        readers.read_transactions(spark, str(files / "tx")),
        readers.read_mcc(spark, str(files / "mcc.json")),
        cleaning.prepare_cards(readers.read_cards(spark, str(files / "cards.csv"))),
        cleaning.prepare_users(readers.read_users(spark, str(files / "users.csv"))),
        order_by=readers.SOURCE_ORDER,
    )


def test_csv_to_enriched(spark, files):
    rows = {r.id: r for r in cleaned(spark, files).collect()}
    assert set(rows) == {"1", "2", "3", None}
    assert rows["1"].amount_usd == Decimal("1.00")                   # the first file's copy
    assert rows["2"].merchant_city == "New, York" and rows["3"].mcc_description == "UNKNOWN_MCC"
    assert rows["2"].mcc_description == "Eating Places and Restaurants"
    assert rows["1"].monthly_discretionary_limit_usd == Decimal("1755.00") and rows["1"].has_chip


def test_readers_drop_card_and_address_data(spark, files):
    assert not {"card_number", "cvv"} & set(readers.read_cards(spark, str(files / "cards.csv")).columns)
    assert not {"address", "birth_year"} & set(readers.read_users(spark, str(files / "users.csv")).columns)


def test_first_row_in_file_order(spark, tmp_path):
    """Files of different size in many splits; the first row of the first file wins for every id."""
    for name, n in (("a", 500), ("b", 4000), ("c", 50)):
        rows = [line(i % 700, f"${ord(name)}.{i % 100:02d}") for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n".join([HEADER, *rows]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = readers.read_transactions(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 8
        got = {int(r.id): r.amount for r in cleaning.dedupe_by_id(raw, readers.SOURCE_ORDER).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {i: f"$97.{i % 100:02d}" if i < 500 else f"$98.{i % 100:02d}" for i in range(700)}
    assert got == want


def test_every_file_has_its_own_header(spark, tmp_path):
    """Columns in another order, a file with one more, an empty one and one with a byte order mark."""
    (tmp_path / "a.csv").write_text("\n".join([HEADER, line(1)]) + "\n")
    turned = lambda text: ",".join(reversed(text.split(",")))
    (tmp_path / "b.csv").write_text("\n".join([turned(HEADER), turned(line(2, "$2.00"))]) + "\n")
    (tmp_path / "c.csv").write_text("\n".join(["extra," + HEADER, "x," + line(3, "$3.00")]) + "\n")
    (tmp_path / "d.csv").write_text("\ufeff" + "\n".join([HEADER, line(4, "$4.00")]) + "\n")
    (tmp_path / "e.csv").write_text("")
    rows = {r.id: r for r in readers.read_transactions(spark, str(tmp_path)).collect()}
    assert {i: (r.amount, r.mcc, r.merchant_city, r.date) for i, r in rows.items()} == {
        str(k): (f"${k}.00", "5812", "Bronx", "2010-01-01 00:07:00") for k in range(1, 5)
    }
    (tmp_path / "f.csv").write_text("id,date\n5,x\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        readers.read_transactions(spark, str(tmp_path))


def jobs_of(spark, name, call):
    spark.sparkContext.setJobGroup(name, name)
    try:
        call()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    for n in (3, 200):
        (tmp_path / str(n)).mkdir()
        for k in range(n):
            (tmp_path / str(n) / f"{k:03d}.csv").write_text("\n".join([HEADER, line(k)]) + "\n")
    found = [jobs_of(spark, f"headers-{n}", lambda n=n: readers.read_transactions(spark, str(tmp_path / str(n)))) for n in (3, 200)]
    assert found[0] == found[1] <= 3
    assert readers.read_transactions(spark, str(tmp_path / "200")).count() == 200


def test_first_lines_stop_at_the_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(["head a", *["x" * 200] * 20_000]))
    (tmp_path / "b.csv").write_text("head b")
    (tmp_path / "c.csv").write_text("\nno head")
    (tmp_path / "d.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = readers.first_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["file"][-5:], r["line"]) for r in rows) == [("a.csv", "head a"), ("b.csv", "head b"), ("c.csv", "")]


def test_users_and_cards_in_files_of_different_headers(spark, tmp_path):
    for folder, texts in {
        "users": ["id,current_age,monthly_discretionary_limits\n1,33,$5\n", "monthly_discretionary_limits,id\n$7,2\n"],
        "cards": ["id,client_id,credit_limit\nc1,1,$5\n", "credit_limit,cvv,client_id,id\n$7,123,2,c2\n"],
    }.items():
        (tmp_path / folder).mkdir()
        for k, text in enumerate(texts):
            (tmp_path / folder / f"{k}.csv").write_text(text)
    users = readers.read_users(spark, str(tmp_path / "users")).collect()
    assert {(r.id, r.monthly_discretionary_limits, r.current_age) for r in users} == {("1", "$5", "33"), ("2", "$7", None)}
    cards = readers.read_cards(spark, str(tmp_path / "cards"))
    assert "cvv" not in cards.columns
    assert {(r.id, r.client_id, r.credit_limit) for r in cards.collect()} == {("c1", "1", "$5"), ("c2", "2", "$7")}


def test_missing_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,date\n1,x\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        readers.read_transactions(spark, str(tmp_path / "t.csv"))


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_enriched_round_trip(spark, files, tmp_path, fmt):
    out = str(tmp_path / "enriched")
    writers.write_enriched(cleaned(spark, files), out, fmt)
    writers.write_enriched(cleaned(spark, files), out, fmt)           # a second run replaces the first
    rows = readers.read_enriched(spark, out, fmt=fmt)
    assert rows.count() == 4 and rows.first().client_id == 1
    assert {r.transaction_dt for r in rows.collect()} == {datetime(2010, 1, 1, 0, 7)}
    assert readers.read_enriched(spark, out, client_id=2, fmt=fmt).count() == 0
    if fmt == "parquet":
        plan = readers.read_enriched(spark, out, client_id=1)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(client_id,1)" in plan


def test_json_has_plain_timestamps(spark, files, tmp_path):
    writers.write_client(cleaned(spark, files), "1", str(tmp_path / "one"))
    lines = [json.loads(x) for f in (tmp_path / "one").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 4 and lines[0]["transaction_dt"] == "2010-01-01 00:07:00"


def test_pii_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("1", "4000")], "id string, card_number string")
    with pytest.raises(ValueError, match="card_number"):
        writers.write_json(df, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="cvv"):
        writers.write_json(df.selectExpr("id", "struct(card_number as cvv) as s"), str(tmp_path / "x"))


def test_labels(spark, tmp_path):
    rows = ['{"id": "1", "category": "Travel", "source": "llm", "client_id": "7"}', "", '{"id": "1", "category": "Dining", "client_id": "7"}',
            '{"id": "2", "category": null}', '{"id": "3", "category": "Income", "client_id": "8"}']
    (tmp_path / "labels.jsonl").write_text("\n".join(rows))
    order = readers.SOURCE_ORDER
    labels = readers.read_labels(spark, str(tmp_path / "labels.jsonl"))
    assert {(r.id, r.category, r.source) for r in labeling.latest_labels(labels, order).collect()} == {("1", "Dining", None), ("3", "Income", None)}
    mine = readers.read_labels(spark, str(tmp_path / "labels.jsonl"), client_id=7)
    assert [r.id for r in labeling.latest_labels(mine, order).collect()] == ["1"]


def test_events(spark, tmp_path):
    schema = (
        "client_id long, as_of_date date, utilization_pct double, projected_utilization_pct double, mtd_spend_usd double, "
        "monthly_limit_usd double, remaining_budget_usd double, days_to_limit_estimate long, overspend_risk boolean"
    )
    inputs = spark.createDataFrame([(1, date(2010, 2, 10), 0.72, 0.8, 72.0, 100.0, 28.0, None, False)], schema)
    path = tmp_path / "events"
    writers.write_events(notify.notifications(inputs), str(path))
    (path / "part-zzz.json").write_text('not json\n\n[1, 2]\n{"event_id": "x", "client_id": 2}\n')
    rows = {r.event_id: r for r in readers.read_events(spark, str(path)).collect()}
    assert len(rows) == 2 and rows["x"].client_id == 2
    row = [r for k, r in rows.items() if k != "x"][0]
    assert row.channels == ["app", "email"] and row.created_at


def test_limit_changes(spark, tmp_path):
    path = str(tmp_path / "limits")
    schema = "client_id long, limit_usd string, updated_at timestamp_ntz"
    for hour, value in ((1, "1234.0"), (2, None)):
        writers.append_change(spark.createDataFrame([(1, value, datetime(2010, 1, 1, hour))], schema), path)
        latest = budget.latest_limit_overrides(readers.read_limit_changes(spark, path), ["updated_at"])
        assert latest.count() == (1 if value else 0)


def test_feedback(spark, tmp_path):
    path = str(tmp_path / "feedback")
    schema = "client_id long, rec_id string, status string, note string, updated_at timestamp_ntz"
    writers.append_change(spark.createDataFrame([(1, "r", "accepted", None, datetime(2010, 1, 1))], schema), path)
    writers.append_change(spark.createDataFrame([(1, "r", "dismissed", "no", datetime(2010, 1, 2))], schema), path)
    row = recommend.latest_feedback(readers.read_feedback(spark, path), ["updated_at"]).collect()
    assert [(r.status, r.note) for r in row] == [("dismissed", "no")]


def test_sessions(spark, tmp_path):
    turns = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "system", "x")], "client_id long, turn long, role string, content string"
    )
    writers.append_change(turns, str(tmp_path / "turns"))
    back = coach.valid_turns(readers.read_turns(spark, str(tmp_path / "turns"))).orderBy("turn").collect()
    assert [(r.role, r.content) for r in back] == [("user", "hi"), ("assistant", "hello")]
    writers.write_sessions(readers.read_turns(spark, str(tmp_path / "turns")), str(tmp_path / "sessions"))
    row = spark.read.json(str(tmp_path / "sessions")).first()
    assert [(m.role, m.content) for m in row.messages] == [("user", "hi"), ("assistant", "hello")] and row.updated_at


def test_model_and_runway(spark, tmp_path):
    model = forecast.MonthEndModel(("a", "b"), (1.0, 2.0), (1.0, 3.0), (0.5, -0.5), 10.0, {"cutoff_day": "2010-01-01", "mae_test_usd": 3.5})
    df = spark.range(1)
    writers.write_model(model, str(tmp_path / "model"), df)
    again = forecast.MonthEndModel.from_frame(readers.read_model(spark, str(tmp_path / "model")), model.metrics)
    assert again == model
    schema = (
        "client_id long, as_of_date date, monthly_discretionary_limit_usd double, mtd_discretionary_spend_usd double, "
        "predicted_month_end_discretionary_spend_usd double, projected_utilization_pct double, overspend_risk boolean, "
        "days_to_limit_estimate long, remaining_budget_usd double, status string"
    )
    runway = spark.createDataFrame([(1, date(2010, 1, 1), 1.0, 1.0, 1.0, 1.0, True, 0, 0.0, "scored"), (2, date(2010, 1, 1), None, None, None, None, None, None, None, "no_limit")], schema)
    writers.write_runway(runway, model, str(tmp_path / "runway"))
    rows = spark.read.json(str(tmp_path / "runway")).collect()
    assert [(r.client_id, r.model_cutoff_day, r.mae_test_usd) for r in rows] == [(1, "2010-01-01", 3.5)]


def test_metrics_replace_only_their_date(spark, make_tx, tmp_path):
    tx = make_tx((1, "2010-01-01 10:00", 5, "m", "Dining"))
    tables = {"by_category": spend.spend_by_category(tx)}
    for day in ("2010-01-01", "2010-01-02", "2010-01-02"):
        writers.write_metrics(tables, str(tmp_path), day)
    rows = spark.read.parquet(str(tmp_path / "by_category")).collect()
    assert sorted(str(r.run_date) for r in rows) == ["2010-01-01", "2010-01-02"]


def test_report_fields_are_sorted(spark, tmp_path):
    writers.write_report(spark.createDataFrame([(1, 2)], "b int, a int"), str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("*.json")).read_text().strip()
    assert text == '{"a":2,"b":1}'


def test_files_hold_ranges_of_clients(spark, tmp_path):
    """A hot client is cut over files; the others sit in few files."""
    from pyspark.sql import functions as F

    df = spark.range(4000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 200)).alias("client_id"),
        (F.lit("2010-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("transaction_dt"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_enriched(df, str(tmp_path / "e"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_file = spark.read.parquet(str(tmp_path / "e")).groupBy(F.input_file_name().alias("f"), "client_id").count()
    files = {r.client_id: r.n for r in per_file.groupBy("client_id").agg(F.count("*").alias("n")).collect()}
    assert files["hot"] > 1 and max(n for c, n in files.items() if c != "hot") <= 2
    assert per_file.agg(F.max("count")).first()[0] < 1334


def test_month_folders_are_pruned(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(400).select(
        F.col("id").cast("string").alias("id"), F.lit("1").alias("client_id"), F.lit("m").alias("merchant_id"),
        F.lit("5812").alias("mcc_code"), F.lit("Restaurants").alias("mcc_description"), F.lit(1).cast("decimal(18,2)").alias("amount_usd"),
        (F.lit("2010-01-01 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("transaction_dt"),
    )
    writers.write_enriched(df, str(tmp_path / "e"))
    tx = labeling.with_rule_category(readers.read_enriched(spark, str(tmp_path / "e")))
    limits = spark.createDataFrame([(1, Decimal(100))], "client_id long, monthly_discretionary_limit_usd decimal(18,2)")
    spent = budget.budget_utilization(tx, limits, "2010-06-15")
    assert spent.first().mtd_discretionary_spend_usd == Decimal("14.00")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    for frame, first in ((spent, "2010-06"), (recommend.recurring_merchants(tx, "2010-06-15"), "2009-12")):
        text = frame._jdf.queryExecution().executedPlan().toString()
        part = text.split("PartitionFilters: [")[1].split("]")[0]
        assert f"tx_month#" in part and f">= {first}" in part and "<= 2010-06" in part
    assert recommend.recurring_merchants(tx, "2010-06-15").first().active_months == 6


def test_json_may_be_compressed(spark, tmp_path):
    writers.write_json(spark.range(5).selectExpr("id", "'x' as note"), str(tmp_path / "z"), compression="gzip")
    assert list((tmp_path / "z").glob("*.json.gz")) and sorted(r.id for r in spark.read.json(str(tmp_path / "z")).collect()) == list(range(5))
