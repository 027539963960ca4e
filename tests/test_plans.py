"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry  # noqa: F401  (registers the queries)
from spendkit.operators import recommend, spend
from spendkit.operators.common import best_rows
from spendkit.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert node not in text


def test_ranks_are_pruned_before_the_shuffle(spark, make_tx):
    tx = make_tx((1, "2010-01-01 10:00", 5, "m", "Dining"))
    for df in (best_rows(tx, ["client_id"], [F.col("id")]), spend.top_merchants(tx)):
        text = plan(df)
        assert re.search(r"WindowGroupLimit.*Partial", text) and text.index("Final") < text.index("Partial")


def test_date_frame_spreads_a_hot_client(spark, make_tx):
    tx = make_tx((1, "2010-01-01 10:00", 5, "m", "Dining"))
    as_of = spark.createDataFrame([(1, "2010-01-02")], "client_id long, as_of string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(recommend.recurring_merchants(tx, as_of))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Rows are summed per day inside the tasks before anything is shuffled by client.
    join = text[text.index("SortMergeJoin"):]
    assert "partial_sum" in join and "_day" in join and join.index("_day") < join.index("partial_sum")


def test_single_pass(spark):
    """Cutbacks, trend and alerts read each transaction once."""
    for name, scans in (("top_category_merchant", 1), ("monthly_category_trend", 1), ("recurring_merchants", 1), ("training_samples", 1)):
        text = plan(QUERIES[name](spark, SF))
        assert len(re.findall(r"FileScan parquet \[[^\]]*l_extendedprice", text)) == scans, name


def test_recommendations_read_transactions_once(spark):
    """The rollup is one hash aggregate over one scan; both kinds of items read what it stored."""
    from spendkit.plans.views import AS_OF, Views

    rollup = plan(recommend.spending_rollup(Views(spark, SF).categorised(place=True), AS_OF))
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_extendedprice", rollup)) == 1 and "SortAggregate" not in rollup
    # What is left is the feedback view's own scan.
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_extendedprice", plan(QUERIES["recommendations"](spark, SF)))) == 0


def test_profiles_and_qa_do_not_sort_raw_rows(spark):
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_extendedprice", plan(QUERIES["merchant_profiles"](spark, SF)))) == 1
    assert "SortAggregate" not in plan(QUERIES["qa_report"](spark, SF))


def test_scores_read_the_last_month_only(spark):
    from spendkit.operators import forecast

    early = spark.range(50).selectExpr("1L client_id", "date_add(date'2010-01-01', int(id)) day", "cast(id % 7 as decimal(18,2)) discretionary_spend_usd")
    late = spark.sql("select 1L client_id, to_date(d) day, cast(v as decimal(18,2)) discretionary_spend_usd from values ('2010-03-02', 5), ('2010-03-09', 1), ('2010-05-01', 9) t(d, v)")
    daily = early.unionByName(late)
    limits = spark.createDataFrame([(1, 100.0)], "client_id long, l double").selectExpr("client_id", "cast(l as decimal(18,2)) monthly_discretionary_limit_usd")
    fit = forecast.fit_month_end_model(forecast.training_samples(daily, limits), "2010-02-01")
    row = forecast.score_daily(daily, limits, "2010-03-20", fit).first()
    assert float(row["mtd_discretionary_spend_usd"]) == 6.0 and row["status"] == "scored"


def test_label_run_joins_the_tables_once(spark):
    """Labelled transactions come from the stored ones that the profiles were counted from, not from another join."""
    for name in ("transaction_labels", "category_overlay_by_profile"):
        assert "l_orderkey" not in plan(QUERIES[name](spark, SF)), name


def test_loads_and_last_dates_read_what_is_stored(spark):
    """The merge holds no join and no aggregate of a load beside its own; the scores join the tables no second time."""
    for name in ("rollup_of_loads", "runway_at_last_date"):
        assert "l_orderkey" not in plan(QUERIES[name](spark, SF)), name
    assert plan(QUERIES["rollup_of_loads"](spark, SF)).split("Initial Plan")[0].count("HashAggregate") == 2


def test_buckets_grow_with_the_rows(spark):
    from spendkit.sources import bucketed

    assert [bucketed.buckets_for(n, least=8) for n in (0, 1, 4_000_000, 4_000_001, 216_000_000)] == [8, 8, 8, 16, 512]
    assert bucketed.buckets_for(0) == bucketed.BUCKETS


def shuffled(spark, build, threshold="-1"):
    conf = {"spark.sql.autoBroadcastJoinThreshold": threshold, "spark.sql.debug.maxToStringFields": "1000"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return plan(build())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_suppliers_are_broadcast_by_their_own_size(spark):
    """Joined with nations first, they would count as the product of both."""
    from spendkit.plans.views import Views

    text = shuffled(spark, lambda: Views(spark, SF).tx(), "100k")
    assert re.search(r"BroadcastHashJoin \[l_suppkey", text) and not re.search(r"SortMergeJoin \[l_suppkey", text)


def test_transactions_move_their_amount_only(spark):
    """What the amount is made of does not go through the joins."""
    from spendkit.plans.views import Views

    text = shuffled(spark, lambda: Views(spark, SF).tx().select("merchant_id", "amount_usd"))
    assert text.index("Exchange hashpartitioning(l_orderkey") < text.index("AS amount_usd")


def test_codes_are_added_after_the_joins(spark):
    """The rows that are shuffled for cards and users do not hold what follows from their other columns."""
    text = shuffled(spark, lambda: QUERIES["clean_transactions"](spark, SF))
    above, below = text.split("Exchange hashpartitioning(client_id", 1)
    for name in ("zip_norm", "mcc_code", "is_online"):
        assert f"AS {name}#" in above, name
    assert "AS zip_norm#" not in below and "UNKNOWN_MCC" not in below.split("Exchange hashpartitioning(id")[0]


def test_qa_report_moves_no_text_of_date_and_amount(spark):
    text = shuffled(spark, lambda: QUERIES["qa_report"](spark, SF))
    by_id = text.index("Exchange hashpartitioning(id")
    assert "2000-01-01 00:00:00" in text[by_id:]


def test_medians_move_hashes_and_cents_only(spark):
    """The rows that are sorted for the medians hold none of the texts of their profiles."""
    text = shuffled(spark, lambda: QUERIES["merchant_profiles"](spark, SF))
    keys = re.findall(r"ObjectHashAggregate\(keys=\[([^\]]*)\], functions=\[[^\n]*percentile", text)
    assert keys and all(re.fullmatch(r"_code#\d+L?, _code2#\d+L?", k) for k in keys)
    below = text[text.rindex("percentile("):]
    scanned = below[:below.index("Exchange hashpartitioning(l_")]
    assert "Exchange hashpartitioning(_code" in scanned and "profile_key" not in scanned[:scanned.index("Exchange hashpartitioning(_code")]


def test_transactions_move_flags_for_quantity_and_status(spark):
    """Of quantity and status the joins move what is asked of them."""
    from spendkit.plans.views import Views

    for build in (lambda: Views(spark, SF).tx(), lambda: Views(spark, SF).raw_tx()):
        text = shuffled(spark, build)
        above = text[:text.index("Exchange hashpartitioning(l_orderkey")]
        assert "l_quantity" not in above and "l_linestatus" not in above


def test_enriched_rows_are_moved_as_one_text(spark):
    """The shuffles for first copies, cards and users, and those of the raw rows, hold no column per text."""
    text = shuffled(spark, lambda: QUERIES["clean_transactions"](spark, SF))
    for key, names in (
        ("client_id", ("merchant_city", "errors")), ("card_id", ("merchant_city", "errors")), ("id", ("merchant_city", "errors")),
        ("l_partkey", ("l_returnflag", "is_online")), ("l_orderkey", ("l_returnflag", "is_online")),
    ):
        below = text[text.index(f"Exchange hashpartitioning({key}#"):]
        moved = re.search(r"Project \[(.*)\]\n", below).group(1)
        assert "_packed" in moved, key
        # Above the packing itself no text has a name.
        assert not any(re.search(rf"(^|, ){n}#|AS {n}#", moved) for n in names), key


def test_labels_in_buckets_join_the_tables_once(spark, monkeypatch):
    from spendkit.plans.views import Views

    calls, tx = [], Views.tx
    monkeypatch.setattr(Views, "tx", lambda self, *a, **k: calls.append(k) or tx(self, *a, **k))
    assert QUERIES["overlay_by_bucket"](spark, SF).count() and len(calls) == 1
