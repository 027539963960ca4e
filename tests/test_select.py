import random
import statistics

import pytest
from pyspark.sql import functions as F

from spendkit.operators import labeling, select
from spendkit.sources import bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buffer", [select.BUFFER, 3, 0])
def test_medians(spark, buffer):
    rng = random.Random(1)
    groups = {
        "one": [5], "two": [5, 8], "negative": [-7, -7, -2, 0, 3], "equal": [4] * 9, "odd cents": [1, 2, 4, 100],
        "wide": [rng.randrange(-(10**12), 10**12) for _ in range(501)], "many": [rng.randrange(0, 5000) for _ in range(4000)],
        "top": [10**17, 10**17, -(10**17)], "close": [10**15 + k for k in range(40)],
    }
    rows = [(k, v, c) for k, vs in groups.items() for v, c in {x: vs.count(x) for x in vs}.items()] + [("none", None, 3), ("one", None, 9)]
    counts = spark.createDataFrame(rows, "k string, v long, n long").repartition(5)
    got = {r.k: r["median"] for r in select.medians(counts, "k", "v", buffer=buffer).collect()}
    assert {k: m for k, m in got.items() if m is not None} == {k: float(statistics.median(v)) for k, v in groups.items()}


def test_no_buffer_holds_a_large_group(spark):
    """Two groups of 200,000 values: windows and buffers see digits, of which there are few, and never the values."""
    rows = spark.range(0, 400_000, 1, 200).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 1_000_003).alias("v"), F.lit(1).cast("long").alias("n"))
    got = {r.k: r["median"] for r in select.radix_medians(rows, "k", "v").collect()}
    values = [(i % 2, i * 7919 % 1_000_003) for i in range(400_000)]
    assert got == {k: float(statistics.median([v for g, v in values if g == k])) for k in (0, 1)}
    assert "percentile" not in plan(select.radix_medians(rows, "k", "v"))


def test_few_keys_in_many_tasks(spark):
    rows = spark.range(0, 100_000, 1, 200).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("h"), "id")
    best = select.best_of_few(rows, ["k"], [F.col("h"), F.col("id")], 7, fan=8)
    want = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append((r.h, r.id))
    got = {}
    for r in best.collect():
        got.setdefault(r.k, []).append((r.h, r.id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:7] for k, v in want.items()}
    text = plan(best).split("Initial Plan")[0]
    # Each task keeps n rows per key before either shuffle.
    assert text.count("WindowGroupLimit") >= 4 and text.count("Exchange hashpartitioning") == 2


def test_joins_by_bucket_move_no_row(spark, tmp_path, make_tx):
    rows = [(1, "2010-01-%02d 10:00" % d, d, f"m{d % 3}", "Dining") for d in range(1, 29)]
    plain = make_tx(*rows).drop("category", "category_source", "is_discretionary")
    labels = spark.createDataFrame([("t0001", 1, "Travel", "llm"), ("t0001", 2, "Shopping", "llm"), ("t0005", 1, None, "llm")], "id string, seq int, category string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tx = bucketed.write_bucketed(plain, "tx_by_id", str(tmp_path / "tx"), "id", 4)
        own = bucketed.write_bucketed(labels, "labels_by_id", str(tmp_path / "labels"), "id", 4)
        joined = labeling.overlay_labels(tx, labeling.latest_labels(own, ["seq"]))
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        want = {r.id: r.category for r in labeling.overlay_labels(plain, labeling.latest_labels(labels, ["seq"])).collect()}
        assert {r.id: r.category for r in joined.collect()} == want and want["t0001"] == "Shopping"
        # By profile: the labels of profiles and the transactions that carry the profile.
        profiled = bucketed.write_bucketed(labeling.with_profile(plain.withColumn("is_online", F.lit(False))), "tx_by_profile", str(tmp_path / "p"), "profile_id", 4)
        labelled = bucketed.write_bucketed(profiled.select("profile_id").distinct().withColumn("label", F.lit("x")), "profiles", str(tmp_path / "q"), "profile_id", 4)
        both = profiled.join(labelled, "profile_id", "left")
        assert "Exchange" not in plan(both) and both.where("label is null").count() == 0
        # A session that does not know the tables opens them from their folders.
        other = spark.newSession()
        other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.sql("DROP TABLE tx_by_id")
        again = bucketed.open_bucketed(other, "tx_by_id", str(tmp_path / "tx"), "id", 4)
        assert "Exchange" not in plan(again.join(other.table("labels_by_id"), "id")) and again.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for table in ("tx_by_id", "labels_by_id", "tx_by_profile", "profiles"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
