import pytest
from pyspark.sql import functions as F

from spendkit.llm.sampling import least_hashes


@pytest.mark.parametrize("parts", [1, 50])
def test_the_least_hashes_of_each_key(spark, parts):
    """A key with a third of all rows in one text, one with many texts, one with few."""
    rows = spark.range(0, 30_000, 1, parts).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 50, "few").otherwise("many").alias("k"),
        F.xxhash64(F.when(F.col("id") % 3 == 0, F.col("id") % 700).otherwise(F.col("id"))).alias("hash"),
    )
    got = {}
    for r in least_hashes(rows, "k", 20).collect():
        got.setdefault(r["k"], []).append(r["hash"])
    for k in ("hot", "few", "many"):
        every = sorted({r["hash"] for r in rows.where(F.col("k") == k).select("hash").collect()})
        assert sorted(got[k])[:20] == every[:20] and len(got[k]) == len(set(got[k])) <= max(len(every) if len(every) < 60 else 300, 20)


def test_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 5), ("a", 5), ("a", -3)], "k string, hash long")
    assert sorted(map(tuple, least_hashes(rows, "k", 1).collect())) == [("a", -3), ("a", 5)]
    assert least_hashes(rows.limit(0), "k", 5).collect() == []
