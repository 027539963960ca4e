from spendkit.session import CHECKPOINT_KEY, SETTINGS, cut_lineage


def test_lineage_is_cut_in_the_named_folder(spark):
    df = spark.range(10).selectExpr("id * 2 as v")
    out = cut_lineage(df)
    assert sorted(r.v for r in out.collect()) == list(range(0, 20, 2))
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString()
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        assert named in spark.sparkContext.getCheckpointDir()


def test_settings_are_on(spark):
    for key, value in SETTINGS.items():
        assert spark.conf.get(key) == value
