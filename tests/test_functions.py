from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from spendkit.functions import calendar, category, identity, money, text
from spendkit.operators.common import require_columns


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_text(spark):
    got = apply(spark, text.clean_text, ["  a   b  ", "   ", None, "", "a  b\t\n", "\x1c"])
    assert got == ["a b", None, None, None, "a b", None]


def test_parse_currency(spark):
    got = apply(spark, money.parse_currency, ["$2,238 ", " ", "NOT_MONEY", "1-2", "--5", "-.", "-", ".", "(12)", "1e5", "-$3.5", None, "1."])
    assert got == [2238.0, None, None, None, None, None, None, None, 12.0, 15.0, -3.5, None, 1.0]


def test_parse_money_is_exact(spark):
    got = apply(spark, money.parse_money, ["$0.10", "$19110", "bad"])
    assert [None if g is None else str(g) for g in got] == ["0.10", "19110.00", None]


def test_parse_timestamp(spark):
    got = apply(spark, calendar.parse_timestamp, [
        "2010-01-01 00:07:00", "bad", "2010-02-30 00:00:00", "2010-01-01 00:00:60", "2010-01-01 00:07:00 x",
        "2010-1-2 3:4:5", "2010-01-01", None, "2010-01-01T00:07:00",
    ])
    assert got == [datetime(2010, 1, 1, 0, 7), None, None, None, None, datetime(2010, 1, 2, 3, 4, 5), None, None, None]


def test_parse_timestamp_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = apply(spark, calendar.parse_timestamp, ["2010-03-14 02:30:00"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime(2010, 3, 14, 2, 30)]


def test_codes(spark):
    assert apply(spark, text.normalize_zip, ["10464.0", "", "10464"]) == ["10464", None, "10464"]
    assert apply(spark, text.normalize_mcc, ["5812.0", "abc", " 5812 ", None]) == ["5812", None, "5812", None]
    assert apply(spark, text.normalize_state, [" ny ", None]) == ["NY", None]
    assert apply(spark, text.yes_no, ["YES", "No", "maybe", " 1 ", "f", None]) == [True, False, None, True, None, None]


def test_online(spark):
    df = spark.createDataFrame(
        [(0, "Online Transaction", "ONLINE"), (1, "Swipe Transaction", "Bronx"), (2, None, " online "), (3, None, None)],
        "i int, chip string, city string",
    )
    got = [r.o for r in df.select("i", text.is_online(F.col("chip"), F.col("city")).alias("o")).orderBy("i").collect()]
    assert got == [True, False, True, False]


def test_mcc_category(spark):
    cases = [
        ("5812", "Eating Places and Restaurants", "Dining"),
        ("5411", "Grocery Stores, Supermarkets", "Groceries"),
        ("4900", "Utilities - Electric, Gas, Water, Sanitary", "Utilities"),
        ("5814", None, "Dining"), ("5411", None, "Groceries"), ("4900", None, "Utilities"),
        (None, None, "Other/Uncategorized"),
        ("4784", "Tolls and Bridge Fees", "Transportation"),
        ("3640", "Lighting, Fixtures, Electrical Supplies", "Utilities"),
        ("5815", "Digital Goods: Media", "Dining"),
        ("4722", "Travel Agencies", "Transportation"),
        ("9999", "Annual Fee", "Fees & Interest"),
        ("5200", "UNKNOWN_MCC", "Shopping"),
    ]
    df = spark.createDataFrame([(i, c, d) for i, (c, d, _) in enumerate(cases)], "i int, c string, d string")
    got = df.select("i", category.mcc_category(F.col("c"), F.col("d")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [c[2] for c in cases]
    assert apply(spark, category.is_discretionary, ["Dining", "Travel", "Groceries", None]) == [True, True, False, False]


def test_subscription(spark):
    df = spark.createDataFrame(
        [(0, " Subscriptions ", None), (1, "Dining", "Streaming Media"), (2, None, "Gas"), (3, "Dining", None)],
        "i int, c string, d string",
    )
    got = df.select("i", category.is_subscription(F.col("c"), F.col("d")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [True, True, False, False]


def test_calendar(spark):
    df = spark.createDataFrame([(datetime(2012, 2, 29, 23, 59),)], "t timestamp_ntz")
    t = F.col("t")
    row = df.select(
        calendar.month_label(t), calendar.weekday_name(t), calendar.month_start(t), calendar.days_in_month(t),
        calendar.days_remaining(t),
    ).first()
    assert tuple(row) == ("2012-02", "Wednesday", date(2012, 2, 1), 29, 0)


def test_labels(spark):
    assert apply(spark, money.money_label, [1234.5, None, -1142.76, 0.125], "double") == ["$1,234.50", "N/A", "$-1,142.76", "$0.12"]
    assert apply(spark, money.percent_label, [0.7, 0.125, 1.1], "double") == ["70%", "12%", "110%"]


def test_first_amount(spark):
    said = ["Can I afford $200 today?", "spend 1,234.56?", "none", "1500", "$ 12.5 or 13", "-5", "", None, "1,23"]
    assert apply(spark, money.first_amount, said) == [200.0, 1234.56, None, 1500.0, 12.5, -5.0, None, None, 1.0]
    strict = apply(spark, lambda c: money.first_amount(c, strict=True), ["1500", "$200"])
    assert strict == [150.0, 200.0]


def test_ratio_and_spend(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, None), (2, 1.0, 4.0)], "i int, a double, b double")
    got = df.select("i", money.ratio(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [None, None, 0.25]
    assert apply(spark, money.spend, [5.0, -7.0], "double") == [5.0, 0.0]


def test_stable_id_matches_hashlib(spark):
    import hashlib

    df = spark.createDataFrame([(7, "x", None)], "a long, b string, c string")
    got = df.select(identity.stable_id(F.lit("k"), F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert got == hashlib.sha256("k|7|x|".encode()).hexdigest()[:16]


def test_fingerprints(spark):
    row = ("1", "9", "5.00", "5812", "Restaurants", "m", "c", "s", "chip", None)
    schema = "id string, client_id string, amount string, mcc string, mcc_description string, merchant_id string, merchant_city string, merchant_state string, use_chip string, errors string"
    df = spark.createDataFrame([row, row, ("2", *row[1:])], schema)
    out = df.select(
        identity.transaction_fingerprint(df.columns).alias("t"),
        identity.merchant_fingerprint(df.columns).alias("m"),
        identity.merchant_fingerprint(df.columns, "v2").alias("m2"),
    ).collect()
    assert len(out[0].t) == 64 and out[0].t == out[1].t and out[0].t != out[2].t
    assert out[0].m == out[2].m and out[0].m != out[0].m2


def test_fingerprint_falls_back_to_raw_columns(spark):
    a = spark.createDataFrame([("5812", None)], "mcc_code string, mcc string")
    b = spark.createDataFrame([(None, "5812")], "mcc_code string, mcc string")
    digest = [d.select(identity.merchant_fingerprint(d.columns)).first()[0] for d in (a, b)]
    assert digest[0] == digest[1]


def test_profile_key(spark):
    import hashlib

    df = spark.createDataFrame(
        [("5812", "Food", "m1", None, "NY", True)],
        "mcc_code string, mcc_description string, merchant_id string, merchant_city string, merchant_state string, is_online boolean",
    )
    key, pid = df.select(identity.profile_key(), identity.profile_id(identity.profile_key())).first()
    assert key == "5812|Food|m1||NY|True"
    assert pid == "p" + hashlib.sha256(key.encode()).hexdigest()[:16]


def test_require_columns(spark):
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"])


def test_codes_of_cleaned_text_need_no_pattern_for_the_end(spark):
    values = ["10464.0", "10464", ".0", "0", "1.0.0", "1.00", "a.0\n", " 7.0 ", "5812 .0", "é.0", "\U0001f600.0", "\r\n", "", None, "10.0 "]
    for code in (text.normalize_zip, text.normalize_mcc):
        assert apply(spark, lambda c: code(text.clean_text(c), clean=True), values) == apply(spark, code, values)
    assert "regexp_replace" not in str(text.normalize_zip(F.col("zip"), clean=True))
