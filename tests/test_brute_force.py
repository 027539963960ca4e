"""Random clients, one of them with a third of all rows, against plain Python written from the rules."""

import random
import re
import statistics
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from spendkit.functions import calendar, money, text
from spendkit.operators import budget, cleaning, labeling, recommend, spend

AS_OF = date(2011, 6, 15)
KINDS = ["Dining", "Entertainment", "Shopping", "Subscriptions", "Groceries"]
WANTED = {"Dining", "Entertainment", "Shopping", "Subscriptions", "Travel"}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(6000):
        client = 0 if i % 3 == 0 else rng.randrange(1, 120)
        moment = datetime(2010, 12, 1) + timedelta(days=rng.randrange(198), hours=rng.choice([0, 0, 9, 23]))
        amount = Decimal(rng.randrange(-2000, 9000)) / 100
        merchant = rng.choice([None, "m1", "m2", "m3"])
        out.append((client, moment.isoformat(sep=" "), amount, merchant, rng.choice(KINDS)))
    return out


@pytest.fixture(scope="module")
def tx(make_tx, rows):
    return make_tx(*rows).repartition(6).cache()


def in_window(rows, days):
    start = datetime.combine(AS_OF - timedelta(days=days), datetime.min.time())
    end = datetime.combine(AS_OF, datetime.min.time())
    for client, at, amount, merchant, kind in rows:
        moment = datetime.fromisoformat(at)
        if start <= moment <= end:
            yield client, moment, max(amount, Decimal(0)), merchant, kind


def wanted_recurring(rows):
    months, subs = defaultdict(lambda: defaultdict(Decimal)), set()
    for client, moment, spent, merchant, kind in in_window(rows, 180):
        if merchant is not None:
            months[client, merchant][moment.strftime("%Y-%m")] += spent
            if kind == "Subscriptions":
                subs.add((client, merchant))
    out = {}
    for key, per_month in months.items():
        sums = [float(v) for v in per_month.values()]
        mean = sum(sums) / len(sums)
        if len(sums) >= 3 and mean >= 10 and statistics.stdev(sums) / mean <= 0.75:
            out[key] = (len(sums), mean, key in subs)
    return out


def wanted_categories(rows):
    """Client to [(category, category spend, top merchant, its spend)], highest spend first."""
    sums, merchants = defaultdict(lambda: defaultdict(Decimal)), defaultdict(lambda: defaultdict(Decimal))
    for client, _, spent, merchant, kind in in_window(rows, 90):
        if kind in WANTED:
            sums[client][kind] += spent
            if merchant is not None:
                merchants[client, kind][merchant] += spent
    out = defaultdict(list)
    for client, per in sums.items():
        for kind, total in sorted(per.items(), key=lambda x: (-x[1], x[0])):
            best = sorted(merchants[client, kind].items(), key=lambda x: (-x[1], x[0]))
            top = best[0] if best and best[0][1] > 0 else None
            out[client].append((kind, total, top))
    return out


def test_recurring(tx, rows):
    got = {(r.client_id, r.merchant_id): (r.active_months, round(r.avg_monthly_spend_usd, 6), r.is_subscription)
           for r in recommend.recurring_merchants(tx, str(AS_OF)).collect()}
    want = {k: (n, round(mean, 6), sub) for k, (n, mean, sub) in wanted_recurring(rows).items()}
    assert want and got == want


def test_walk_and_feedback(spark, tx, rows):
    """Replays the candidate walk per client, with a third of all items dismissed."""
    items = recommend.subscription_items(recommend.recurring_merchants(tx, str(AS_OF))).unionByName(
        recommend.cutback_items(recommend.top_category_merchants(tx, str(AS_OF))))
    ids = {(r.client_id, r.meta.category, r.meta.merchant_id): r.rec_id for r in items.collect()}
    gone = {k for i, k in enumerate(sorted(ids, key=str)) if i % 3 == 0}
    feedback = spark.createDataFrame([(k[0], ids[k], "dismissed") for k in gone] + [(k[0], ids[k], "accepted") for k in ids if k not in gone],
                                     "client_id long, rec_id string, status string")
    want, recurring, categories = {}, wanted_recurring(rows), wanted_categories(rows)
    for client in {r[0] for r in rows}:
        chosen = []
        subs = sorted((-mean, m) for (c, m), (_, mean, sub) in recurring.items() if c == client and sub)
        if subs and (client, None, subs[0][1]) not in gone:
            chosen.append((None, subs[0][1], -subs[0][0]))
        used, rank = set(), 0
        while len(chosen) < 2 and rank < 5:
            left = [c for c in categories.get(client, []) if c[0] not in used]
            hit = left[rank] if rank < len(left) and left[rank][1] > 0 else None
            rank += 1
            if hit is None:
                continue
            used.add(hit[0])
            if hit[2] and (client, hit[0], hit[2][0]) not in gone:
                chosen.append((hit[0], hit[2][0], float(hit[2][1]) / 3 * 0.15))
        if chosen:
            chosen.sort(key=lambda x: -x[2])
            want[client] = [(k, m, round(s, 6)) for k, m, s in chosen]
    got = defaultdict(list)
    for r in recommend.recommendations(tx, str(AS_OF), feedback).orderBy("client_id", "rank").collect():
        got[r.client_id].append((r.meta.category, r.meta.merchant_id, round(r.estimated_monthly_savings_usd, 6)))
    assert dict(got) == want


def test_budget(tx, rows, make_limits):
    want = defaultdict(Decimal)
    for client, at, amount, _, kind in rows:
        moment = datetime.fromisoformat(at)
        if kind in WANTED and datetime(2011, 6, 1) <= moment <= datetime(2011, 6, 15):
            want[client] += max(amount, Decimal(0))
    limits = make_limits(**{f"c{c}": 100 for c in range(120)})
    got = {r.client_id: r.mtd_discretionary_spend_usd for r in budget.budget_utilization(tx, limits, str(AS_OF)).collect()}
    assert got == {c: want[c] for c in range(120)}


def test_dow(tx, rows):
    days = defaultdict(Decimal)
    for client, at, amount, _, _ in rows:
        days[client, at[:10]] += max(amount, Decimal(0))
    groups = defaultdict(list)
    for (client, day), total in days.items():
        groups[client, date.fromisoformat(day).strftime("%A")].append(float(total))
    want = {k: round(sum(v) / len(v), 6) for k, v in groups.items()}
    got = {(r.client_id, r.dow): round(r.avg_daily_spend_usd, 6) for r in spend.avg_daily_spend_by_dow(tx).collect()}
    assert got == want


def test_share(tx, rows):
    sums = defaultdict(lambda: defaultdict(Decimal))
    for client, _, amount, _, kind in rows:
        sums[client][kind] += max(amount, Decimal(0))
    want = {}
    for client, per in sums.items():
        order = sorted(per.items(), key=lambda x: (-x[1], x[0]))
        for kind, value in order[:3]:
            want[client, kind] = value
        if order[3:]:
            want[client, "Other"] = sum(v for _, v in order[3:])
    got = {(r.client_id, r.category): r.spend_usd for r in spend.category_share(spend.spend_by_category(tx), 3).collect()}
    assert {k: v for k, v in got.items() if sum(sums[k[0]].values()) > 0} == {k: v for k, v in want.items() if sum(sums[k[0]].values()) > 0}


def test_distinct_merchants(tx, rows):
    seen, want = defaultdict(list), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], f"t{i:04d}"))
    for i in order:
        client, _, _, merchant, kind = rows[i]
        if (merchant, kind) not in seen[client]:
            seen[client].append((merchant, kind))
            if len(seen[client]) <= 5:
                want[client, len(seen[client])] = f"t{i:04d}"
    got = {(r.client_id, r.merchant_rank): r.id for r in labeling.distinct_merchants(tx, 5).collect()}
    assert got == want


def test_dedupe(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, "hot", "hot", str(rng.randrange(500))]), rng.random()) for i in range(3000)]
    first, copies = {}, defaultdict(int)
    for n, key, value in data:
        first.setdefault(key, (n, value))
        copies[key] += 1
    df = spark.createDataFrame(data, "n int, id string, v double").repartition(5)
    assert {r.id: (r.n, r.v, r.copies) for r in cleaning.dedupe_by_id(df, ["n"]).collect()} == {k: (*v, copies[k]) for k, v in first.items()}
    assert {r.id: (r.n, r.v) for r in cleaning.dedupe_by_id(df, ["n"], copies=False).collect()} == first


TEXT = st.text(alphabet=" \t\n  \x1c.,-$0123456789aZe()", max_size=14)
BATCH = settings(max_examples=20, deadline=None, database=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def py_clean(v):
    return re.sub(r"\s+", " ", v.strip()) or None


def py_currency(v):
    digits = re.sub(r"[^0-9.\-]", "", py_clean(v) or "")
    try:
        return float(digits)
    except ValueError:
        return None


@BATCH
@given(values=st.lists(TEXT, min_size=1, max_size=200))
def test_text_and_money(spark, values):
    assert column(spark, text.clean_text, values) == [py_clean(v) for v in values]
    assert column(spark, money.parse_currency, values) == [py_currency(v) for v in values]


@BATCH
@given(values=st.lists(st.from_regex(r"\A ?(19|20)\d\d-[01]?\d-[0-3]?\d {1,2}[0-2]?\d:[0-6]?\d:[0-6]?\d ?\Z"), min_size=1, max_size=150))
def test_dates(spark, values):
    def parse(v):
        try:
            return datetime.strptime(py_clean(v), "%Y-%m-%d %H:%M:%S")
        except ValueError:
            return None

    values = [v for v in values if v.isascii()]
    assert column(spark, calendar.parse_timestamp, values) == [parse(v) for v in values]


def test_packed_rows_come_back_as_they_were(spark):
    """Signs of the packing, empty texts, nulls and spelled texts, with columns added and dropped by the move."""
    from spendkit.operators.common import NULL_SIGN, SEPARATOR, move_packed

    rng = random.Random(5)
    texts = [None, "", " ", "a", "1.00", "=", "=1.00", "é,\"x\n", SEPARATOR, NULL_SIGN, f"a{SEPARATOR}b", f"{NULL_SIGN}{SEPARATOR}", NULL_SIGN * 2, "\u2028\U0001f600"]
    rows = [(i, rng.choice(texts), rng.choice([None, True, False]), rng.choice(texts), rng.choice([None, 1.0, 2.5]), rng.choice(texts)) for i in range(600)]
    df = spark.createDataFrame(rows, "n long, a string, b boolean, `c.d` string, v double, k string")
    spelled = F.col("v").cast("decimal(9,2)").cast("string")

    def move(part):
        assert set(part.columns) == {"n", "v", "k", "_packed", "_odd"}
        return part.repartition(3, "k").withColumn("added", F.col("n") + 1).drop("n")

    out = move_packed(df, move, "k", known={"a": spelled})
    assert out.dtypes == [*df.drop("n").dtypes, ("added", "bigint")]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((*r[1:], r[0] + 1)) for r in rows)
    broken = spark.sql("select cast(unhex('ff61') as string) a, 'x' b").repartition(1)
    assert move_packed(broken, lambda part: part.repartition(2)).selectExpr("hex(a) a").first().a == "FF61"


def test_written_tables_keep_odd_texts(spark, tmp_path):
    """Enriched rows and buckets are packed on their way; both are stored with zstd."""
    from spendkit.sources import bucketed, writers

    rows = [(str(i % 5), None if i % 7 == 0 else f"m\x1f{i}", "\x1e" if i % 3 else "", f"2010-0{1 + i % 4}-01 0{i % 9}:00:00", "2010-01-01 00:00:00", f"{i}.50", ("$" if i % 2 else "") + f"{i}.50") for i in range(60)]
    df = spark.createDataFrame(rows, "client_id string, merchant_id string, errors string, at string, date string, usd string, amount string").selectExpr(
        "client_id", "merchant_id", "errors", "cast(at as timestamp_ntz) transaction_dt", "date", "cast(usd as decimal(18,2)) amount_usd", "amount")
    want = sorted(map(repr, df.collect()))
    writers.write_enriched(df, str(tmp_path / "enriched"))
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "enriched")).drop("tx_month").select(*df.columns).collect())) == want
    got = bucketed.write_bucketed(df, "odd_texts", str(tmp_path / "buckets"), "client_id", 4)
    assert sorted(map(repr, got.select(*df.columns).collect())) == want
    for folder in ("enriched", "buckets"):
        files = list((tmp_path / folder).rglob("*.parquet"))
        assert files and all(f.name.endswith(".zstd.parquet") for f in files)
