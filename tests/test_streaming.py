import shutil

import pytest
from test_io import HEADER, line

from spendkit.operators import cleaning
from spendkit.streaming import incremental
from spendkit.streaming.incremental import clean_stream


@pytest.fixture
def dims(spark):
    mcc = spark.createDataFrame([("5812", "Eating Places and Restaurants")], "mcc_code string, mcc_description string")
    users = cleaning.prepare_users(spark.createDataFrame([("1", "$100")], "id string, monthly_discretionary_limits string"))
    cards = cleaning.prepare_cards(spark.createDataFrame(
        [("c1", "1", "$5", "YES", "No")], "id string, client_id string, credit_limit string, has_chip string, card_on_dark_web string"))
    return mcc, cards, users


@pytest.fixture
def load(spark, tmp_path, dims):
    """Adds a file if one is given, runs the load and returns the amounts by id."""
    (tmp_path / "in").mkdir()

    def run(name=None, *lines, header=HEADER, **options):
        if name:
            (tmp_path / "in" / f"{name}.csv").write_text("\n".join([header, *lines]))
        query = clean_stream(spark, *(str(tmp_path / x) for x in ("in", "out", "work", "progress")), *dims, **options)
        query.awaitTermination()
        assert query.exception() is None
        return {r.id: float(r.amount_usd) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    return run


def dated(i, amount, day):
    return line(i, amount).replace("2010-01-01", day)


def test_clean_stream(load):
    assert load("a", line(1, "$1.00"), line(1, "$2.00"), line(2, "bad"), line("nan", "$4.00")) == {"1": 1.0, None: 4.0}
    # Id 2 was seen, though its row was invalid; a null id is one id.
    assert load("b", line(1, "$9.00"), line(2, "$9.00"), line(3, "$3.00"), line("", "$9.00")) == {"1": 1.0, None: 4.0, "3": 3.0}
    turned = lambda text: ",".join(reversed(text.split(",")))
    want = {"1": 1.0, None: 4.0, "3": 3.0, "4": 5.0}
    assert load("c", turned(line(4, "$5.00")), header=turned(HEADER)) == want
    assert load() == want


def test_batches_of_few_files_in_order(spark, tmp_path, load):
    for k in range(5):
        (tmp_path / "in" / f"{k}.csv").write_text("\n".join([HEADER, line(0, f"${k}.00"), line(k + 10, f"${k}.50")]))
        import os
        os.utime(tmp_path / "in" / f"{k}.csv", (1_000_000 + k, 1_000_000 + k))
    got = load(files_per_batch=1)
    assert got == {"0": 0.0, **{str(k + 10): k + 0.5 for k in range(5)}}
    assert {r.batch for r in spark.read.parquet(str(tmp_path / "out")).collect()} == set(range(5))


def test_late_rows_are_put_aside(spark, tmp_path, load):
    keep = {"keep": "10 days"}
    assert load("a", dated(1, "$1.00", "2010-03-01"), dated(2, "$2.00", "2010-02-01"), line(3, "$3.00").replace("2010-01-01 00:07:00", "no day"), **keep) == {"1": 1.0, "2": 2.0}
    # The newest date of earlier batches is March 1st: what is ten days older or more is late.
    second = [dated(4, "$4.00", "2010-02-19"), dated(5, "$5.00", "2010-02-20"), dated(2, "$9.00", "2010-02-01"), dated(1, "$9.00", "2010-03-05"),
              dated(3, "$9.00", "2010-03-01")]
    assert load("b", *second, **keep) == {"1": 1.0, "2": 2.0, "5": 5.0}
    late = spark.read.parquet(str(tmp_path / "work" / "late"))
    assert {(r.id, r.batch) for r in late.collect()} == {("4", 1), ("2", 1)}
    load("c", dated(6, "$6.00", "2010-06-01"), **keep)
    # By now id 1 is forgotten: a copy with a new date is a new row.
    got = load("d", dated(1, "$7.00", "2010-05-30"), dated(6, "$9.00", "2010-06-01"), **keep)
    assert got.keys() == {"1", "2", "5", "6"} and got["6"] == 6.0
    rows = spark.read.parquet(str(tmp_path / "out")).where("id = '1'").collect()
    assert sorted((float(r.amount_usd), r.batch) for r in rows) == [(1.0, 0), (7.0, 3)]


@pytest.mark.parametrize("step", ["_store", "_pass_on", "after"])
def test_a_restart_gives_the_same_rows(load, monkeypatch, tmp_path, step):
    load("a", line(1, "$1.00"), line(2, "$2.00"))
    whole = {name: getattr(incremental, name) for name in ("_store", "_pass_on")}

    def fails(*args):
        if step == "after":
            whole["_pass_on"](*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental, "_pass_on" if step == "after" else step, fails)
    with pytest.raises(Exception, match="lost"):
        load("b", line(2, "$9.00"), line(3, "$3.00"), line(3, "$4.00"))
    monkeypatch.setattr(incremental, "_store", whole["_store"])
    monkeypatch.setattr(incremental, "_pass_on", whole["_pass_on"])
    assert load() == {"1": 1.0, "2": 2.0, "3": 3.0}
    assert load("c", line(3, "$9.00"), line(4, "$4.00")) == {"1": 1.0, "2": 2.0, "3": 3.0, "4": 4.0}


def test_no_batch_reads_older_ids(spark, tmp_path, load):
    load("a", *[line(k, "$1.00") for k in range(300)])
    # What earlier batches stored can go; the ids are in the state.
    shutil.move(tmp_path / "work" / "staged" / "batch=0", tmp_path / "gone")
    shutil.move(tmp_path / "out" / "batch=0", tmp_path / "gone-too")
    assert load("b", line(7, "$9.00"), line(1000, "$2.00")) == {"1000": 2.0}
    assert not (tmp_path / "work" / "ids").exists()
