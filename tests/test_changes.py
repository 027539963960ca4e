from datetime import datetime

import pytest

from spendkit.operators import budget
from spendkit.sources.changes import ChangeLog, feedback_log, limit_log

SCHEMA = "client_id long, limit_usd string, seq long"


@pytest.fixture
def log(spark, tmp_path):
    return ChangeLog(spark, str(tmp_path / "limits"), SCHEMA, ["client_id"], ["seq"])


@pytest.fixture
def add(spark, log):
    return lambda *rows: log.append(spark.createDataFrame(list(rows), SCHEMA).coalesce(1))


def now(log):
    return {r.client_id: r.limit_usd for r in log.latest().collect()}


def test_snapshot_and_tail(log, add):
    assert now(log) == {} and log.compact() == 0
    add((1, "10", 1), (2, "20", 2))
    add((1, "11", 3))
    want = {1: "11", 2: "20"}
    assert now(log) == want and len(log.tail()) == 2
    assert log.compact() == 1 and log.tail() == [] and now(log) == want
    add((2, None, 4))
    assert now(log) == {1: "11", 2: None} and len(log.tail()) == 1
    assert log.compact() == 2 and log.compact() == 2
    # An older entry that arrives late does not undo the clearing.
    add((2, "99", 3), (3, "30", 9))
    assert now(log) == {1: "11", 2: None, 3: "30"}


def test_reading_costs_the_tail(log, add):
    for k in range(6):
        add((k, str(k), k))
    log.compact()
    add((1, "x", 10))
    assert log.read().count() == 7 and len(log.read().inputFiles()) <= 1 + 6
    assert len(log.tail()) == 1
    for k in range(5):
        add((1, f"y{k}", 20 + k))
        log.compact()
    # One row per key, however many entries there were.
    assert log.tail() == [] and log.read().count() == 6 and now(log)[1] == "y4"


@pytest.mark.parametrize("step", ["_snapshot", "_switch"])
def test_a_compaction_that_is_lost_changes_nothing(log, add, monkeypatch, step):
    add((1, "10", 1), (2, "20", 2))
    log.compact()
    add((1, "11", 3))
    whole = getattr(ChangeLog, step)

    def lost(self, *args):
        if step == "_snapshot":
            whole(self, *args)  # the snapshot is there, the switch is not
        raise RuntimeError("lost")

    monkeypatch.setattr(ChangeLog, step, lost)
    with pytest.raises(RuntimeError):
        log.compact()
    monkeypatch.undo()
    assert log.generation() == 1 and now(log) == {1: "11", 2: "20"}
    add((2, "21", 5))
    assert log.compact() == 2 and now(log) == {1: "11", 2: "21"} and log.tail() == []


def test_appends_during_a_compaction_stay(log, add, monkeypatch):
    add((1, "10", 1))
    whole = ChangeLog._snapshot

    def slow(self, generation, tail):
        files = whole(self, generation, tail)
        add((1, "11", 2))
        return files

    monkeypatch.setattr(ChangeLog, "_snapshot", slow)
    assert log.compact() == 1
    assert now(log) == {1: "11"} and len(log.tail()) == 1


def test_vacuum_leaves_what_is_needed(log, add, tmp_path):
    log.vacuum()
    for k in range(3):
        add((1, str(k), k), (k + 2, "x", 0))
        log.compact()
    add((9, "tail", 1))
    want = now(log)
    log.vacuum()
    assert now(log) == want and log.generation() == 3 and len(log.tail()) == 1
    assert len(list((tmp_path / "limits" / "log").glob("*.json"))) == 1
    assert [p.name for p in (tmp_path / "limits" / "snapshot").iterdir()] == ["generation=3"]
    add((1, "new", 50))
    assert log.compact() == 4 and now(log) == {**want, 1: "new"} and log.tail() == []
    log.vacuum()
    assert now(log) == {**want, 1: "new"}


def test_logs_of_limits_and_feedback(spark, tmp_path):
    limits, at = limit_log(spark, str(tmp_path / "l")), lambda d: datetime(2010, 1, d)
    schema = "client_id long, limit_usd string, updated_at timestamp_ntz"
    limits.append(spark.createDataFrame([(1, "100", at(1)), (2, "200", at(1)), (3, "5", at(1))], schema))
    limits.append(spark.createDataFrame([(1, "abc", at(2)), (2, None, at(2)), (None, "7", at(2))], schema))
    for _ in range(2):
        got = {r.client_id: float(r.limit_usd) for r in budget.latest_limit_overrides(limits.read(), ["updated_at"]).collect()}
        assert got == {1: 100.0, 3: 5.0}
        limits.compact()
    feedback = feedback_log(spark, str(tmp_path / "f"))
    feedback.append(spark.createDataFrame([(1, "a", "dismissed", at(1)), (1, "a", "accepted", at(2)), (1, None, "x", at(3))],
                                          "client_id long, rec_id string, status string, updated_at timestamp_ntz"))
    assert feedback.compact() == 1 and [(r.rec_id, r.status) for r in feedback.read().collect()] == [("a", "accepted")]
