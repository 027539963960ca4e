import base64
import hashlib
import random

import numpy as np
import pytest

from spendkit.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nHELLO\r\n\r\n"


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        top = max(same, default=None)
        revisit = len(body) >= least and top is not None and i != top
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def read(spark, path, **kw):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in warc.read_records(spark, path, **kw).select(*cols).collect()), key=repr)


@pytest.fixture
def rows():
    rng = random.Random(3)
    rows = [
        (1, "http://a.example/", "plain"), (2, None, None), (3, "http://a.example/x\r\ny", ""), (4, "u", "plain"),
        (5, "u", FAKE + "tail"), (6, "u", "before " + FAKE + FAKE), (7, "u", "WARC/1.1\r\n"), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
        (9, "ü", "ünïcode €"), (None, "u", "no id"), (11, "u", "x" * 5000 + FAKE * 40 + "y" * 3000), (12, "u", FAKE + "tail"),
        (13, "u", "Content-Length: 3\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n"), (None, "u", "plain"), ((1 << 60) + 1, "u", "large id"),
    ]
    return rows + [(100 + k, f"http://h{k % 7}/", "".join(rng.choice(["a", "WARC/1.1\r\n", "\r\n\r\n", "é"]) for _ in range(rng.randrange(60)))) for k in range(80)]


def test_round_trip_rejects_version_lines_in_payloads(spark, pages_of, tmp_path, rows, small_splits):
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages_of(rows), path)
    assert read(spark, path) == expected(rows)


def test_payloads_come_back_whole(spark, pages_of, tmp_path, rows, small_splits):
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages_of(rows), path)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_records(spark, path, payload=True).where("record_type = 'response' and page_id is not null").collect()}
    kinds = {i: kind for i, _, _, kind, _ in expected(rows)}
    assert got == {i: (h or "").encode() for i, _, h in rows if i is not None and kinds[i] == "response"}


def test_small_payloads_are_never_revisits(spark, pages_of, tmp_path, rows):
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages_of(rows), path, min_bytes=6)
    assert read(spark, path) == expected(rows, 6)


@pytest.mark.parametrize("bits", [64, 512])
def test_a_small_filter_loses_and_doubles_no_record(spark, pages_of, tmp_path, rows, monkeypatch, bits):
    whole = warc.Bloom.of
    monkeypatch.setattr(warc.Bloom, "of", lambda keys, column: whole(keys, column, bits))
    path = f"file://{tmp_path}/warc"
    rows = rows + [(200, "u", "plain"), (200, "u", "plain"), (4, "v", "plain")]
    warc.write_archives(pages_of(rows), path)
    assert read(spark, path) == expected(rows)


def test_no_payload_is_shuffled(pages_of, rows):
    responses, revisits = warc.decided(pages_of(rows).coalesce(2))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "payload" in plan(responses) and "Join" not in plan(responses) and plan(responses).count("Exchange") == plan(pages_of(rows).coalesce(2)).count("Exchange")
    assert "payload" not in plan(revisits)


def test_empty_table_and_foreign_files(spark, pages_of, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages_of([]), path)
    assert read(spark, path) == []
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.warc").write_bytes(b"garbage " * 400 + FAKE.encode())
    assert read(spark, f"file://{tmp_path}/other") == []
    # A record that runs past the end of its file is left out; the one before it stays.
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(FAKE.encode() + FAKE.encode()[:-6])
    assert len(read(spark, f"file://{tmp_path}/cut")) == 1


def test_jump_against_walking():
    rng = np.random.default_rng(1)
    for _ in range(200):
        offsets = np.unique(rng.integers(0, 60, rng.integers(1, 20)))
        after = offsets + rng.integers(1, 25, len(offsets))
        place, got = dict(zip(offsets.tolist(), after.tolist())), warc.jump(offsets, after, 60)
        for k, at in enumerate(offsets.tolist()):
            while at in place:
                at = place[at]
            assert got[k] == (at if at >= 60 else -1)
