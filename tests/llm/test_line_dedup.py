import random

import pytest

from spendkit.llm import line_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(float("inf") if i is None else i)
    out = []
    for i, text in rows:
        own, lines = float("inf") if i is None else i, (text or "").split("\n")
        gone = [len(k) >= 10 and len(held[k]) >= min_docs and own > min(held[k]) for k in map(key, lines)]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_against_brute_force(docs_of, min_docs):
    rng = random.Random(1)
    pool = ["a common line here", " A Common Line HERE\r", "short", "", "exactly 10", "nine char", "ünïcödé lîne", " kept blank line", "x" * 3000]
    rows = [(k, "\n".join(rng.choice([*pool, f"own line number {k}"]) for _ in range(rng.randrange(8)))) for k in range(120)]
    rows += [(5, "a common line here\nother text 5"), (5, "a common line here"), (None, "a common line here"), (None, "lonely null line\nlonely null line"), (300, None), (301, "")]
    got = line_dedup.dedup_lines(docs_of(rows), min_docs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, min_docs)


def test_empty_table(docs_of):
    assert line_dedup.dedup_lines(docs_of([])).collect() == []


def test_lines_that_meet_in_one_hash_stay(spark, docs_of):
    one, two = "@k7c6hje------------------------4[lix<}r========================", '-7s+f7g=------------------------vc+@":)$========================'
    docs = docs_of([(1, one), (2, two)])
    assert line_dedup.exploded(docs, 10).select("h1").distinct().count() == 1
    got = {r["doc_id"]: (r["kept_text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (one, 0), 2: (two, 0)}
