import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from spendkit.llm import ranked_search as rs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    texts = [(d, terms_of(t)) for d, t in docs]
    held = [(d, Counter(w), len(w)) for d, w in texts if w]
    n, total = len(held), sum(m for _, _, m in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, m in held:
            norm = 75 + 25 * m * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * norm))
                for t in terms_of(text) if t in c
            )
            if score > 0:
                scored.append((-score, math.inf if d is None else d, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, k=rs.TOP, **sizes):
    got = rs.search_all(docs, spark.createDataFrame(items, "item_id long, text string"), k, **sizes).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str)


WORDS = [f"w{i}" for i in range(60)]


def many(n, seed=1):
    pick = np.random.default_rng(seed)
    return [(i, " ".join(WORDS[w] for w in np.minimum(pick.zipf(1.4, pick.integers(1, 40)), 60) - 1)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 7}, {"shard_postings": 20, "block_terms": 3}])
def test_against_every_score(spark, docs_of, sizes):
    docs = many(300)
    items = [(1, "w0 w1 w2 w2"), (2, "w30 W31, w32!"), (3, "w59"), (4, "w5 " * 9 + "nowhere"), (5, " ".join(WORDS))]
    assert result(spark, docs_of(docs), items, 20, **sizes) == brute(docs, items, 20)


def test_ties_repeated_rows_nulls_and_blank_texts(spark, docs_of):
    docs = [(i, "same words here") for i in range(30)] + [(None, "same words here"), (3, "same words here"), (40, None), (41, ""), (42, "...")]
    docs += [(50, "other Ünïcode 漢字 text"), (51, "x1 x2")]
    items = [(1, "same words"), (None, "漢字 ünïcode"), (2, None), (3, ""), (4, "?!"), (5, "x1"), (5, "x1")]
    got = result(spark, docs_of(docs), items, 20)
    assert got == brute(docs, items, 20)
    assert [r[2] for r in sorted(r for r in got if r[0] == 1)][:5] == [0, 1, 2, 3, 3]


def test_empty_tables(spark, docs_of):
    assert result(spark, docs_of([]), [(1, "a")]) == []
    assert result(spark, docs_of([(1, "a b")]), []) == []
    assert result(spark, docs_of([(1, "a b"), (2, None)]), [(1, "c")]) == []


def test_a_very_long_text(spark, docs_of):
    docs = [(1, "deep " * 400_000 + "end"), (2, "deep end"), (3, "else where")]
    items = [(1, "deep"), (2, "end of it")]
    assert result(spark, docs_of(docs), items) == brute(docs, items, 20)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(1, 8), st.integers(1, 40))
def test_search_of_one_shard(seed, lists, splits, leaf):
    pick = np.random.default_rng(seed)
    n = int(pick.integers(1, 200))
    held = [np.sort(pick.choice(n, pick.integers(1, n + 1), replace=False)) for _ in range(lists)]
    impacts = [pick.integers(1, 50, len(h)) for h in held]
    index = rs.Postings(np.array([len(h) for h in held]), np.concatenate(held), np.concatenate(impacts), n)
    weights, top = pick.integers(1, 9, lists), rs.Top(5)
    rs.search(index, np.arange(lists), weights, np.arange(n), top, splits, leaf)
    scores = np.zeros(n, np.int64)
    for w, h, i in zip(weights, held, impacts):
        scores[h] += w * i
    order = [d for d in np.lexsort((np.arange(n), -scores)) if scores[d] > 0][:5]
    assert top.ids.tolist() == order and top.scores.tolist() == scores[order].tolist()


def test_intervals_that_cannot_reach_the_best_are_left_out():
    n = 20_000
    docs, impacts = np.arange(n), np.ones(n, np.int64)
    impacts[777:780] = 1000
    index, top = rs.Postings(np.array([n]), docs, impacts, n), rs.Top(3)
    assert rs.search(index, np.array([0]), np.array([1]), docs, top, leaf=64) < n / 10
    assert top.ids.tolist() == [777, 778, 779]


def test_range_maximum():
    pick = np.random.default_rng(3)
    impacts = pick.integers(1, 9, 500)
    index = rs.Postings(np.array([500]), np.arange(500), impacts, 500)
    begin = pick.integers(0, 500, 300)
    end = np.minimum(begin + pick.integers(0, 300, 300), 500)
    high, where = index.best(begin, end)
    for b, e, h, w in zip(begin, end, high, where):
        assert h == (impacts[b:e].max() if e > b else 0) and (e == b or (b <= w < e and impacts[w] == h))
