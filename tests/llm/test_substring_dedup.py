import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from spendkit.llm import substring_dedup as sd


def brute(rows, window):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    held = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if held[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def result(docs, **sizes):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in sd.drop_repeats(docs, **sizes).collect()), key=str)


def prose(n, seed, kinds=5000):
    return [f"v{x}" for x in np.random.default_rng(seed).integers(0, kinds, n)]


def rows():
    shared, other = prose(60, 1), prose(35, 2)
    out = [(i, " ".join(prose(20 + i, 100 + i) + shared + prose(15, 200 + i))) for i in range(8)]
    out += [(10, " ".join(other)), (11, " ".join(["Front"] + other)), (12, "\t".join(other[:34])), (13, " \n".join(other + ["back"]))]
    out += [(20, " ".join(prose(50, 3) + ["x"] + prose(50, 3))), (21, "a " * 90), (22, "b " * 35), (23, "b " * 34)]
    out += [(30, " ".join(prose(80, 4))), (31, " ".join(prose(80, 4))), (31, " ".join(prose(80, 4))), (None, " ".join(prose(80, 4)))]
    return out + [(40, None), (41, ""), (42, " \n\t"), (43, " ".join(prose(300, 5))), (44, " ".join(x.upper() for x in prose(300, 5)))]


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 300}, {"anchor_segments": 1}, {"gram": 5}, {"gram": 35}, {"gram": 20, "anchor_segments": 3}])
def test_against_all_windows(docs_of, sizes):
    assert result(docs_of(rows()), **sizes) == brute(rows(), sd.WINDOW)


@pytest.mark.parametrize("seed", [1, 2])
def test_few_words_many_repeats(docs_of, seed):
    docs = [(i, " ".join(prose(40, seed * 100 + i, 2))) for i in range(60)]
    assert result(docs_of(docs), window=8, gram=3, anchor_segments=5) == brute(docs, 8)


def test_a_frequent_passage_in_changing_surroundings(docs_of):
    """Its anchor has more segments than stay together, so its windows are dealt one by one."""
    shared = prose(40, 1)
    docs = [(i, " ".join(prose(30, 100 + i, 9) + shared + prose(30, 500 + i, 9))) for i in range(200)]
    assert result(docs_of(docs, 5), anchor_segments=20) == brute(docs, sd.WINDOW)


def test_very_long_text_and_empty_table(docs_of):
    long = prose(150_000, 7)
    docs = [(1, " ".join(long)), (2, " ".join(long[70_000:70_100])), (3, " ".join(prose(50, 8)))]
    got = result(docs_of(docs))
    assert [(r[0], r[1], r[2]) for r in got] == [(1, 150_000, 100), (2, 100, 100), (3, 50, 0)]
    assert result(docs_of([])) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6))
def test_backward_search_counts_occurrences(texts):
    symbols = np.concatenate([np.array([*t, 0]) for t in texts])
    index = sd.FMIndex(symbols)
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + 5) + 1):
                low, high = np.zeros(1, np.int64), np.array([len(symbols)])
                for c in reversed(t[i:j]):
                    low, high = index.prolong(np.array([c]), low, high)
                assert int(high[0] - low[0]) == sum(u[k : k + j - i] == t[i:j] for u in texts for k in range(len(u)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=6, max_size=25), min_size=1, max_size=5))
def test_windows_of_an_index(texts):
    window, held = 6, Counter()
    for t in texts:
        held.update(tuple(t[k : k + window]) for k in range(len(t) - window + 1))
    symbols = np.concatenate([np.array([*t, 0]) for t in texts])
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    marks = sd.repeated_windows(sd.FMIndex(symbols), symbols, begins, sizes - window + 1, window)
    for t, m in zip(texts, marks.tolist()):
        assert [bool(m >> k & 1) for k in range(len(t) - window + 1)] == [held[tuple(t[k : k + window])] > 1 for k in range(len(t) - window + 1)]
