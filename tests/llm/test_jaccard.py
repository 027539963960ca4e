import random
import re

import numpy as np
import pyarrow as pa

from spendkit.llm import jaccard
from spendkit.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute(rows):
    """Components over rows: (doc_id, number of shingles, smallest id)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def cases(seed, copies):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows, k = [], 0

    def add(text):
        nonlocal k
        rows.append((k, text))
        k += 1

    # A large group of near copies, edited so that many pairs stand on either side of the threshold.
    base = [word() for _ in range(150)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = word()
        add(" ".join(own))
    for _ in range(60):  # a passage that is most of a document
        add(" ".join([*passage, *(word() for _ in range(rng.randrange(4, 60)))]))
    for _ in range(40):  # chains
        own = [word() for _ in range(rng.randrange(1, 80))]
        for _ in range(rng.randrange(1, 5)):
            add(rng.choice(["  ", "\n", " "]).join(own))
            own[rng.randrange(len(own))] = word().upper()
    for text in (None, "", "  \n", "one", "One", "one two three four", "one two three four", "a a a a a a a a a", "a a a a a", "z" * 5000):
        add(text)
    rows.extend([(3, rows[3][1]), (None, rows[3][1]), (None, "nobody has this text at all"), (None, None), (5, "another text under a used id")])
    return rows


def result(docs):
    return sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=repr)


def test_against_brute_force(docs_of):
    rows = cases(1, 150)
    assert result(docs_of(rows)) == brute(rows)


def test_one_row_of_each_component_stays(docs_of):
    rows = [(2, "a b c d e f"), (1, "A b c d e f"), (1, "a b  c d e f"), (1, "a b  c d e f"), (4, "other words are here now"), (5, ""), (6, None), (None, "a b c d e f"), (None, "z y x")]
    docs = docs_of(rows)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 4, 5, 6, None]


def test_empty_table(docs_of):
    assert result(docs_of([])) == []
    assert jaccard.drop_near_duplicates(docs_of([])).collect() == []


def test_product_over_small_batches_finds_what_one_batch_finds():
    """Rows of a column that is cut by the end of a batch, hot or not."""
    rng = np.random.default_rng(3)
    gram = np.sort(rng.integers(0, 12, 900))
    key = rng.integers(1, 400, 900)
    order = np.lexsort((key, gram))
    n, at = np.full(900, 50, np.int32), np.zeros(900, np.int32)
    whole = pa.record_batch([pa.array(x) for x in (gram[order], key[order], n, at)], ["gram", "key", "n", "at"])

    def run(size):
        cut = [whole.slice(k, size) for k in range(0, 900, size)]
        pairs, hot = set(), set()
        for out in jaccard._multiply(iter(cut)):
            for a, b, g in zip(out["key"].to_pylist(), out["b"].to_pylist(), out["gram"].to_pylist()):
                (pairs if b is not None else hot).add((a, b if b is not None else g))
        return pairs, hot

    assert run(900)[1] == {(int(k), int(g)) for g, k in zip(gram, key) if len(set(key[gram == g])) > jaccard.HOT}
    for size in (1, 7, 64, 333):
        assert run(size) == run(900)


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        universe = rng.permutation(rng.integers(6, 60))
        a, b = (np.sort(rng.choice(universe, rng.integers(1, len(universe) + 1), replace=False)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        assert both >= jaccard.least_overlap(len(a), len(b))
        p, q = jaccard.prefix_length(len(a)), jaccard.prefix_length(len(b))
        shared = np.intersect1d(a[:p], b[:q])
        found = [jaccard._bounded(*(np.array([x]) for x in (len(a), np.searchsorted(a, s), len(b), np.searchsorted(b, s))))[0] for s in shared]
        assert any(found)


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    nodes = rng.sample(range(10_000), 300)
    links = [(a, b) for a, b in zip(nodes[:200], nodes[1:200])] + [(nodes[250], x) for x in nodes[251:]]
    links += [(b, a) for a, b in links[:20]] + [(nodes[0], nodes[0])]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), 3).collect()}
    assert got == {**{x: min(nodes[:200]) for x in nodes[:200]}, **{x: min(nodes[250:]) for x in nodes[250:]}}
    assert components(spark.createDataFrame([], "a long, b long"), 1).collect() == []


def test_very_hot_columns_are_joined_with_their_pivots(docs_of, monkeypatch):
    """Every column of more than 20 rows is one that no task sorts; several partitions hold its rows."""
    rows = cases(2, 200)
    monkeypatch.setattr(jaccard, "SORTED", 20)
    monkeypatch.setattr(jaccard, "HOT", 8)
    assert result(docs_of(rows, 6)) == brute(rows)


def test_square_blocks_alone_find_every_link(docs_of, monkeypatch):
    rows = cases(3, 120)
    for name, value in (("SORTED", 10), ("HOT", 4), ("STARS", 1), ("ROUNDS", 0), ("BLOCK", 8)):
        monkeypatch.setattr(jaccard, name, value)
    assert result(docs_of(rows, 5)) == brute(rows)


def test_bounds_as_columns(spark):
    rng = np.random.default_rng(4)
    n, m = rng.integers(1, 60, 400), rng.integers(1, 60, 400)
    i, j = rng.integers(0, 60, 400) % n, rng.integers(0, 60, 400) % m
    table = spark.createDataFrame([tuple(map(int, r)) for r in zip(n, i, m, j)], "n int, i int, m int, j int")
    got = [r[0] for r in table.select(jaccard.bounded(*(jaccard.F.col(c) for c in "nimj"))).collect()]
    assert got == jaccard._bounded(n, i, m, j).tolist() and any(got)


def test_overlaps_are_sums_over_blocks_of_columns():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(2)]
    sets[1] = np.unique(np.concatenate([sets[0][:280], sets[1][:20]]))
    profiles = [jaccard.profile(s) for s in sets]
    pair = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([len(sets[0])]), pa.array([profiles[0]]), pa.array([len(sets[1])]), pa.array([profiles[1]])],
                           ["a", "b", "left_n", "left", "right_n", "right"])
    state, sums = next(jaccard._possible([pair])), []
    for k, (low, high) in enumerate(zip(jaccard.COLUMN_BLOCKS, jaccard.COLUMN_BLOCKS[1:])):
        part = [s[(jaccard.part_of(s) >= low) & (jaccard.part_of(s) < high)].tobytes() for s in sets]
        state = next(jaccard._accumulate([state.append_column("left", pa.array(part[:1])).append_column("right", pa.array(part[1:]))], k))
        sums += state["sum"].to_pylist()
    assert len(sums) == 2 and 0 < sums[0] < sums[1] == len(np.intersect1d(*sets))
