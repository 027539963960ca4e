import random
import re

import numpy as np

from spendkit.llm import decontam
from spendkit.llm.text import ALNUM, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for item, text in items:
        ws = split(text)
        m = min(len(ws), 13)
        for s in range(len(ws) - m + 1 if m else 0):
            windows.setdefault(tuple(ws[s : s + m]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        ws, hit, found = split(text), set(), set()
        for m in lengths:
            for s in range(len(ws) - m + 1):
                own = windows.get(tuple(ws[s : s + m]))
                if own:
                    hit.update(range(s, s + m))
                    found |= own
        found.discard(None)
        out.append((i, len(ws), len(hit), len(found), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def result(docs, bench):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    return sorted((tuple(r) for r in decontam.contamination(docs, bench).select(*cols).collect()), key=repr)


def cases():
    rng = random.Random(4)
    few, many = ["a", "b"], [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(many) for _ in range(rng.choice([5, 12, 13, 14, 30, 60])))) for k in range(20)]
    items += [(30, " ".join(rng.choice(few) for _ in range(40))), (31, "Solo"), (32, "two words"), (33, "..."), (34, None), (7, items[3][1]), (None, "null item words here"), (35, "Ünïcode 42")]
    docs = []
    for k in range(150):
        body = [rng.choice(many) for _ in range(rng.randrange(60))]
        item = split(rng.choice(items)[1])
        cut = rng.randrange(len(item) + 1)
        piece = item[cut : cut + rng.choice([5, 12, 13, 20, 60])]
        at = rng.randrange(len(body) + 1)
        docs.append((k, rng.choice([" ", ", ", "\n", "--"]).join([*body[:at], *(x.upper() for x in piece), *body[at:]])))
    docs += [(200 + k, " ".join(rng.choice(few) for _ in range(80))) for k in range(10)]
    docs += [(300, None), (301, ""), (302, "!!!"), (0, docs[5][1]), (0, docs[5][1]), (None, items[4][1]), (303, "x " * 4000 + items[5][1] + " y" * 4000), (304, "solo"), ((1 << 60) + 1, "solo"), (305, "ünïcode 42")]
    return docs, items


def test_against_brute_force(spark, docs_of):
    docs, items = cases()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert result(docs_of(docs), bench) == brute(docs, items)


def test_contaminated_rows_go(spark, docs_of):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs_of(docs)
    kept = decontam.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    want = sorted((r[0] for r in brute(docs, items) if not r[5]), key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert result(docs_of([]), none) == []
    assert result(docs_of([(1, "some words")]), none) == [(1, 2, 0, 0, [], False)]
    assert result(docs_of([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")) == []


def test_every_shared_span_holds_a_common_fingerprint():
    rng = np.random.default_rng(2)
    for span in (1, 3, 5, 7, 13):
        shared = " ".join(f"s{x}" for x in rng.integers(0, 5, span))
        for _ in range(30):
            prints = []
            for _ in range(2):
                sides = [" ".join(f"s{x}" for x in rng.integers(0, 5, rng.integers(0, 30))) for _ in range(2)]
                text = f"{sides[0]} {shared} {sides[1]}".encode()
                found = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM)
                prints.append(set(decontam.winnowed(found.hashes, found.first, span)[1].tolist()))
            assert prints[0] & prints[1]
