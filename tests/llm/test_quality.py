import random
import re

import numpy as np
import pyarrow as pa
import pytest

from spendkit.llm import quality
from spendkit.llm.text import slices


def plain_features(text):
    """Number of features of one text, by plain string work."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = 0
    padded = re.sub(r"[\x20\x09-\x0D]", " ", text)
    for size in quality.NGRAMS:
        for k in range(len(padded) - size + 1):
            grams += " " not in padded[k + 1 : k + size - 1]
    return grams + len(words) + sum(a == b for a, b in zip(words, words[1:]))


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_features_do_not_depend_on_neighbours(most):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n  ü€😀") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "x", "a a a b b"]
    alone = []
    for text in texts:
        _, _, data, offsets = next(iter(slices(pa.array([text]))))
        alone.append(sorted(quality.features(data, offsets)[0].tolist()))
    together = []
    for row, end, data, offsets in slices(pa.array(texts), most):
        buckets, text = quality.features(data, offsets)
        together.extend(sorted(buckets[text == k].tolist()) for k in range(end - row))
    assert together == alone
    assert [len(x) for x in alone] == [plain_features(t) for t in texts]


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.learn(docs, labels.where(~quality.hold_out()))
    got = quality.score(docs, model).where(quality.hold_out()).join(labels, "doc_id").toPandas()
    assert len(got) > 500 and got["score"].between(0, 1).all()
    assert (got[got["quality"] == 0]["predicted"] == 0).mean() > 0.95
    assert (got[got["quality"] == 1]["predicted"] == 1).mean() > 0.99


def test_nulls_empty_and_repeated_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "plain text"), (3, "plain text"), (None, "w!! " * 50_000)]
    model = quality.Model(np.linspace(-1, 1, 1 << quality.BUCKET_BITS), 0.5)
    got = sorted(map(tuple, quality.score(docs_of(rows), model).collect()), key=repr)
    assert len(got) == 5 and got[0][1] == got[1][1] == pytest.approx(1 / (1 + np.exp(-0.5)))
    docs = docs_of(rows)
    kept = quality.drop_rejected(docs, model)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((g[0] for g in got if g[2]), key=repr)
    assert quality.score(docs_of([]), model).collect() == []


def test_no_labels_give_a_half(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs_of([(1, "a b"), (2, "c")]), labels)
    assert [r["score"] for r in quality.score(docs_of([(1, "x"), (2, None)]), model).collect()] == [0.5, 0.5]


def test_few_texts_are_scored_at_once(monkeypatch):
    seen, model = [], quality.Model(np.ones(1 << quality.BUCKET_BITS), 0.0)
    plain = quality.Model.logits
    monkeypatch.setattr(quality.Model, "logits", lambda self, data, offsets: seen.append(len(data)) or plain(self, data, offsets))
    scores = model.scores(pa.array(["word " * 4000] * 60))
    assert len(scores) == 60 and max(seen) <= 1 << 18 and sum(seen) == 60 * 20_000
