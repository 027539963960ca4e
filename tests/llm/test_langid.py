import numpy as np
import pyarrow as pa

from spendkit.llm import langid
from spendkit.llm.text import slices


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    unit = langid.Unit.fresh(rng)
    for name in ("table", "back", "bias"):
        setattr(unit, name, getattr(unit, name).astype(np.float64))
    bytes_ = rng.integers(97, 103, (7, 5))
    weight = rng.normal(size=(7, langid.HIDDEN, 5))
    loss = lambda: float((unit.run(bytes_, None) * weight).sum())
    _, kept = unit.run(bytes_, None, True)
    slopes = unit.learn(bytes_, kept, weight)
    for name, at in (("table", (3, 99)), ("table", (20, 100)), ("back", (2, 5)), ("back", (19, 1)), ("bias", (4, 0))):
        values = getattr(unit, name)
        before, step = values[at], 1e-3
        values[at] = before + step
        up = loss()
        values[at] = before - step
        down = loss()
        values[at] = before
        assert abs((up - down) / (2 * step) - getattr(slopes, name)[at]) < 2e-2 * max(1, abs(getattr(slopes, name)[at]))


def test_pooling_covers_every_byte():
    """Windows, what is left behind them and lanes of other texts make no difference to a document."""
    rng = np.random.default_rng(1)
    net = langid.Network(["x", "y"], langid.Unit.fresh(rng), langid.Unit.fresh(rng), rng.normal(0, 1, (2, 2 * langid.HIDDEN)).astype(np.float32), np.zeros((2, 1), np.float32))
    texts = ["".join(map(chr, rng.integers(32, 300, n))) for n in (0, 1, 63, 64, 65, 500, 3000, 2)]
    _, _, data, offsets = next(iter(slices(pa.array(texts))))
    got = net.pooled(data, offsets)
    for k, text in enumerate(texts):
        raw, parts = np.frombuffer(text.encode(), np.uint8), []
        for begin in range(0, len(raw), langid.WINDOW):
            parts.append(net.probabilities(raw[begin : begin + langid.WINDOW, None])[:, :, 0])
        want = np.concatenate(parts).mean(axis=0) if parts else np.zeros(2)
        assert np.allclose(got[k], want, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    net = langid.learn(docs.where(~langid.hold_out()))
    got = langid.identify(docs, net).where(langid.hold_out()).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 1000 and (got["lang_pred"] == got["lang"]).mean() > 0.96
    assert got["score"].between(0, 1).all()


def test_nulls_and_texts_without_letters(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "123 --- !"), (4, "letters"), (4, "letters"), (None, "é"), (5, "word " * 30_000), (6, "some more words " * 9)])
    net = langid.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == got[None][0] == got[5][0] == "en"
    assert langid.identify(docs_of([]), net).collect() == []
    assert langid.learn(docs_of([])).langs == ["und"]


def test_short_texts_are_learned(spark):
    short = [(k, f"zu wo xu {k % 7} wuzo", "zz") for k in range(60)]
    docs = spark.createDataFrame(short + [(100 + k, f"some more words of text {k} " * 9, "en") for k in range(60)], "doc_id long, text string, lang string")
    net = langid.learn(docs)
    assert net.langs == ["en", "zz"]
    got = langid.identify(docs, net).join(docs, "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_gradients_of_masked_lanes():
    """Bytes behind a short text change no gradient."""
    rng = np.random.default_rng(2)
    unit = langid.Unit.fresh(rng)
    bytes_, weight = rng.integers(97, 103, (7, 3)), rng.normal(size=(7, langid.HIDDEN, 3)).astype(np.float32)
    for dead in (slice(4, 7), slice(0, 3)):
        live, alive = np.ones((7, 3), np.float32), slice(0, 4) if dead.start else slice(3, 7)
        live[dead] = 0
        _, kept = unit.run(bytes_, live, True)
        got = unit.learn(bytes_, kept, weight * live[:, None, :], live)
        _, kept = unit.run(bytes_[alive], None, True)
        want = unit.learn(bytes_[alive], kept, weight[alive])
        assert all(np.allclose(getattr(got, k), getattr(want, k), atol=1e-5) for k in ("table", "back", "bias"))
