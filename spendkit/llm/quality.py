"""Quality classifier: supervised subword embeddings.

A document is the average of the vectors of its words and of the character n-grams of its words, all hashed into one
table of buckets, followed by a linear layer and a softmax. Table and layer are learned together in numpy by
stochastic gradient descent, one document at a time, on a bounded sample of labelled documents. Scoring is linear in
the averaged vectors, so every bucket is projected on the difference of the two classes once; a task then looks up
one number per feature and averages per document, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sampling import least_hashes
from .text import slices

BUCKET_BITS = 17
NGRAMS = (3, 4)
DIM = 8
#: The sample: so many documents per label, none longer than so many characters (only for learning).
SAMPLE_PER_LABEL = 800
SAMPLE_CHARS = 20_000
EPOCHS = 8
RATE = 1.0
THRESHOLD = 0.3
#: Bytes of texts that are scored at once; a feature table takes some hundred bytes for each of them.
SCORE_BYTES = 1 << 18

_P, _K = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _bucket(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint32(15))) * _K
    return code >> np.uint32(32 - BUCKET_BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text of each) of all texts of a slice: words, n-grams of words with their borders, repeated words.

    A blank stands for the border of a word, so an n-gram may begin or end with one. A word that repeats the one
    before it is a feature of its own.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points[(points == 32) | ((points >= 9) & (points <= 13))] = 32
    n, blank = len(points), points == 32
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    last = starts[1:][text]  # where the text of each character ends
    position = np.arange(n)
    # The next blank after each character bounds its n-grams.
    stop = np.where(blank, position, n)
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], last)
    after = np.concatenate([stop[1:], [n]])
    found, owner = [], []
    code = points.copy()
    for size in range(2, max(NGRAMS) + 1):
        code = code[:-1] * _P + points[size - 1 :] if n >= size else code[:0]
        if size in NGRAMS and len(code):
            m = len(code)
            good = np.flatnonzero(position[:m] + size - 1 <= np.minimum(after[:m], last[:m] - 1))
            found.append(_bucket(code[good] + np.uint32(size)))
            owner.append(text[good])
    opens = np.concatenate([[True], blank[:-1]])
    opens[starts[:-1][starts[:-1] < n]] = True
    begin = np.flatnonzero(~blank & opens)
    if len(begin):
        powers = np.cumprod(np.full(n, _P, np.uint32), dtype=np.uint32)
        back = np.cumprod(np.full(n, pow(int(_P), -1, 1 << 32), np.uint32), dtype=np.uint32)
        sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(points * powers, dtype=np.uint32)])
        words = (sums[stop[begin]] - sums[begin]) * back[begin]
        found.append(_bucket(words + np.uint32(1)))
        owner.append(text[begin])
        again = np.flatnonzero((words[1:] == words[:-1]) & (text[begin][1:] == text[begin][:-1])) + 1
        found.append(np.full(len(again), _bucket(np.array([7], np.uint32))[0]))
        owner.append(text[begin][again])
    none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate([none[0], *found]), np.concatenate([none[1], *owner])


@dataclass
class Model:
    """`weight` of every bucket and `bias`: the logit of label 1 is their average plus the bias."""

    weight: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buckets, text = features(data, offsets)
        n = len(offsets) - 1
        count = np.bincount(text, minlength=n)
        total = np.bincount(text, self.weight[buckets], minlength=n)
        return total / np.maximum(count, 1) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Softmax probability of label 1 of every whole text; null and empty texts have the bias alone."""
        logits = [self.logits(data, offsets) for _, _, data, offsets in slices(texts, SCORE_BYTES)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(logits) if logits else np.zeros(0), -50, 50)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent on the softmax loss, one document at a time."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    rows = []
    for _, _, data, offsets in slices(pa.array(texts, pa.string()), 1):
        buckets, counts = np.unique(features(data, offsets)[0], return_counts=True)
        rows.append((buckets, (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            buckets, share = rows[i]
            rate = RATE * (1 - done / steps)
            hidden = share @ table[buckets]
            logits = layer @ hidden + bias
            odds = np.exp(logits - logits.max())
            slope = odds / odds.sum()
            slope[labels[i]] -= 1
            back = layer.T @ slope
            layer -= rate * np.outer(slope, hidden)
            bias -= rate * 0.1 * slope
            # A document's features move together: the shares are scaled to a root mean square of one step.
            table[buckets] -= rate * np.outer(share / np.sqrt((share**2).sum() + 1e-12), back)
            done += 1
    return Model((table @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, most_chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most `per_label` documents of each label, the first by a hash of the id.

    `labels` has doc_id and quality; rows without either are left out. With one label only, or none, every score is a half.
    """
    ids = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    hashed = ids.withColumn("hash", F.xxhash64("doc_id"))
    near = hashed.join(least_hashes(hashed, "quality", 2 * per_label), ["quality", "hash"], "left_semi")
    drawn = [near.where(F.col("quality") == q).orderBy(*order).limit(2 * per_label).drop("hash") for q in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.char_length("text").between(1, most_chars))
    # The sample has 4 * per_label ids at most.
    both = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    rows = [r for q in (0, 1) for r in both.where(F.col("quality") == q).orderBy(*order, "text").limit(per_label).collect()]
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["quality"]))
    if len({r["quality"] for r in rows}) < 2:
        return Model(np.zeros(1 << BUCKET_BITS), 0.0)
    return train([r["text"] for r in rows], [r["quality"] for r in rows])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.scores(batch["text"]))], ["doc_id", "score"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from `threshold` on).

    Only the text is read, as a whole; a null or empty text has the score of the bias alone. Repeated rows are scored each.
    An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(lambda batches: _score(batches, model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_rejected(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that score below `threshold`, with all their columns; one pass, no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch["text"]) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def hold_out(fold: int = 5):
    """Whether a row is kept from learning: crc32 of the id as text is a multiple of `fold`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 0, F.lit(False))
