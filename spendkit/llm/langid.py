"""Language ID: a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes; one unit reads a window forwards, one backwards, and both states at a byte give
the language probabilities of that position. The probabilities of all positions of a document are averaged. The network
is trained in numpy by backpropagation through time on a bounded sample of labelled documents; the embedding of a byte
is folded into the input weights, so a step is a table lookup and one small product for thousands of windows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.common import best_rows
from .sampling import least_hashes
from .text import slices

HIDDEN = 8
WINDOW = 64
#: Windows that are run at once; bounds the memory of a task.
LANES = 2048
#: The sample: so many documents per language, so many windows of each.
SAMPLE_PER_LANG = 200
WINDOWS_PER_TEXT = 6
SAMPLE_BYTES = 100_000
STEPS = 350
LANES_TRAIN = 128
RATE = 0.02
UNKNOWN = "und"


@dataclass
class Unit:
    """A gated recurrent unit; rows of the tables are update, reset and candidate, features first, lanes last."""

    table: np.ndarray  # (3H, 256) input weights of every byte, with the biases
    back: np.ndarray  # (3H, H) recurrent weights
    bias: np.ndarray  # (H, 1) recurrent bias of the candidate

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Unit:
        h = HIDDEN
        return cls(
            rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32), rng.normal(0, 0.35, (3 * h, h)).astype(np.float32),
            np.zeros((h, 1), np.float32),
        )

    def run(self, bytes_: np.ndarray, live: np.ndarray | None, keep: bool = False):
        """States (T, H, lanes) for `bytes_` (T, lanes); a lane whose `live` is 0 stays at zero. `keep` for training."""
        steps, lanes = bytes_.shape
        h2 = 2 * HIDDEN
        states = np.empty((steps, HIDDEN, lanes), np.float32)
        state = np.zeros((HIDDEN, lanes), np.float32)
        kept = []
        for t in range(steps):
            given = np.take(self.table, bytes_[t], axis=1)
            own = self.back @ state
            gates = np.tanh((given[:h2] + own[:h2]) * np.float32(0.5))
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            recur = own[h2:] + self.bias
            new = np.tanh(given[h2:] + gates[HIDDEN:] * recur)
            before = state
            state = new + gates[:HIDDEN] * (state - new)
            if live is not None:
                state *= live[t]
            states[t] = state
            if keep:
                kept.append((before, gates, recur, new))
        return (states, kept) if keep else states

    def learn(self, bytes_: np.ndarray, kept: list, slopes: np.ndarray, live: np.ndarray | None = None) -> Unit:
        """Gradients by backpropagation through time; `slopes` (T, H, lanes) is the loss by the states, `live` as in run()."""
        table, back, bias = np.zeros_like(self.table), np.zeros_like(self.back), np.zeros_like(self.bias)
        carried = np.zeros_like(slopes[0])
        for t in range(len(bytes_) - 1, -1, -1):
            before, gates, recur, new = kept[t]
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            d = slopes[t] + carried
            if live is not None:
                d = d * live[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * recur * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_new * r])
            carried = d * z + self.back.T @ d_own
            back += d_own @ before.T
            bias += (d_new * r).sum(axis=1, keepdims=True)
            given = np.concatenate([d_z, d_r, d_new])
            for k in range(3 * HIDDEN):
                table[k] += np.bincount(bytes_[t], given[k], minlength=256)
        return Unit(table, back, bias)


@dataclass
class Network:
    """Forward and backward unit, and the layer that reads both states at a position."""

    langs: list[str]
    ahead: Unit
    behind: Unit
    layer: np.ndarray  # (K, 2H)
    bias: np.ndarray  # (K, 1)

    def probabilities(self, bytes_: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """(T, K, lanes): the languages of every position."""
        ahead = self.ahead.run(bytes_, live)
        behind = self.behind.run(bytes_[::-1], None if live is None else live[::-1])[::-1]
        odds = np.matmul(self.layer[:, :HIDDEN], ahead)
        odds += np.matmul(self.layer[:, HIDDEN:], behind)
        odds += self.bias
        np.exp(odds, out=odds)
        odds /= odds.sum(axis=1, keepdims=True)
        return odds

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, K): the mean over all positions of every text of a slice; texts without bytes are 0."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        length = np.diff(offsets)
        whole = length // WINDOW
        for part in (False, True):
            if part:  # what is left behind the whole windows
                text = np.flatnonzero(length % WINDOW)
                begin, size = (offsets[:-1] + whole * WINDOW)[text], (length % WINDOW)[text]
                order = np.argsort(size, kind="stable")
                text, begin, size = text[order], begin[order], size[order]
            else:
                text = np.repeat(np.arange(len(length)), whole)
                nth = np.arange(len(text)) - np.repeat(np.cumsum(whole) - whole, whole)
                begin, size = offsets[:-1][text] + nth * WINDOW, np.full(len(text), WINDOW)
            for lane in range(0, len(text), LANES):
                these, sizes = slice(lane, lane + LANES), size[lane : lane + LANES]
                steps = np.arange(sizes.max())
                live = (steps[:, None] < sizes).astype(np.float32) if part else None
                spots = begin[these] + steps[:, None]
                odds = self.probabilities(data[np.minimum(spots, len(data) - 1) if part else spots], live)
                if part:
                    odds *= live[:, None, :]
                sums = odds.sum(axis=0, dtype=np.float64)
                for k in range(len(self.langs)):
                    out[:, k] += np.bincount(text[these], sums[k], minlength=len(out))
        return out / np.maximum(length, 1)[:, None]


def train(texts: list[bytes], langs: list[str], seed: int = 11) -> Network:
    """Adam on the cross entropy of every position, over windows drawn from the texts; a shorter text is one masked window."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    windows, sizes, labels = [], [], []
    for text, lang in zip(texts, langs):
        if len(text) >= WINDOW:
            for begin in rng.integers(0, len(text) - WINDOW + 1, WINDOWS_PER_TEXT):
                windows.append(np.frombuffer(text, np.uint8, WINDOW, begin))
                sizes.append(WINDOW)
                labels.append(names.index(lang))
        elif text:
            windows.append(np.frombuffer(text.ljust(WINDOW, b"\0"), np.uint8))
            sizes.append(len(text))
            labels.append(names.index(lang))
    net = Network(names, Unit.fresh(rng), Unit.fresh(rng), rng.normal(0, 0.3, (len(names), 2 * HIDDEN)).astype(np.float32), np.zeros((len(names), 1), np.float32))
    if not windows or len(names) < 2:
        net.layer[:] = 0
        return net
    windows, sizes, labels = np.array(windows), np.array(sizes), np.array(labels)
    # Languages weigh the same however many windows they have.
    odds = (1 / np.bincount(labels, minlength=len(names)).clip(1))[labels]
    parameters = [net.ahead.table, net.ahead.back, net.ahead.bias, net.behind.table, net.behind.back, net.behind.bias, net.layer, net.bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(STEPS):
        drawn = rng.choice(len(windows), LANES_TRAIN, p=odds / odds.sum())
        bytes_, label = windows[drawn].T, labels[drawn]
        live = (np.arange(WINDOW)[:, None] < sizes[drawn]).astype(np.float32)
        ahead, kept = net.ahead.run(bytes_, live, True)
        turned, live_turned = bytes_[::-1], live[::-1]
        behind, kept_behind = net.behind.run(turned, live_turned, True)
        states = np.concatenate([ahead, behind[::-1]], axis=1)
        slope = np.matmul(net.layer, states) + net.bias
        slope = np.exp(slope - slope.max(axis=1, keepdims=True))
        slope /= slope.sum(axis=1, keepdims=True)
        slope[:, label, np.arange(len(label))] -= 1
        slope *= live[:, None, :] / live.sum()
        down = np.matmul(net.layer.T, slope)
        a = net.ahead.learn(bytes_, kept, down[:, :HIDDEN], live)
        b = net.behind.learn(turned, kept_behind, down[::-1, HIDDEN:], live_turned)
        layer = np.einsum("tkl,thl->kh", slope, states)
        slopes = [a.table, a.back, a.bias, b.table, b.back, b.bias, layer, slope.sum(axis=(0, 2))[:, None]]
        rate = RATE * (1 - step / STEPS)
        for p, g, m, v in zip(parameters, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return net


def learn(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, most_bytes: int = SAMPLE_BYTES) -> Network:
    """A network from at most `per_lang` documents of each language (text and lang), the first by a hash of the text.

    Texts of 1 to `most_bytes` bytes; rows without a language are left out.
    """
    text = F.col("text").cast("string")
    rows = docs.select("lang", text.alias("text"), F.xxhash64(text).alias("hash"))
    rows = rows.where(F.col("lang").isNotNull() & F.octet_length("text").between(1, most_bytes))
    # Only hashes are ranked, each once, so copies do not fill the sample; then the texts of the drawn ones are fetched.
    drawn = best_rows(least_hashes(rows, "lang", per_lang), ["lang"], [F.col("hash")], per_lang)
    found = rows.join(F.broadcast(drawn), ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"])
    sample = sorted((r["lang"], r["hash"], r["text"]) for r in found.collect())
    if not sample:
        units = [Unit.fresh(np.random.default_rng(0)) for _ in range(2)]
        return Network([UNKNOWN], *units, np.zeros((1, 2 * HIDDEN), np.float32), np.zeros((1, 1), np.float32))
    return train([t.encode() for _, _, t in sample], [lang for lang, _, _ in sample])


def _identify(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lettered = pc.fill_null(pc.match_substring_regex(batch["text"], r"\pL"), False).to_numpy(zero_copy_only=False)
        pooled = [net.pooled(data, offsets) for _, _, data, offsets in slices(batch["text"])]
        pooled = np.concatenate(pooled) if pooled else np.zeros((0, len(net.langs)))
        best = pooled.argmax(axis=1)
        names = [net.langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
        scores = np.where(lettered, np.clip(pooled[np.arange(len(best)), best], 0, 1), 0.0)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score (mean probability of the language over all bytes).

    Every whole text is read, nothing else. A null text or one without a letter is `und` with score 0. Repeated rows
    are labelled each; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _identify(batches, net), "doc_id long, lang_pred string, score double")


def hold_out(fold: int = 4, held: int = 2):
    """Whether a row is kept from learning: crc32 of the id as text modulo `fold` is `held`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
