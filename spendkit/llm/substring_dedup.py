"""Substring dedup: windows of words that occur elsewhere are found with an FM-index per shard.

Shards by content. Of the grams (12 words) inside a window (35 words) the one with the least hash is its anchor, so equal
windows have equal anchors wherever they stand. Consecutive windows with one anchor are a segment; a segment goes to the
shard of its anchor, and a window can only meet its equals there. Anchors that occur once in the corpus need no
search: anchors are counted first, and only segments of repeated ones move. A task sends a segment once, however many
copies it has. An anchor with very many segments (a frequent passage in changing surroundings) is dealt out further: its
segments are cut into single windows, and these are dealt by their own hash.

Search. Segments are shuffled once, sorted by shard and hash, so copies from several tasks meet as neighbours. A shard holds the BWT of its segments in a bit-packed wavelet matrix over its words. The documents' segments are
streamed through it: backward search prolongs a match word by word to the left while it occurs at least twice,
which gives the matching statistics at the ends that matter: where a match breaks, all windows across that place are
settled. Windows that occur twice come back as bits per segment, to every document that holds the segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import Bloom, cut_lineage
from .text import BLANK, Words, grams, mix, rolling, slices, words

WINDOW = 35
GRAM = 12
#: Words of one index, and segments of one anchor that stay together.
SHARD_WORDS = 1 << 20
ANCHOR_SEGMENTS = 1 << 15

#: Words `[^\x20\x09-\x0D]+`, unchanged.
EXACT = (np.arange(256, dtype=np.uint8), BLANK[1])

DEALT = "key long, h1 long, h2 long, body binary"
PARTS = "p1 long, p2 long, at int, h1 long, h2 long"
PLACES = "t1 long, t2 long, at int, h1 long, h2 long"
FOUND = "h1 long, h2 long, marks long"


def segments(found: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, anchor) of every segment of a slice.

    The anchor of a window is its leftmost gram with the least hash.
    """
    n, each = len(found.hashes), mix(grams(found.hashes, gram), gram)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.view(np.uint64)
    least, width, many = np.arange(n), 1, window - gram + 1
    while width < many:  # by doubling
        step = min(width, many - width)
        left, right = least[: n - step], least[step:]
        least[: n - step] = np.where(each[right] < each[left], right, left)
        width += step
    room = np.repeat(found.first[1:], np.diff(found.first)) - np.arange(n)
    at = np.flatnonzero(room >= window)
    if not len(at):
        return none, none, none.view(np.uint64)
    anchor = least[at]
    new = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(anchor) != 0)))
    return at[new], np.diff(np.append(new, len(at))), each[anchor[new]]


def _grams(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """How many segments each anchor has, counted per slice."""
    for batch in batches:
        for _, _, data, offsets in slices(batch["text"]):
            anchors, counts = np.unique(segments(words(data, offsets, EXACT), window, gram)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(counts, pa.int64())], ["anchor", "n"])


def _spaced(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space behind each, and where each begins (and the last ends)."""
    sizes = found.ends - found.starts + 1
    until = np.append(0, np.cumsum(sizes))
    if not len(sizes):
        return np.zeros(0, np.uint8), until
    source = np.repeat(found.starts - until[:-1], sizes) + np.arange(until[-1])
    out = found.low[np.minimum(source, len(found.low) - 1)]
    out[until[1:] - 1] = 0x20
    return out, until


def _wanted(found: Words, window: int, gram: int, repeated: Bloom) -> tuple[np.ndarray, ...]:
    """(first word, end word, anchor, two hashes) of the segments whose anchor may be repeated."""
    first, many, anchor = segments(found, window, gram)
    kept = repeated.has(anchor)
    first, end, anchor = first[kept], (first + many + window - 1)[kept], anchor[kept]
    return first, end, anchor, *_hashes(found, first, end)


def _hashes(found: Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rolling(found.hashes, first, end), rolling(mix(found.hashes, 1), first, end)


class _Sent:
    """What a task has sent: a body once, and one row without it to say that there are more."""

    def __init__(self):
        self.times: dict[int, int] = {}

    def choose(self, codes: np.ndarray) -> tuple[list[int], list[bool]]:
        """Places of the rows to send, and whether with their body."""
        at, whole, times = [], [], self.times
        for k, code in enumerate(codes.tolist()):
            sent = times.get(code, 0)
            if sent < 2:
                times[code] = sent + 1
                at.append(k)
                whole.append(not sent)
        return at, whole


def _windows_of(first: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of all windows of the segments."""
    many = end - first - window + 1
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)


def _deal(batches: Iterator[pa.RecordBatch], window: int, gram: int, repeated: Bloom, hot: Bloom) -> Iterator[pa.RecordBatch]:
    """Segments with their words joined by a space, keyed by their anchor; those of hot anchors as single windows."""
    sent, cut = _Sent(), _Sent()
    for batch in batches:
        for _, _, data, offsets in slices(batch["text"]):
            found = words(data, offsets, EXACT)
            text, until = _spaced(found)

            def rows(held: _Sent, key: np.ndarray, first: np.ndarray, end: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
                at, whole = held.choose(h1)
                spans = zip(until[first[at]].tolist(), until[end[at]].tolist(), whole)  # noqa: B023
                bodies = [text[i : j - 1].tobytes() if w else None for i, j, w in spans]  # noqa: B023
                return pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (key, h1, h2)), pa.array(bodies, pa.binary())], _names(DEALT))

            first, end, anchor, h1, h2 = _wanted(found, window, gram, repeated)
            is_hot = hot.has(anchor)
            cold = ~is_hot
            yield rows(sent, anchor[cold], first[cold], end[cold], h1[cold], h2[cold])
            if is_hot.any():
                # All windows of a copy are copies, so two of a segment are enough.
                some = np.flatnonzero(is_hot)[sent.choose(h1[is_hot])[0]]
                of, at = _windows_of(first[some], end[some], window)
                begin = first[some][of] + at
                w1, w2 = _hashes(found, begin, begin + window)
                yield rows(cut, w1, begin, begin + window, w1, w2)


def _parts(batches: Iterator[pa.RecordBatch], window: int, gram: int, repeated: Bloom, hot: Bloom) -> Iterator[pa.RecordBatch]:
    """The windows of the segments of hot anchors: (hashes of the segment, place in it, hashes of the window)."""
    sent = _Sent()
    for batch in batches:
        for _, _, data, offsets in slices(batch["text"]):
            found = words(data, offsets, EXACT)
            first, end, anchor, h1, h2 = _wanted(found, window, gram, repeated)
            some = np.flatnonzero(hot.has(anchor))
            at, whole = sent.choose(h1[some])
            some = some[np.array(at, np.int64)[np.array(whole, bool)]]
            of, at = _windows_of(first[some], end[some], window)
            begin = first[some][of] + at
            columns = [h1[some][of], h2[some][of], at.astype(np.int32), *_hashes(found, begin, begin + window)]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], _names(PARTS))


def _places(batches: Iterator[pa.RecordBatch], window: int, gram: int, repeated: Bloom) -> Iterator[pa.RecordBatch]:
    """Where the segments stand."""
    for batch in batches:
        keys = [batch[c].to_numpy() for c in ("t1", "t2")]
        for row, end_row, data, offsets in slices(batch["text"]):
            found = words(data, offsets, EXACT)
            first, _, _, h1, h2 = _wanted(found, window, gram, repeated)
            text = np.searchsorted(found.first, first, "right") - 1
            columns = [*(k[row:end_row][text] for k in keys), (first - found.first[text]).astype(np.int32), h1.view(np.int64), h2.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _names(PLACES))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By doubling. Every separator (0) is a symbol of its own, so no comparison runs past one."""
    n, separators = len(symbols), symbols == 0
    rank = np.where(separators, np.cumsum(separators) - 1, symbols + int(separators.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2


class WaveletMatrix:
    """A sequence of numbers as bit-packed levels with counts per 64 bits: how often a number stands before a place."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, rest = [], sequence
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((rest >> shift) & 1).astype(bool)
            packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, bool)), bitorder="little").view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1]
            self.levels.append((shift, packed, before, len(bits) - int(bits.sum())))
            rest = np.concatenate([rest[~bits], rest[bits]])
        self.begin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for shift, packed, before, zeros in self.levels:
            word = place >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where((symbol >> shift) & 1 == 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._down(symbol, place) - self.begin[symbol]


class FMIndex:
    """Backward search over texts that are each closed by 0."""

    def __init__(self, symbols: np.ndarray):
        self.size, kinds = len(symbols), int(symbols.max(initial=0)) + 1
        self.bwt = WaveletMatrix(symbols[suffix_array(symbols) - 1], kinds)
        self.smaller = np.append(0, np.cumsum(np.bincount(symbols, minlength=kinds)))[:-1]

    def prolong(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with `symbol` and go on as those in [low, high)."""
        both = self.smaller[np.concatenate([symbol, symbol])] + self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(symbol)], both[len(symbol) :]


def repeated_windows(index: FMIndex, symbols: np.ndarray, begins: np.ndarray, many: np.ndarray, window: int) -> np.ndarray:
    """Bits of the windows, `many` from `begins` on, that the index holds twice; all segments move on together.

    Undecided windows of a segment are a range [low, high]. From the end of the last one a match is prolonged to
    the left. If it reaches `low`, all are repeated; if it breaks, the windows right of the break are repeated and
    the last one across it is not. Then the first one is tested alike: what a break leaves behind is unique.
    """
    bit = lambda first, last: np.where(last >= first, (np.int64(1) << np.maximum(last - first + 1, 0)) - 1 << first, 0)
    marks, lane = np.zeros(len(begins), np.int64), np.arange(len(begins))
    low, high = np.zeros(len(lane), np.int64), many - 1
    last = np.ones(len(lane), bool)  # whether the last window is under test
    place, start, end = high + window - 1, np.zeros(len(lane), np.int64), np.full(len(lane), index.size)
    while len(lane):
        start, end = index.prolong(symbols[begins[lane] + place], start, end)
        goes = end - start >= 2
        whole = goes & (place == low)
        broken, again = ~goes, whole | ~goes
        # A match that reached the first undecided window.
        marks[lane] |= np.where(whole, bit(low, np.where(last, high, low)), 0)
        # A match from the last window that broke: windows behind the break are inside the match.
        marks[lane] |= np.where(broken & last, bit(place + 1, high), 0)
        low, high = (
            np.where(whole, np.where(last, high + 1, low + 1), np.where(broken & ~last, place + 1, low)),
            np.where(broken & last, np.minimum(place, high - 1), high),
        )
        last = np.where(again, whole | ~last, last)
        place = np.where(again, np.where(last, high, low) + window - 1, place - 1)
        start, end = np.where(again, 0, start), np.where(again, index.size, end)
        open_ = low <= high
        lane, low, high, last, place, start, end = (x[open_] for x in (lane, low, high, last, place, start, end))
    return marks


def _search(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Shard after shard of sorted rows: equal segments become one, then all are streamed through their index."""
    shard, held, last = None, [], None

    def done() -> pa.RecordBatch:
        h1, h2, copies, bodies = (list(x) for x in zip(*held))
        marks = search_shard(pa.array(bodies, pa.large_binary()), np.array(copies) > 1, window)
        some = marks != 0
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)[some]) for x in (h1, h2, marks)], _names(FOUND))

    for batch in batches:
        for number, h1, h2, body in zip(*(batch[c].to_pylist() for c in ("shard", "h1", "h2", "body"))):
            if number != shard:
                if held:
                    yield done()
                shard, held, last = number, [], None
            if (h1, h2) == last:
                held[-1][2] += 1
            else:
                held.append([h1, h2, 1, body])
                last = h1, h2
    if held:
        yield done()


def search_shard(bodies: pa.Array, twice: np.ndarray, window: int) -> np.ndarray:
    """Bits of the repeated windows of every segment; segments that occur more than once are in the index twice."""
    data, offsets = next((d, o) for _, _, d, o in slices(bodies, 1 << 62))
    found = words(data, offsets, EXACT)
    _, ids = np.unique(found.hashes, return_inverse=True)
    counts = np.diff(found.first)
    begins = found.first[:-1] + np.arange(len(counts))
    once = np.zeros(len(ids) + len(counts), np.int64)
    once[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids + 1
    again = np.repeat(twice, counts + 1)
    return repeated_windows(FMIndex(np.concatenate([once, once[again]])), once, begins, counts - window + 1, window)


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]  # seeds are chained: the 1 stands first


def repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, anchor_segments: int = ANCHOR_SEGMENTS,
) -> DataFrame:
    """(t1, t2, at, marks) per segment with repeated windows: of the text with this key, the window at word at + k is
    repeated where bit k of marks is set. Texts that occur several times are listed once.
    """
    if not 0 < gram <= window < gram + 62:
        raise ValueError("A window has at most 62 grams")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(lambda b: _grams(b, window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    several = cut_lineage(counted.where("n > 1"))
    repeated, hot = Bloom.of(several, "anchor"), Bloom.of(several.where(F.col("n") > anchor_segments), "anchor")
    total, cut = several.agg(F.sum("n"), F.max("n") > anchor_segments).first()
    # A segment has half as many windows as a window has grams, on average.
    shards = max(1, round((total or 0) * (window + (window - gram) // 2) / shard_words))
    dealt = texts.mapInArrow(lambda b: _deal(b, window, gram, repeated, hot), DEALT)
    placed = dealt.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "h1", "h2", "body")
    sorted_ = placed.repartition("shard").sortWithinPartitions("shard", "h1", "h2", F.asc_nulls_last("body"))
    found = sorted_.mapInArrow(lambda b: _search(b, window), FOUND)
    if cut:
        found = cut_lineage(found)
        parts = texts.mapInArrow(lambda b: _parts(b, window, gram, repeated, hot), PARTS).distinct()
        back = parts.join(found, ["h1", "h2"]).groupBy("p1", "p2").agg(F.expr("bit_or(shiftleft(1L, at))").alias("marks"))
        found = found.unionByName(back.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), "marks"))
    keyed = texts.select("text", *text_keys(F.col("text")))
    places = keyed.mapInArrow(lambda b: _places(b, window, gram, repeated), PLACES).distinct()
    return places.join(found, ["h1", "h2"]).select("t1", "t2", "at", "marks")


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = batch["told"].to_pylist()
        for row, end_row, data, offsets in slices(batch["text"]):
            found = words(data, offsets, EXACT)
            edge, first = np.zeros(len(found.hashes) + 1, np.int64), found.first
            for i, places in enumerate(told[row:end_row]):
                if places:
                    at, marks = (np.array([p[c] for p in places], np.int64) for c in ("at", "marks"))
                    which, bit = np.nonzero((marks[:, None] >> np.arange(62)) & 1)
                    begin = first[i] + at[which] + bit
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            counts, kept = np.diff(first), np.append(0, np.cumsum(~gone))
            left = Words(found.low, found.starts[~gone], found.ends[~gone], found.hashes[~gone], kept[first])
            text, until = _spaced(left)
            bounds = until[left.first].tolist()
            texts = [text[i : max(i, j - 1)].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
            arrays = [
                batch["doc_id"].slice(row, end_row - row), pa.array(counts), pa.array(counts - np.diff(left.first)), pa.array(texts, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_text"])


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sizes: int) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_text.

    A word inside any window of `window` words that also starts anywhere else, in this or another row, is removed;
    the words that are kept are joined by one space. Null and empty texts have no words, texts with fewer words
    than a window lose none. Rows that repeat a text, with or without an id, are elsewhere to each other. Words and segments
    are told apart by 64 and 128 bits. Other columns are not read. An empty table gives no rows.
    """
    told = repeats(docs, window, gram, **sizes).groupBy("t1", "t2").agg(F.collect_list(F.struct("at", "marks")).alias("told"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", *text_keys(F.col("text")))
    joined = keyed.join(told, ["t1", "t2"], "left").select("doc_id", "text", "told")
    return joined.mapInArrow(lambda b: _cut(b, window), "doc_id long, n_words long, n_removed long, kept_text string")
