"""Benchmark decontamination by winnowing.

Training and test texts are reduced to fingerprints: of the hashes of k consecutive words, those that are the
least in a sliding window of w. Any span of k + w - 1 words that two texts share holds a fingerprint of both, so
joining the fingerprints finds every one. A hit is extended word by word to both sides; a run as long as the window
is contaminated. With k = 5 and w = 9 no shared span of 13 words is missed. Items of fewer words are one
window each; for every such length in the benchmark a fingerprint family of that span is added.

Most fingerprints of the corpus meet no test item. Tasks drop them with a Bloom filter of the test fingerprints,
whose size is fixed, before the join by shuffle; the filter loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import Bloom, cut_lineage
from .text import ALNUM, Words, grams, mix, slices, words

SPAN = 13
GRAM = 5
FIELDS = "id long, text_hash long, n_words long, print long, span int, at int, size int, before array<binary>, after array<binary>"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def gram_of(span: int) -> int:
    return min(GRAM, span)


def winnowed(hashes: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all texts of a slice for one span: positions (of the first word) and hashes.

    `first` gives the first word of each text. A text with fewer words than the span has none. In every window all
    positions that hold the least hash count, so equal spans give equal choices.
    """
    k = gram_of(span)
    w, n = span - k + 1, len(hashes)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    each = mix(grams(hashes, k), span << 8)
    least = each.copy()  # of the window that begins here, by doubling
    width = 1
    while width < w:
        step = min(width, w - width)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        width += step
    # Windows that would reach into the next text do not count.
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    whole = room >= span
    chosen = np.zeros(n, bool)
    for j in range(w):
        m = n - j
        chosen[j:] |= whole[:m] & (each[j:] == least[:m])
    at = np.flatnonzero(chosen)
    return at, each[at]


def _context(found: Words, at: int, text: int, span: int) -> tuple[list[bytes], list[bytes]]:
    """The words before the fingerprint, nearest last, and from its first word on, as far as a window with it reaches."""
    k = gram_of(span)
    begin, end = max(found.first[text], at - (span - k)), min(found.first[text + 1], at + span)
    return found.texts(begin, at), found.texts(at, end)


def _fingerprints(batches: Iterator[pa.RecordBatch], spans: list[int], wanted: Bloom | None, item: bool) -> Iterator[pa.RecordBatch]:
    """A row per text (print is null) and a row per fingerprint that may be wanted.

    `item`: the text is a benchmark item, which has windows of its own length if it is shorter than SPAN.
    """
    for batch in batches:
        ids, hashes = batch["id"].to_pylist(), batch["text_hash"].to_pylist()
        for row, end, data, offsets in slices(batch["text"]):
            found = words(data, offsets, ALNUM)
            counts, mine, told = found.counts(), ids[row:end], hashes[row:end]
            out = [list(mine), list(told), counts.tolist(), *[[None] * len(mine) for _ in range(6)]]
            for span in spans:
                at, prints = winnowed(found.hashes, found.first, span)
                if wanted is not None:
                    kept = wanted.has(prints)
                    at, prints = at[kept], prints[kept]
                text = np.searchsorted(found.first, at, "right") - 1
                if item:
                    own = np.minimum(counts[text], SPAN) == span
                    at, prints, text = at[own], prints[own], text[own]
                for place, code, t in zip(at.tolist(), prints.view(np.int64).tolist(), text.tolist()):
                    before, after = _context(found, place, t, span)
                    values = (mine[t], told[t], int(counts[t]), code, span, int(place - found.first[t]), gram_of(span), before, after)
                    for column, value in zip(out, values):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], NAMES)


def fingerprints(rows: DataFrame, spans: list[int], wanted: Bloom | None = None, item: bool = False) -> DataFrame:
    """`rows` has id, text and text_hash."""
    return rows.mapInArrow(lambda batches: _fingerprints(batches, spans, wanted, item), FIELDS)


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal words around the hits that are as long as the window."""
    for batch in batches:
        begins, ends = np.full(len(batch), -1), np.full(len(batch), -1)
        columns = [batch[c] for c in ("at", "size", "span", "before", "after", "item_before", "item_after")]
        for i, (at, size, span, before, after, item_before, item_after) in enumerate(zip(*columns)):
            left = 0
            for a, b in zip(before[::-1], item_before[::-1]):
                if a != b:
                    break
                left += 1
            right = 0
            for a, b in zip(after, item_after):
                if a != b:
                    break
                right += 1
            if right >= size and left + right >= span:
                begins[i], ends[i] = at - left, at + right
        batch["begin"], batch["end"] = begins, ends
        yield batch.loc[begins >= 0, ["id", "text_hash", "item_id", "begin", "end"]]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["text_hash"])


def _texts(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))


def text_hash() -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.col("text").cast("string"))


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per document with id, text_hash and n_words; runs id, text_hash, item_id, begin, end in words)."""
    items = _texts(benchmark, "item_id")
    # As many rows as there are lengths up to SPAN.
    short = fingerprints(items, []).select(F.least("n_words", F.lit(SPAN)).alias("n")).where("n > 0").distinct().collect()
    spans = sorted(int(r["n"]) for r in short) or [SPAN]
    tests = cut_lineage(fingerprints(items, spans, item=True).where("print is not null"))
    wanted = Bloom.of(tests.select("print").distinct(), "print")
    rows = cut_lineage(fingerprints(_texts(docs, "doc_id"), spans, wanted))
    prints = rows.where("print is not null")
    # Equal context gives equal runs: items that repeat are joined once each, not once per place.
    asked = tests.select(
        F.col("id").alias("item_id"), "print", "span", F.col("before").alias("item_before"), F.col("after").alias("item_after"),
    ).distinct()
    # Ids go through pandas as text, which keeps nulls and every digit.
    runs = prints.join(asked, ["print", "span"]).select(
        F.col("id").cast("string"), "text_hash", F.col("item_id").cast("string"), "at", "size", "span", "before", "after", "item_before", "item_after",
    ).mapInPandas(_extend, "id string, text_hash long, item_id string, begin long, end long")
    runs = runs.withColumns({"id": F.col("id").cast("long"), "item_id": F.col("item_id").cast("long")})
    return rows.where("print is null").select("id", "text_hash", "n_words"), cut_lineage(runs.distinct())


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated.

    Words are lower-cased runs of a-z, 0-9 and non-ASCII characters. A window is 13 consecutive words of an item,
    or a whole shorter item; a word inside any occurrence of a window is hit. Contaminated: a twentieth of the
    words is hit. Null or wordless texts have no words and no hits. Rows that repeat are judged each; items that
    repeat an id count once, items without an id are hit but not listed. Other columns are not read.
    """
    rows, runs = hits(docs, benchmark)
    key = Window.partitionBy("id", "text_hash").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.select("id", "text_hash", "begin", "end").distinct()
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(key), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy("id", "text_hash").agg(F.sum("fresh").alias("n_hit"))
    listed = runs.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    hit = covered.join(listed, _same(covered, listed)).select(covered["id"], covered["text_hash"], "n_hit", "item_ids")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(hit, _same(rows, hit), "left").select(
        rows["id"].alias("doc_id"), rows["text_hash"], "n_words", n_hit.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that `contamination` marks, with all their columns."""
    marked = contamination(docs, benchmark).where("contaminated")
    bad = cut_lineage(marked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_text"))
    same = rows["_id"].eqNullSafe(bad["_id"]) & (rows["_text"] == bad["_text"])
    return rows.join(bad, same, "left_anti").select("row.*")
