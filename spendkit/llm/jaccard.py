"""Near duplicates: a blocked sparse matrix product of documents by n-grams, exact at the threshold.

Rows of the incidence matrix are classes of documents with the same shingle set, so copies are one row. Columns are
dealt to blocks by their hash and each block is multiplied by one task. Bounds that follow from the set sizes keep
the product small without losing a pair:

* sizes of linked sets differ by a fifth at most;
* with the columns of every row in one common order, rare ones first, linked sets share a column among the first
  n - ceil(0.8 n) + 1, so only those enter the product;
* the places of a shared column in both rows bound the whole overlap.

The order needs frequencies: hashed counters of fixed number, summed over all documents. The sets of a class are
written once and read from there.

The product of these columns says which cells there are. Their values, the overlaps, are accumulated over blocks of
columns: each block adds the columns that two rows share in it, and a pair goes as soon as its sum and what the sizes of
the remaining blocks leave cannot reach the overlap that it needs. The sizes are profiles: columns fall into PROFILE
parts, and the sum of the smaller count over the parts is the most that two rows can share.

A hot column, which many rows share, is first multiplied with a few pivots only, in rounds as long as these join
much; the rows of a very hot one are not sorted in one task but joined with its pivots. What is still in separate
components is multiplied in square blocks of profiles, which put out the pairs that may be linked. So the rows of a
large group are not paired one by one, and no link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.common import best_rows
from .components import components
from .storage import Bloom, cut_lineage, keep_rows, shared_path
from .text import BLANK, grams, mix, slices, words

SHINGLE = 5
COUNTERS = 1 << 20
CHUNK = 1 << 12
PROFILE = 256
#: Blocks of columns over which overlaps are accumulated, as edges among the parts of the profile.
COLUMN_BLOCKS = (0, 64, PROFILE)
#: Columns with more rows than this are multiplied with pivots first.
HOT = 32
#: Rows of a hot column that are multiplied with all others in one round of stars, and the most such rounds.
STARS = 4
ROUNDS = 3
#: Rows of a column that one task sorts; those of a longer one are dealt out and joined with its pivots.
SORTED = 1 << 14
#: Rows of a side of the square blocks for what stars leave, and hot columns by which rows tell who puts a pair out.
BLOCK = 256
NAMED = 8
#: Rows that go to Python at once.
BATCH_ROWS = 1024
#: Documents per part of the tables of pairs, links and classes, which hold a few numbers for some of the documents.
DOCS_PER_PART = 8_192


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """Columns that a linked set shares at least one of: n - ceil(4/5 n) + 1."""
    return n - -(-4 * n // 5) + 1


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """100 * i >= 80 * (n + m - i): i >= 4/9 (n + m)."""
    return -(-4 * (n + m) // 9)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; fewer words than a shingle are one shingle together."""
    for _, _, data, offsets in slices(column):
        found = words(data, offsets, BLANK)
        each, first = grams(found.hashes, SHINGLE), found.first
        for t in range(len(first) - 1):
            begin, n = first[t], first[t + 1] - first[t]
            if n >= SHINGLE:
                yield np.unique(each[begin : begin + n - SHINGLE + 1])
            elif n:
                yield grams(found.hashes[begin : begin + n], int(n))[:1]
            else:
                yield each[:0]


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of the set, for n distinct sets the same for two of them with a chance of n * n / 2 ** 65; 0 if empty."""
    n = len(shingles)
    if not n:
        return 0
    return int(mix(mix(shingles, 0x5BD1E995).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).view(np.int64)[0]) or 1


def part_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(24)).astype(np.int64) & (PROFILE - 1)


def profile(shingles: np.ndarray) -> bytes:
    """Shingles per part of the columns; empty where a count does not fit a byte, which bounds nothing."""
    counts = np.bincount(part_of(shingles), minlength=PROFILE)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


DESCRIBED = "id long, text_hash long, key long, n long, task int, profile binary, shingles binary, chunk int, counts binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, of each class one with its set, and at the end of the task its counters in chunks."""
    counts, seen, task = np.zeros(COUNTERS, np.int64), set(), TaskContext.get().partitionId()
    names = [f.split()[0] for f in DESCRIBED.split(", ")]
    types = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def out(ids, hashes, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 5
        none = [None] * len(rows)
        return pa.RecordBatch.from_arrays([ids, hashes, *(pa.array(v, t) for v, t in zip([*columns, none, none], types[2:]))], names)

    for batch in batches:
        rows, held, begin, size = [], [], 0, 0
        for shingles in shingle_sets(batch["text"]):
            key = set_key(shingles)
            first = key != 0 and key not in seen
            seen.add(key)
            rows.append((key, len(shingles), task, profile(shingles) if first else None, shingles.tobytes() if first else None))
            held.append(shingles & np.uint64(COUNTERS - 1))
            size += len(shingles)
            if size >= 1 << 18:
                counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
                yield out(batch["id"].slice(begin, len(rows)), batch["text_hash"].slice(begin, len(rows)), rows)
                begin, rows, held, size = begin + len(rows), [], [], 0
        if rows:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
            yield out(batch["id"].slice(begin, len(rows)), batch["text_hash"].slice(begin, len(rows)), rows)
    chunks = [c for c in range(COUNTERS // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
    none = [None] * len(chunks)
    parts = [_packed(counts[c * CHUNK : (c + 1) * CHUNK]) for c in chunks]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((*[none] * 7, chunks, parts), types)], names)


def _packed(counts: np.ndarray) -> bytes:
    """Counters are small numbers in wide fields, which deflate well."""
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counters that this task is dealt; it holds one array per chunk, not the rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, part in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist()):
            sums.setdefault(chunk, np.zeros(CHUNK, np.int64))
            sums[chunk] += np.frombuffer(zlib.decompress(part), np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([_packed(v) for v in sums.values()], pa.binary())], ["chunk", "counts"]
    )


def frequency_levels(described: DataFrame) -> np.ndarray:
    """Steps of the logarithm of every counter, over all documents. What reaches the driver is COUNTERS numbers."""
    parts = described.where("chunk is not null").select("chunk", "counts")
    spread = parts.withColumn("deal", F.spark_partition_id() % 8)
    sums = spread.repartition("chunk", "deal").select("chunk", "counts").mapInArrow(_add, "chunk int, counts binary")
    total = np.zeros(COUNTERS, np.int64)
    for row in sums.repartition("chunk").mapInArrow(_add, "chunk int, counts binary").collect():
        total[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return _level(total)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of some rows each, so that few sets are in memory as numbers at once."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


PREFIXES = "gram long, key long, n int, at int"


def _level(counts: np.ndarray | int) -> np.ndarray:
    return np.minimum(8 * np.log2(np.add(counts, 1)), 255).astype(np.uint8)


def _prefixes(batches: Iterator[pa.RecordBatch], levels: np.ndarray, least: int, frequent: bool) -> Iterator[pa.RecordBatch]:
    """The first columns of every row in the common order, those from the level `least` on or those below.

    A class comes once from every task that met it.
    """
    for batch in _few(batches):
        out: list[list[np.ndarray]] = [[], [], [], []]
        for key, raw in zip(batch["key"].to_pylist(), batch["shingles"].to_pylist()):
            shingles = np.frombuffer(raw, np.uint64)
            n = len(shingles)
            rank = (levels[shingles & np.uint64(COUNTERS - 1)].astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8))
            first = shingles[np.argsort(rank)[: prefix_length(n)]]
            at = np.flatnonzero((levels[first & np.uint64(COUNTERS - 1)] >= least) == frequent).astype(np.int32)
            for column, values in zip(out, (first[at].view(np.int64), np.full(len(at), key, np.int64), np.full(len(at), n, np.int32), at)):
                column.append(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["gram", "key", "n", "at"])


def _bounded(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that share a column at places i and j can be linked."""
    small, large, at = np.minimum(n, m), np.maximum(n, m), np.where(n <= m, i, j)
    overlap = np.minimum(i, j) + np.minimum(n - i, m - j)
    # The smaller set shares 8/9 of itself, so its first shared column stands even earlier.
    early = at <= small - -(-8 * small // 9)
    return (5 * small >= 4 * large) & early & (overlap >= least_overlap(n, m))


def bounded(n: Column, i: Column, m: Column, j: Column) -> Column:
    """`_bounded` as a column."""
    small, large, at = F.least(n, m), F.greatest(n, m), F.when(n <= m, i).otherwise(j)
    overlap = F.least(i, j) + F.least(n - i, m - j)
    early = at <= small - F.ceil(small * F.lit(8) / 9)
    return (5 * small >= 4 * large) & early & (overlap >= F.ceil(4 * (n + m) / F.lit(9)))


def _pairs(columns: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    _, key, n, at = columns[:4]
    fits = _bounded(n[left], at[left], n[right], at[right])
    if len(columns) > 4:  # only what no link joins yet
        fits &= columns[4][left] != columns[4][right]
    a, b = key[left[fits]], key[right[fits]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that share a column, from rows sorted by column.

    A column of up to HOT rows is multiplied whole. A longer one is a star: its first STARS rows with each of the others;
    its rows are passed on as well (b is null). Rows that have a `root` are those of hot columns in a later round: only
    pairs of different roots count. What is held over between batches is one column of HOT rows or the pivots.
    """
    names = ["gram", "key", "n", "at", "root"]
    held: list[np.ndarray] | None = None
    pivots: list[np.ndarray] | None = None
    last = (None, None)

    def work(columns: list[np.ndarray], more: bool) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
        nonlocal pivots
        gram = columns[0]
        n = len(gram)
        edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
        length = np.diff(edge)
        rest, pairs, hot = None, [], []
        if more and length[-1] <= HOT:  # the last column may go on
            rest = [c[edge[-2] :] for c in columns]
            columns = [c[: edge[-2]] for c in columns]
            edge, length, n = edge[:-1], length[:-1], int(edge[-2])
            gram = columns[0]
            if not n:
                return [], rest
        run = np.repeat(np.arange(len(length)), length)
        begin, size = edge[:-1][run], length[run]
        rows = np.arange(n)
        goes_on = (gram == pivots[0][0]) if pivots is not None else np.zeros(n, bool)
        small = (size > 1) & (size <= HOT) & ~goes_on
        for d in range(1, HOT):
            left = rows[small & (rows - begin + d < size)]
            if not len(left):
                break
            pairs.append(_pairs(columns, left, left + d))
        large = rows[(size > HOT) | goes_on]
        if len(large):
            if goes_on.any():
                joined = [np.concatenate([p, c[goes_on]]) for p, c in zip(pivots, columns)]
                for k in range(len(pivots[0])):
                    others = np.arange(len(pivots[0]), len(joined[0]))
                    pairs.append(_pairs(joined, np.full(len(others), k), others))
            for s, e in zip(edge[:-1][length > HOT], edge[1:][length > HOT]):
                if goes_on[s]:
                    continue
                for k in range(STARS):
                    others = np.arange(s + k + 1, e)
                    pairs.append(_pairs(columns, np.full(len(others), s + k), others))
            hot = [c[large] for c in columns] if len(columns) == 4 else []
        if more and (length[-1] > HOT or goes_on[-1]):
            if not goes_on[-1]:
                pivots = [c[edge[-2] : edge[-2] + STARS] for c in columns]
        else:
            pivots = None
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return [found, hot], rest

    def out(found: np.ndarray, hot: list[np.ndarray]) -> pa.RecordBatch:
        k, h = len(found), len(hot[0]) if hot else 0
        empty = lambda n, t: pa.nulls(n, t)
        parts = hot[:4] if h else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)] * 2
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(found[:, 0]), pa.array(parts[1])]),
            pa.concat_arrays([pa.array(found[:, 1]), empty(h, pa.int64())]),
            pa.concat_arrays([empty(k, pa.int64()), pa.array(parts[0])]),
            pa.concat_arrays([empty(k, pa.int32()), pa.array(parts[2])]),
            pa.concat_arrays([empty(k, pa.int32()), pa.array(parts[3])]),
        ], ["key", "b", "gram", "n", "at"])

    for batch in batches:
        columns = [batch[c].to_numpy() for c in names if c in batch.schema.names]
        gram, key = columns[:2]
        if not len(gram):
            continue
        # The row of a class comes once from every task that met the class; sorted, these stand together.
        fresh = np.concatenate([[(gram[0], key[0]) != last], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])])
        last = (gram[-1], key[-1])
        columns = [c[fresh] for c in columns]
        if not fresh.any():
            continue
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        result, held = work(columns, True)
        if result:
            yield out(*result)
    if held is not None:
        result, _ = work(held, False)
        yield out(*result)


def most_shared(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most that rows of profiles can share; a row without a profile (all 0) may share all it has."""
    most = np.minimum(left, right).sum(axis=-1, dtype=np.int64)
    known = (left.sum(axis=-1, dtype=np.int64) == n) & (right.sum(axis=-1, dtype=np.int64) == m)
    return np.where(known, most, np.minimum(n, m))


def _profiles(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x if len(x) == PROFILE else bytes(PROFILE) for x in column), np.uint8).reshape(-1, PROFILE)


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different roots, one row of each of two blocks, whose profiles leave room for the overlap they need.

    Rows that share several hot columns meet in each. The least of those that both name puts the pair out; a pair
    without such a column is put out wherever it meets.
    """
    last = np.iinfo(np.int64).max
    named = np.array([[*x, *[last] * (NAMED - len(x))] for x in rows["named"]], np.int64)
    profiles, n, root = _profiles(rows["profile"].tolist()), rows["n"].to_numpy(np.int64), rows["root"].to_numpy()
    first = np.flatnonzero(rows["block"].to_numpy() == key[1])
    other = np.flatnonzero(rows["block"].to_numpy() == key[2])
    pairs = []
    for k in first:
        rest = other[(root[other] != root[k]) & ((key[1] != key[2]) | (other > k))]
        rest = rest[(5 * n[rest] >= 4 * n[k]) & (5 * n[k] >= 4 * n[rest])]
        near = rest[most_shared(profiles[rest], profiles[k], n[rest], n[k]) >= least_overlap(n[rest], n[k])]
        both = (named[near][:, :, None] == named[k][None, None, :]).any(axis=2) & (named[near] != last)
        least = np.where(both, named[near], last).min(axis=1, initial=last)
        near = near[(least == key[0]) | (least == last)]
        pairs.append(np.stack([np.full(len(near), k), near], axis=1))
    pairs = rows["key"].to_numpy()[np.concatenate(pairs)] if pairs else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}, dtype="int64")


MULTIPLIED = "key long, b long, gram long, n int, at int"


def _sets(batches: Iterator[pa.RecordBatch], wanted: Bloom, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The columns in parts low to high of the classes that stand in a pair, from the row that speaks for the class."""
    for batch in _few(batches):
        kept = batch.filter(pa.array(wanted.has(speaker(batch["key"].to_numpy(), batch["task"].to_numpy()))))
        if not len(kept):
            continue
        values = []
        for raw in kept["shingles"].to_pylist():
            shingles = np.frombuffer(raw, np.uint64)
            part = part_of(shingles)
            values.append(shingles[(part >= low) & (part < high)].tobytes())
        yield pa.RecordBatch.from_arrays([kept["key"], pa.array(values, pa.binary())], ["key", "shingles"])


def speaker(key: np.ndarray, task: np.ndarray) -> np.ndarray:
    return mix(key.astype(np.int64).view(np.uint64) + mix(task.astype(np.int64).view(np.uint64), 77))


def _speakers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = speaker(batch["key"].to_numpy(), batch["task"].to_numpy()).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes)], ["code"])


ACCUMULATED = "a long, b long, need int, sum int, rest array<int>"


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose profiles leave room for the overlap they need, with the most that each block of columns leaves."""
    for batch in batches:
        n, m = batch["left_n"].to_numpy(), batch["right_n"].to_numpy()
        left, right = _profiles(batch["left"].to_pylist()), _profiles(batch["right"].to_pylist())
        need = least_overlap(n, m)
        keep = np.flatnonzero(most_shared(left, right, n, m) >= need)
        n, m, left, right, need = n[keep], m[keep], left[keep], right[keep], need[keep]
        known = (left.sum(axis=1, dtype=np.int64) == n) & (right.sum(axis=1, dtype=np.int64) == m)
        least = np.minimum(left, right)
        blocks = [np.where(known, least[:, i:j].sum(axis=1, dtype=np.int64), np.minimum(n, m)) for i, j in zip(COLUMN_BLOCKS, COLUMN_BLOCKS[1:])]
        rest = pa.array(list(np.stack(blocks, axis=1).astype(np.int32)), pa.list_(pa.int32()))
        pairs = [batch[c].take(pa.array(keep)) for c in ("a", "b")]
        yield pa.RecordBatch.from_arrays(
            [*pairs, pa.array(need.astype(np.int32)), pa.array(np.zeros(len(keep), np.int32)), rest], ["a", "b", "need", "sum", "rest"],
        )


def _accumulate(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The columns of one block that the rows of a pair share are added to its sum; what cannot reach its need goes."""
    for batch in _few(batches):
        both = np.zeros(len(batch), np.int32)
        for k, (left, right) in enumerate(zip(batch["left"].to_pylist(), batch["right"].to_pylist())):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            if len(x):
                spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both[k] = (y[spot] == x).sum()
        sums = batch["sum"].to_numpy() + both
        later = np.array([sum(r[block + 1 :]) for r in batch["rest"].to_pylist()], np.int64)
        keep = pa.array(sums + later >= batch["need"].to_numpy())
        out = [batch["a"], batch["b"], batch["need"], pa.array(sums), batch["rest"]]
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], ["a", "b", "need", "sum", "rest"])


class Product:
    """The product over one table of documents; `links` are verified pairs of class keys."""

    def __init__(self, docs: DataFrame):
        self.spark, text = docs.sparkSession, F.col("text").cast("string")
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
        stored = shared_path(self.spark, "sets")
        texts.mapInArrow(_describe, DESCRIBED).write.parquet(stored)
        described = self.spark.read.schema(DESCRIBED).parquet(stored)
        rows = described.where("chunk is null")
        self.rows = rows.select("id", "text_hash", "key", "n")
        self.stored = rows.where("shingles is not null").select("key", "task", "shingles")
        # The row that speaks for a class is that of its first task with the set.
        spoken = F.min(F.when(F.col("profile").isNotNull(), F.col("task"))).alias("task")
        self.classes = cut_lineage(
            rows.where("key <> 0").groupBy("key").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.max("profile").alias("profile"), spoken)
        )
        self.levels = frequency_levels(described)
        self.parts = 1 + self.rows.count() // DOCS_PER_PART

    def small(self, table: DataFrame) -> DataFrame:
        """Stored in as many parts as the number of documents asks for."""
        return cut_lineage(table.coalesce(self.parts))

    def sets(self, keys: DataFrame, low: int, high: int) -> DataFrame:
        """(key, shingles) of the distinct `keys` in the parts low to high, and some more that the filter lets through."""
        speak = self.classes.join(keys, "key", "left_semi").select("key", "task").coalesce(self.parts)
        wanted = Bloom.of(speak.mapInArrow(_speakers, "code long"), "code")
        return self.stored.mapInArrow(lambda batches: _sets(batches, wanted, low, high), "key long, shingles binary")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are links: their overlap is accumulated block by block."""
        for side, name in (("a", "left"), ("b", "right")):
            pairs = pairs.join(self.classes.selectExpr(f"key AS {side}", f"n AS {name}_n", f"profile AS {name}"), side).coalesce(self.parts)
        pairs = self.small(pairs.select("a", "b", "left_n", "left", "right_n", "right").mapInArrow(_possible, ACCUMULATED))
        for block, (low, high) in enumerate(zip(COLUMN_BLOCKS, COLUMN_BLOCKS[1:])):
            asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
            sets = cut_lineage(self.sets(asked, low, high))
            left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("left"))
            right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("right"))
            both = pairs.join(left, "a").coalesce(self.parts).join(right, "b").coalesce(self.parts)
            pairs = self.small(both.mapInArrow(lambda batches, block=block: _accumulate(batches, block), ACCUMULATED))
        return pairs.select("a", "b").distinct()

    def multiply(self, rows: DataFrame, seed: int, cold: DataFrame | None = None) -> DataFrame:
        """Pairs of rows that share a column, and the rows of hot columns again (b is null).

        `cold` are rows of columns that are surely not very hot, which are not counted.
        """
        order = F.xxhash64("key", F.lit(seed))
        counted = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
        very_hot = self.small(counted.where(F.col("c") > SORTED).select("gram"))
        rest = rows.join(very_hot, "gram", "left_anti")
        rest = rest if cold is None else rest.unionByName(cold)
        sorted_ = rest.repartition("gram").sortWithinPartitions("gram", order).mapInArrow(_multiply, MULTIPLIED)
        # Pivots are chosen in every task before they are shuffled; Spark splits the join where a column is hot.
        hot = rows.join(very_hot, "gram", "left_semi")
        pivots = self.small(best_rows(hot.distinct(), ["gram"], [order, F.col("key")], STARS))
        with_root = "root" in rows.columns
        pivots = pivots.select("gram", *[F.col(c).alias(f"p_{c}") for c in pivots.columns if c != "gram"])
        met = hot.join(pivots, "gram").where("key <> p_key").where(bounded(F.col("n"), F.col("at"), F.col("p_n"), F.col("p_at")))
        if with_root:
            met = met.where("root <> p_root")
        null = lambda kind, name: F.lit(None).cast(kind).alias(name)
        found = met.select(
            F.least("key", "p_key").alias("key"), F.greatest("key", "p_key").alias("b"), null("long", "gram"), null("int", "n"), null("int", "at"),
        )
        again = hot.select("key", null("long", "b"), "gram", "n", "at").distinct()
        return sorted_.unionByName(found) if with_root else sorted_.unionByName(found).unionByName(again)

    def blocks(self, rooted: DataFrame) -> DataFrame:
        """Pairs of different roots within the columns of `rooted` that may be linked, from square blocks of profiles.

        Roots with many rows in a column have blocks of their own, others share some, all dealt by hash.
        """
        sizes = rooted.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c"))
        large = sizes.where(F.col("c") > BLOCK).select("gram", "root", F.ceil(F.col("c") / BLOCK).alias("own"))
        pooled = sizes.where(F.col("c") <= BLOCK).groupBy("gram").agg(F.ceil(F.sum("c") / BLOCK).alias("pool"))
        rows = rooted.select("gram", "key", "root").join(large, ["gram", "root"], "left").join(pooled, "gram", "left")
        block = F.when(F.col("own").isNotNull(), F.xxhash64("root", F.pmod(F.xxhash64("key"), "own"))).otherwise(F.pmod(F.xxhash64("root", F.lit(1)), "pool"))
        rows = self.small(rows.select("gram", "key", "root", block.alias("block")))
        ends = rows.groupBy("gram", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        other = ends.select("gram", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
        # Two blocks of one and the same root have nothing to find.
        pairs = ends.withColumnRenamed("block", "i").join(other, "gram").where("i <= j and not (low = high and low_j = high_j and low = low_j)")
        pairs = pairs.select("gram", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        named = rows.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("gram")), 1, NAMED).alias("named"))
        of = self.classes.select("key", "n", "profile").join(named, "key")
        dealt = rows.join(pairs, ["gram", "block"]).coalesce(self.parts).join(of.coalesce(self.parts), "key").coalesce(self.parts)
        return dealt.groupBy("gram", "i", "j").applyInPandas(_block, "a long, b long").distinct()

    def roots(self) -> DataFrame:
        """(node, root) of the classes that links join."""
        # The counters tell which columns may be very hot: a count is at least that of each column in it.
        levels, least = self.levels, int(_level(SORTED))

        def prefixes(frequent: bool) -> DataFrame:
            return self.stored.select("key", "shingles").mapInArrow(lambda batches: _prefixes(batches, levels, least, frequent), PREFIXES)

        first = cut_lineage(self.multiply(cut_lineage(prefixes(True)), 0, prefixes(False)))
        hot = first.where("b is null").select("gram", "key", "n", "at")
        asked = self.small(_asked(first).distinct())
        links, before = self.verified(asked), None
        for seed in range(1, ROUNDS + 2):
            roots = components(links, self.parts)
            # What is left of the hot columns: those whose rows have several roots.
            rooted = hot.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
            rooted = self.small(rooted)
            shares = rooted.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("gram").agg(
                F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("within"),
            ).where("rows * rows > within")
            rows, left = shares.agg(F.sum("rows"), F.sum(F.expr("rows * rows - within"))).first()
            if not left:
                return roots
            rooted = self.small(rooted.join(shares.select("gram"), "gram", "left_semi"))
            if seed > ROUNDS or left <= BLOCK * rows or before and 2 * left > before:
                break
            fresh = self.small(_asked(self.multiply(rooted, seed)).distinct().join(asked, ["a", "b"], "left_anti"))
            links = links.unionByName(self.verified(fresh))
            asked, before = asked.unionByName(fresh), left
        fresh = self.small(self.blocks(rooted).join(asked, ["a", "b"], "left_anti"))
        return components(links.unionByName(self.verified(fresh)), self.parts)


def _asked(multiplied: DataFrame) -> DataFrame:
    return multiplied.where("b is not null").select(F.col("key").alias("a"), "b")


@contextmanager
def _narrow_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that hold whole sets go to Python a few at a time; what runs inside is complete when this ends."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def grouped(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: id, text_hash, key, n, root (the class that speaks for its component) and component_id."""
    with _narrow_batches(docs.sparkSession):
        product = Product(docs)
        roots = product.roots()
    rooted = product.classes.select("key", "id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    told = rooted.join(least, "root").select("key", "root", "component_id")
    linked = product.rows.where("key <> 0").join(told, "key")
    alone = product.rows.where("key = 0").select("*", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs without blanks. Documents link when 100 * intersection >= 80 * union of their
    distinct 5-word shingles; fewer words are one shingle. A document without words links with nothing and is its
    own component. component_id is the smallest doc_id that links reach; rows without an id take part, and a
    component of such rows alone has a null id. Rows that repeat an id are documents each. Other columns are not
    read. An empty table gives no rows.
    """
    return grouped(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component, that with the smallest id, and all their columns.

    Of rows that share the smallest id one stays. Rows without words stay all.
    """
    rows = cut_lineage(grouped(docs))
    own = F.col("id").eqNullSafe(F.col("component_id"))
    named = rows.where(own & F.col("root").isNotNull()).groupBy("root", "id").agg(F.min("text_hash").alias("text_hash"))
    several = rows.groupBy("root", "id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    same = several["root"].eqNullSafe(named["root"]) & several["id"].eqNullSafe(named["id"]) & (several["text_hash"] == named["text_hash"])
    first = several.join(named, same, "left_semi").select("id", "text_hash", "copies")
    alone = several.where("root is null").select("id", "text_hash", F.lit(1).cast("long").alias("copies"))
    keepers = first.unionByName(alone).toDF("_id", "_text", "_copies")
    return keep_rows(docs, cut_lineage(keepers), F.xxhash64(F.col("text").cast("string")))
