"""Ranked lexical search: best-first document intervals over posting lists with range-maximum tables.

Index. A shard holds some thousand documents and, per term that any query may hold, its posting list, in the order
of the documents. Shards are built where the documents are read; nothing is shuffled but the number of documents per
shard and term, from which the weights follow.

Search. With the weights known, every posting has an impact, and a sparse table over the lists answers for any
range of a list which posting has the most, in two reads. An interval of documents is bounded by the sum of these
answers over the terms of the query. The intervals with the highest bounds are split first, each at the document
that holds its greatest single impact: that document is scored, the two remainders get bounds of their own. An interval with
few postings is scored whole, one whose bound is below the k-th best score so far is left out. Several intervals are split
at a time, and a task goes on with the k-th best score that its earlier shards gave.

Queries go to the shards in blocks of a bounded number of terms. A task gives at most k documents per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import NO_ID, Bloom, shared_path
from .text import ALNUM, Words, slices, words

TOP = 20
#: Documents and postings that close a shard.
SHARD_DOCS = 1 << 14
SHARD_POSTINGS = 1 << 19
#: Query terms of one block of queries, intervals that are split at a time, postings of an interval that is scored whole.
BLOCK_TERMS = 1 << 17
SPLITS = 16
LEAF = 1 << 14

SHARDS = (
    "shard long, n_docs long, n_terms long, terms array<string>, df array<int>, doc_ids array<long>, "
    "lengths binary, docs binary, tfs binary"
)
QUERY = "item long, item_id long, term string, qtf long, hash long"
HITS = "item long, item_id long, doc_id long, score long"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of every item, with their repeats."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        items, ids = batch["item"].to_pylist(), batch["item_id"].to_pylist()
        for row, end, data, offsets in slices(batch["text"]):
            found, out = words(data, offsets, ALNUM), []
            for t in range(end - row):
                first, last = found.first[t], found.first[t + 1]
                hashes, at, counts = np.unique(found.hashes[first:last], return_index=True, return_counts=True)
                for code, place, n in zip(hashes.view(np.int64).tolist(), at.tolist(), counts.tolist()):
                    term = found.texts(first + place, first + place + 1)[0].decode()
                    out.append((items[row + t], ids[row + t], term, n, code))
            columns = zip(*out) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _names(QUERY))


class _Shard:
    """Documents that are read, until they make a shard."""

    def __init__(self):
        self.ids, self.lengths, self.hashes, self.docs, self.names, self.postings = [], [], [], [], {}, 0

    def add(self, ids: list, found: Words, wanted: np.ndarray) -> None:
        at = np.flatnonzero(wanted)
        doc = np.searchsorted(found.first, at, "right") - 1
        hashes, place = np.unique(found.hashes[at], return_index=True)
        for code, w in zip(hashes.tolist(), at[place].tolist()):
            if code not in self.names:
                self.names[code] = found.texts(w, w + 1)[0].decode()
        self.hashes.append(found.hashes[at])
        self.docs.append(doc + len(self.ids))
        self.ids += ids
        self.lengths.append(found.counts())
        self.postings += len(at)

    def row(self, number: int) -> pa.RecordBatch:
        lengths, hashes, docs = np.concatenate(self.lengths), np.concatenate(self.hashes), np.concatenate(self.docs)
        codes, term = np.unique(hashes, return_inverse=True)
        posting, tfs = np.unique(term * len(lengths) + docs, return_counts=True)
        df = np.bincount(posting // max(len(lengths), 1), minlength=len(codes))
        values = [
            number, int((lengths > 0).sum()), int(lengths.sum()), [self.names[c] for c in codes.tolist()], df.astype(np.int32), self.ids,
            lengths.astype(np.int64).tobytes(), (posting % max(len(lengths), 1)).astype(np.int32).tobytes(), tfs.astype(np.int32).tobytes(),
        ]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], _names(SHARDS))


def _shards(batches: Iterator[pa.RecordBatch], asked: Bloom, most_docs: int, most_postings: int) -> Iterator[pa.RecordBatch]:
    held, number = _Shard(), TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        for row, end, data, offsets in slices(batch["text"]):
            found = words(data, offsets, ALNUM)
            held.add(ids[row:end], found, asked.has(found.hashes))
            if len(held.ids) >= most_docs or held.postings >= most_postings:
                yield held.row(number)
                held, number = _Shard(), number + 1
    if held.ids:
        yield held.row(number)


class Postings:
    """The posting lists of a shard, their impacts, and for any range of a list its greatest impact.

    List t is [bounds[t], bounds[t + 1]) of `docs` and `impacts`.
    """

    def __init__(self, df: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        self.docs, self.impacts, self.n_docs = docs, impacts, n_docs
        self.bounds = np.append(0, np.cumsum(df))
        self.keys = np.repeat(np.arange(len(df)), df) * n_docs + docs
        # Impact and place in one number, so that a maximum tells where it stands.
        self.table = [impacts << 32 | np.arange(len(docs))]
        width = 1
        while 2 * width <= df.max(initial=0):
            below = self.table[-1]
            self.table.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def best(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(greatest impact, its place) of every range; an empty one has impact 0."""
        size = end - begin
        level = np.frexp(np.maximum(size, 1))[1] - 1
        found = np.zeros(size.shape, np.int64)
        for k in np.unique(level[size > 0]):
            at = (level == k) & (size > 0)
            found[at] = np.maximum(self.table[k][begin[at]], self.table[k][end[at] - (1 << int(k))])
        return found >> 32, found & 0xFFFFFFFF

    def place(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where each document stands, or would, in each list."""
        return np.searchsorted(self.keys, lists[None, :] * self.n_docs + docs[:, None])


class Top:
    """The k best documents of one query."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach to be among the best; equal scores are decided by the id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


def search(index: Postings, lists: np.ndarray, weights: np.ndarray, ids: np.ndarray, top: Top, splits: int = SPLITS, leaf: int = LEAF) -> int:
    """Add to `top` what it lacks of the documents of a shard. Returns how many postings were scored one by one."""
    begin, end, read = index.bounds[lists][None, :], index.bounds[lists + 1][None, :], 0
    high, where = index.best(begin, end)
    bound = (high * weights).sum(1)
    while True:
        open_ = bound >= top.least
        begin, end, high, where, bound = (x[open_] for x in (begin, end, high, where, bound))
        if not len(bound):
            return read
        first = np.argsort(-bound, kind="stable")[:splits]
        rest = np.ones(len(bound), bool)
        rest[first] = False
        b, e, h, w = begin[first], end[first], high[first], where[first]
        whole = (e - b).sum(1) <= leaf
        if whole.any():
            sizes = (e - b)[whole].ravel()
            until = np.cumsum(sizes)
            places = np.repeat(b[whole].ravel() - (until - sizes), sizes) + np.arange(until[-1])
            gain = index.impacts[places] * np.repeat(np.tile(weights, int(whole.sum())), sizes)
            docs, of = np.unique(index.docs[places], return_inverse=True)
            # Sums stay far below 2**53, so they are exact.
            top.add(np.bincount(of, weights=gain).astype(np.int64), ids[docs])
            read += len(places)
        b, e, h, w = b[~whole], e[~whole], h[~whole], w[~whole]
        split = index.docs[w[np.arange(len(w)), (h * weights).argmax(1)]] if len(w) else np.zeros(0, np.int64)
        at = np.clip(index.place(lists, split), b, e)
        hit = (at < e) & (index.docs[np.minimum(at, len(index.docs) - 1)] == split[:, None])
        top.add((np.where(hit, index.impacts[np.minimum(at, len(index.docs) - 1)], 0) * weights).sum(1), ids[split])
        fresh_begin, fresh_end = np.concatenate([b, at + hit]), np.concatenate([at, e])
        fresh_high, fresh_where = index.best(fresh_begin, fresh_end)
        begin, end = np.concatenate([begin[rest], fresh_begin]), np.concatenate([end[rest], fresh_end])
        high, where = np.concatenate([high[rest], fresh_high]), np.concatenate([where[rest], fresh_where])
        bound = np.concatenate([bound[rest], (fresh_high * weights).sum(1)])


def _search(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple], n: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of all shards of a task, for every query of a block."""
    tops = {item: Top(k) for item in queries}
    asked = {term for _, terms, _ in queries.values() for term in terms}
    for batch in batches:
        for row in batch.to_pylist():
            df = np.array(row["df"], np.int64)
            lengths = np.frombuffer(row["lengths"], np.int64)
            docs, tfs = np.frombuffer(row["docs"], np.int32).astype(np.int64), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
            known = np.array([t in asked for t in row["terms"]], bool)
            kept = np.repeat(known, df)
            docs, tfs, df = docs[kept], tfs[kept], df[known]
            if not len(docs):
                continue
            list_of = {t: i for i, t in enumerate(t for t in row["terms"] if t in asked)}
            m = 100 - 25 + 25 * lengths * n // total
            index = Postings(df, docs, 1_000_000_000 * tfs // (1000 * tfs + 12 * m[docs]), len(lengths))
            ids = np.array([NO_ID if d is None else d for d in row["doc_ids"]], np.int64)
            for item, (_, terms, weights) in queries.items():
                here = [(list_of[t], w) for t, w in zip(terms, weights) if w > 0 and t in list_of]
                if here:
                    lists, w = np.array(here, np.int64).T
                    search(index, lists, w, ids, tops[item])
    for item, top in tops.items():
        if len(top.ids):
            arrays = [
                pa.array([item] * len(top.ids), pa.int64()), pa.array([queries[item][0]] * len(top.ids), pa.int64()),
                pa.array(top.ids, mask=top.ids == NO_ID), pa.array(top.scores),
            ]
            yield pa.RecordBatch.from_arrays(arrays, _names(HITS))


def weight(n: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def build_shards(docs: DataFrame, asked: Bloom, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The index of `docs` (SHARDS): postings of all terms that `asked` may hold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _shards(b, asked, shard_docs, shard_postings), SHARDS)


def _blocks(weighted: DataFrame, block_terms: int) -> Iterator[dict[int, tuple]]:
    """Queries (item: id, terms, weights) in blocks of about `block_terms` terms, one query at least."""
    blocks = max(1, -(-weighted.count() // block_terms))
    for block in range(blocks):
        rows: pd.DataFrame = weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toPandas()
        queries = {}
        for item, each in rows.groupby("item"):
            item_id = each["item_id"].iloc[0]
            queries[int(item)] = (None if pd.isna(item_id) else int(item_id), each["term"].tolist(), each["w"].tolist())
        if queries:
            yield queries


def search_all(
    docs: DataFrame, benchmark: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The `top` best documents of every row of `benchmark`: item_id, rank, doc_id, score.

    Terms are runs of letters a-z, digits and non-ASCII characters after A-Z are lower-cased; they are told apart by 64
    bits while postings are collected. A document without a term of an item, or with terms of no weight only, is not listed.
    Equal scores rank by doc_id, rows without one last. Rows that repeat are ranked each, items that repeat are asked
    each. Null and empty texts have no terms. Other columns are not read. Without documents, items or terms there are
    no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"),
    )
    stored_queries, stored = shared_path(spark, "queries"), shared_path(spark, "shards")
    items.mapInArrow(_query_terms, QUERY).write.parquet(stored_queries)
    queries = spark.read.parquet(stored_queries)
    asked = Bloom.of(queries.select("hash").distinct(), "hash")
    build_shards(docs, asked, shard_docs, shard_postings).write.option("compression", "zstd").parquet(stored)
    shards = spark.read.parquet(stored)
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    counted = (
        shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    )
    weighted = queries.join(counted, "term").select("item", "item_id", "term", (F.col("qtf") * weight(F.lit(n), F.col("df"))).alias("w"))
    weighted = weighted.where("w > 0")
    found = None
    for block in _blocks(weighted, block_terms):
        each = shards.mapInArrow(lambda b, block=block: _search(b, block, n, total, top), HITS)
        found = each if found is None else found.unionByName(each)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
