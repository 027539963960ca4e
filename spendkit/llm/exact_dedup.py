"""Exact dedup against an index of known texts: a minimal perfect hash over historical distinct digests.

The digests of a history are dealt to buckets by their leading bits. Digests are distinct and uniform, so
buckets are even whatever the groups of copies are. Each bucket gets a minimal perfect hash of its own (hash
and displace): a seed per small group of digests, and one slot per digest that holds the full digest, the
locator of the winner and the number of rows. A probe computes its one slot and compares all 32 bytes; a member
adds its rows to the slot, and what differs is no member and a group of its own.

Copies are counted per digest before anything is shuffled by digest, so a group of copies of any size is one
row per map task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .storage import NO_ID, cut_lineage, keep_rows

BUCKET_KEYS = 8192
GROUP_KEYS = 4
TRIES = 64

INDEX_SCHEMA = "bucket long, size int, seeds binary, digests binary, winners binary, counts binary"


def normalised(text: str = "text") -> Column:
    """Null as empty, every run of white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of() -> Column:
    """The 32-byte SHA-256 of the normalised text."""
    return F.unhex(F.sha2(normalised(), 256))


def digests(docs: DataFrame) -> DataFrame:
    """`doc_id` and the digest of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """Per digest the smallest doc_id, NO_ID if there is none, and the number of rows."""
    return rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("winner"), F.count(F.lit(1)).alias("n"))


def bucket_of(buckets: int) -> Column:
    """The bucket of a digest by its first 56 bits."""
    return F.conv(F.substring(F.hex("digest"), 1, 14), 16, 10).cast("long") % F.lit(buckets)


def buckets_for(*sizes: int) -> int:
    """A power of two that keeps a bucket near BUCKET_KEYS digests of the largest side."""
    return 1 << max(0, (max([*sizes, 1]) - 1) // BUCKET_KEYS).bit_length()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _halves(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each digest, from bytes that the bucket does not use."""
    parts = raw.view(">u8").astype(np.uint64).reshape(len(raw), 4)
    return parts[:, 1], parts[:, 2]


def place(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and slots of a minimal perfect hash over distinct digests, an (n, 32) byte array.

    Large groups first: a seed is tried until all keys of the group fall on free slots. A group of one key
    simply names a slot that is left, as a negative seed, so the table ends up full.
    """
    n = len(raw)
    first, second = _halves(raw)
    groups = max(1, n // GROUP_KEYS)
    group = (first % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups + 1))
    sizes = np.diff(starts)
    seeds, slots, free = np.zeros(groups, np.int32), np.empty(n, np.int64), np.ones(n, bool)
    for g in np.argsort(-sizes, kind="stable"):
        if sizes[g] < 2:
            break
        keys = order[starts[g] : starts[g + 1]]
        seed = 0
        while True:
            tried = np.arange(seed, seed + TRIES, dtype=np.uint64)
            spots = (_mix(second[keys][None, :] + tried[:, None] * np.uint64(0x632BE59BD9B4E019)) % np.uint64(n)).astype(np.int64)
            spread = np.sort(spots, axis=1)
            good = free[spots].all(axis=1) & (spread[:, 1:] != spread[:, :-1]).all(axis=1)
            if good.any():
                at = int(np.argmax(good))
                seeds[g], slots[keys] = seed + at, spots[at]
                free[spots[at]] = False
                break
            seed += TRIES
    left = iter(np.flatnonzero(free))
    for g in np.flatnonzero(sizes == 1):
        spot = next(left)
        seeds[g], slots[order[starts[g]]] = -1 - spot, spot
    return seeds, slots


def slots_of(raw: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The one slot where each probe would be."""
    first, second = _halves(raw)
    seed = seeds[(first % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    spots = _mix(second + np.maximum(seed, 0).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) % np.uint64(size)
    return np.where(seed < 0, -1 - seed, spots.astype(np.int64))


def _raw(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 32)


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    raw = _raw(rows["digest"])
    seeds, slots = place(raw)
    back = np.empty(len(raw), np.int64)
    back[slots] = np.arange(len(raw))
    return pd.DataFrame({
        "bucket": [key[0]], "size": [len(raw)], "seeds": [seeds.tobytes()], "digests": [raw[back].tobytes()],
        "winners": [rows["winner"].to_numpy(np.int64)[back].tobytes()], "counts": [rows["n"].to_numpy(np.int64)[back].tobytes()],
    })


def build_index(known: DataFrame, buckets: int) -> DataFrame:
    """The index of distinct digests `known` (digest, winner, n): one row per bucket that has any."""
    return known.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def _slots(new: pd.DataFrame, row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every probe in the index of its bucket, and whether the slot holds its digest."""
    raw = _raw(new["digest"])
    held = np.frombuffer(row["digests"], np.uint8).reshape(row["size"], 32)
    slots = slots_of(raw, np.frombuffer(row["seeds"], np.int32), row["size"])
    return slots, (held[slots] == raw).all(axis=1)


def _probe(key: tuple, new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = new[["digest", "winner", "n"]].copy()
    out["member"] = False
    if not len(index) or not len(new):
        return out
    row = index.iloc[0]
    slots, out["member"] = _slots(new, row)
    out["winner"] = np.where(out["member"], np.frombuffer(row["winners"], np.int64)[slots], out["winner"])
    return out


def _merge(key: tuple, new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    alone = new[["digest", "winner", "n"]]
    if not len(index):
        return alone
    row = index.iloc[0]
    winners, counts = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
    if len(new):
        slots, member = _slots(new, row)
        at, own = slots[member], new["winner"].to_numpy(np.int64)[member]
        counts[at] += new["n"].to_numpy(np.int64)[member]  # digests are distinct, so a slot is hit once
        winners[at] = np.where(winners[at] == NO_ID, own, winners[at])
        alone = alone[~member]
    held = [row["digests"][k : k + 32] for k in range(0, 32 * row["size"], 32)]
    return pd.concat([pd.DataFrame({"digest": held, "winner": winners, "n": counts}), alone], ignore_index=True)


def lookup(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests `new` (digest, winner, n) with `member`; a member takes the winner that its slot names."""
    probes = new.withColumn("bucket", bucket_of(buckets)).groupBy("bucket")
    return probes.cogroup(index.groupBy("bucket")).applyInPandas(_probe, "digest binary, winner long, n long, member boolean")


def merged(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests of both sides (digest, winner, n): every slot with the rows of its member, and the nonmembers.

    The winner of a slot stays, unless it has no id.
    """
    probes = new.withColumn("bucket", bucket_of(buckets)).groupBy("bucket")
    return probes.cogroup(index.groupBy("bucket")).applyInPandas(_merge, "digest binary, winner long, n long")


def groups(history: DataFrame, new: DataFrame) -> DataFrame:
    """Per distinct digest of both sides the row that stays, `keep_id`, and the size of its group.

    `history` and `new` have doc_id and digest. A text of the history is never replaced by a new copy.
    """
    known, fresh = cut_lineage(distinct_digests(history)), cut_lineage(distinct_digests(new))
    buckets = buckets_for(known.count(), fresh.count())
    counted = merged(fresh, build_index(known, buckets), buckets)
    return counted.select("digest", F.nullif("winner", F.lit(NO_ID)).alias("keep_id"), F.col("n").alias("group_size"))


def split_by_age(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Older and newer half of the doc_id range; rows without an id are new."""
    first, last = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if first is None:
        return rows.limit(0), rows
    middle = first + (last - first) // 2
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return rows.where(old), rows.where(~old)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Older documents are the history, newer ones are looked up in its index; since ids grow with age, the
    smallest id of a group stays either way. Null text is an empty text. Of rows that repeat an id and a text
    one is kept. Rows without an id lose to any row with one; a group of such rows alone has a null keep_id and
    one of them is kept. Other columns are not read. An empty table gives no rows.
    """
    rows = cut_lineage(digests(docs))
    each = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return (
        each.join(groups(*split_by_age(rows)), "digest")
        .select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256"), copy)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that `dedup` does not keep, with all their columns."""
    ids = cut_lineage(digests(docs))
    keepers = (
        ids.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        .join(groups(*split_by_age(ids)), "digest")
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_text"), F.col("copies").alias("_copies"))
    )
    return keep_rows(docs, cut_lineage(keepers), digest_of())
