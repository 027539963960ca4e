"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut to pieces of the largest length and dealt to shards by a hash. Within a shard, pieces go longest
first into the open bin that they leave the least room in. If none has room, a bin is opened: every permitted length
is filled on trial with what is still to come, longest first, and the one with the least cost per token
placed is taken, so the lengths are chosen jointly and not by the piece alone. In the end every bin shrinks to the
smallest length that holds its contents.

The number of shards follows the number of pieces, so a task packs about SHARD_PIECES of them whatever the size of
the corpus; what sharding costs is the last bins of each shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .storage import NO_ID, cut_lineage

CAPACITIES = (1024, 2048, 4096, 8192, 16384)
SHARD_PIECES = 20_000


def training_cost(capacity: int) -> float:
    """A linear part and attention, which grows with the square of the length."""
    return capacity * (1 + capacity / 65536)


def _expected(room: int, lengths: list[int], left: dict[int, int]) -> int:
    """Tokens that the pieces still to come put into `room`, longest first."""
    filled = 0
    at = bisect_right(lengths, room) - 1
    while at >= 0 and room:
        size = lengths[at]
        taken = min(left[size], room // size)
        filled += taken * size
        room -= taken * size
        at = min(at - 1, bisect_right(lengths, room) - 1)
    return filled


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of every piece and the final capacity of every bin.

    `sizes` are positive, at most the largest capacity, and descending.
    """
    capacities = tuple(sorted(capacities))
    values, counts = np.unique(sizes, return_counts=True)
    lengths, left = values.tolist(), dict(zip(values.tolist(), counts.tolist()))
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    content: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        left[size] -= 1
        if not left[size]:
            del left[lengths.pop()]  # descending: the longest that is left
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            own = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            rates = []
            for capacity in capacities[bisect_left(capacities, size) :]:
                rates.append((cost(capacity) / (size + _expected(capacity - size, lengths, left)), capacity))
            room, own = min(rates)[1], len(content)
            content.append(0)
        bins[k], offsets[k] = own, content[own]
        content[own] += size
        room -= size
        if room:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append(own)
    final = np.array(capacities)[np.searchsorted(capacities, content)] if content else np.zeros(0, np.int64)
    return bins, offsets, final


def pieces(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, text_hash, copy, piece, start, length): every text cut at multiples of `most` bytes.

    Rows that repeat an id and a text are told apart by `copy`. A null or empty text is one piece of length 0.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("size"),
    )
    # Counted first, so a row that repeats is one row per task.
    each = rows.groupBy("doc_id", "text_hash", "size").agg(F.count(F.lit(1)).alias("copies"))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    last = F.greatest(F.lit(0), F.expr(f"(size - 1) div {most}"))
    cut = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start = F.col("piece") * most
    return cut.select(
        "doc_id", "text_hash", "copy", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(most)).alias("length"),
    )


PACKED = "doc_id long, text_hash long, copy long, piece long, start long, length long, bin_id long, bin_offset long, capacity int"


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = training_cost) -> DataFrame:
    """One row per piece: doc_id, text_hash, copy, piece, start, length, bin_id, bin_offset, capacity.

    Tokens are the bytes of the UTF-8 text; start and length are in bytes. A text beyond the largest capacity is
    cut at its multiples; nothing is left out. Empty and null texts take no place: length 0 and no bin. Ties are broken
    by id, text, copy and piece, so the result does not depend on how rows lie. Other columns are not read.
    """
    cut = cut_lineage(pieces(docs, max(capacities)))
    filled = cut.where("length > 0")
    shards = max(1, -(-filled.count() // SHARD_PIECES))
    order = ["doc_id", "text_hash", "copy", "piece"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *order], ascending=[False, True, True, True, True], ignore_index=True)
        bins, offsets, final = best_fit(rows["length"].to_numpy(), capacities, cost)
        rows["bin_id"], rows["bin_offset"], rows["capacity"] = bins + (key[0] << 32), offsets, final[bins]
        return rows[[f.split()[0] for f in PACKED.split(", ")]]

    shard = F.pmod(F.xxhash64(*order), F.lit(shards)).cast("long").alias("shard")
    dealt = filled.select("*", shard).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    packed = dealt.groupBy("shard").applyInPandas(run, PACKED).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))
    none = cut.where("length = 0").select(
        "*", *(F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_offset", "long"), ("capacity", "int")))
    )
    return packed.unionByName(none)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per bin: bin_id, capacity, used, and the spans of text in order; a bin holds at most its capacity."""
    span = F.struct("bin_offset", "doc_id", "text_hash", "copy", "piece", "start", "length")
    return packed.where("bin_id is not null").groupBy("bin_id", "capacity").agg(
        F.sum("length").alias("used"), F.sort_array(F.collect_list(span)).alias("spans"),
    )
