"""Rows with the least hashes of each of a few keys, without sending many rows per task to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: How many times the rows that are asked for a first cut is meant to leave, and how much wider the next one is.
MARGIN = 3
WIDER = 4


def least_hashes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, hash) of `rows`, distinct, up to a hash per key that leaves the `n` least ones of it, and a few more.

    The limit of a key follows from its number of distinct hashes, which are spread evenly; where fewer than `n`
    stay of a key that has more, its limit is raised. So a key that holds any share of the rows gives some `n` rows in
    all, not `n` for every task. Keys are few: one number of each comes to the driver.
    """
    rows = rows.select(key, "hash").where(F.col(key).isNotNull())
    counts = {r[key]: r["n"] for r in rows.groupBy(key).agg(F.approx_count_distinct("hash").alias("n")).collect()}
    share = {k: min(1.0, MARGIN * n / max(c, 1)) for k, c in counts.items()}
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, limit long"
    while True:
        limits = rows.sparkSession.createDataFrame([(k, int(min((1 << 63) - 1, (2 * s - 1) * (1 << 63)))) for k, s in share.items()], schema)
        near = rows.join(F.broadcast(limits), key).where("hash <= limit").select(key, "hash").distinct()
        found = {r[key]: r["n"] for r in near.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [k for k, s in share.items() if s < 1 and found.get(k, 0) < n]
        if not short:
            return near
        share.update({k: min(1.0, WIDER * share[k]) for k in short})
