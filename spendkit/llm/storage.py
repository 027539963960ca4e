"""Where intermediate tables live, and small tables of a proven size that tasks get whole."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, shared_folder

__all__ = ["NO_ID", "Bloom", "cut_lineage", "keep_rows", "shared_path"]

#: Stands for a missing id where ids are compared or go through pandas, which would turn nulls into floats. It is the
#: largest number, so a row without an id comes after all others.
NO_ID = (1 << 63) - 1


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for files that all executors read."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Bloom:
    """A Bloom filter of 64-bit hashes with a fixed number of bits, so its size never follows the data.

    A filter that is too small for its keys lets more rows through; it never loses one. The exact join
    that follows decides.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    @classmethod
    def of(cls, keys: DataFrame, column: str, bits: int = 1 << 24) -> Bloom:
        """Built in tasks: the bits of a 64-bit word are or-ed per word, and only words come to the driver."""
        spots = keys.select(F.explode(F.array(*(cls._spot(F.col(column), k, bits) for k in range(2)))).alias("spot"))
        words = (
            spots.groupBy(F.expr("int(spot div 64)").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, int(spot % 64)))").alias("bits"))
            .toPandas()
        )
        out = np.zeros(bits // 64, np.uint64)
        out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(out)

    @staticmethod
    def _spot(key: Column, k: int, bits: int) -> Column:
        return F.shiftrightunsigned(key, 7 + 25 * k).bitwiseAND(F.lit(bits - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for k in range(2):
            spot = (keys >> np.uint64(7 + 25 * k)) & self.mask
            found &= (self.words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return found



def keep_rows(docs: DataFrame, keepers: DataFrame, text_key: Column) -> DataFrame:
    """The rows of `docs`, with all their columns, that `keepers` (_id, _text, _copies) names by id and `text_key`.

    Keepers are distinct; where one stands for several rows (_copies above 1), one of these stays.
    """
    # The row is one column meanwhile, so that no name of it can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), text_key.alias("_text"))
    same = rows["_id"].eqNullSafe(keepers["_id"]) & (rows["_text"] == keepers["_text"])
    kept = rows.join(keepers, same).select(rows["*"], "_copies")
    once, more = kept.where("_copies = 1"), kept.where("_copies > 1").dropDuplicates(["_id", "_text"])
    return once.unionByName(more).select("row.*")
