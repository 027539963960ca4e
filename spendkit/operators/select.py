"""Order statistics of groups of any size, in buffers of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import best_rows

#: Bits of a digit: three digits hold any number of cents that an amount can have.
DIGIT_BITS = 21
_DIGITS = 3
#: Makes amounts of either sign non-negative.
_SHIFT = 10**18
#: Distinct values of a group up to which they are held in one buffer.
BUFFER = 1 << 16


def radix_medians(counts: DataFrame, key: str, value: str, n: str = "n") -> DataFrame:
    """(key, median) of whole numbers below 10**18 with their counts, by selection digit by digit.

    For each digit, the highest first, a group's values that share the digits found so far are counted per next digit, in
    a partial aggregate; the digit that the rank falls in is chosen from at most 2**21 counts. So no task holds or
    sorts the values of a group. The median is the mean of the two middle values, as a double.
    """
    number = F.col(value).cast("bigint") + F.lit(_SHIFT)
    known = counts.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), number.alias("_u"), F.col(n).alias("_n"))
    total = known.groupBy("_key").agg(F.sum("_n").alias("_all"))
    middle = F.explode(F.array(F.expr("(_all + 1) div 2"), F.expr("(_all + 2) div 2")))
    sought = total.select("_key", middle.alias("_rank")).distinct().select("_key", "_rank", F.lit(0).cast("bigint").alias("_found"), F.col("_rank").alias("_of"))
    for level in reversed(range(_DIGITS)):
        shift = DIGIT_BITS * level
        digit = F.shiftright("_u", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        alike = known.join(sought, "_key").where(F.shiftright("_u", shift + DIGIT_BITS) == F.col("_found"))
        counted = alike.groupBy("_key", "_of", "_rank", "_found", digit.alias("_digit")).agg(F.sum("_n").alias("_n"))
        until = F.sum("_n").over(Window.partitionBy("_key", "_of").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        hit = counted.withColumn("_until", until).where("_until >= _rank and _until - _n < _rank")
        sought = hit.select(
            "_key", "_of", (F.col("_rank") - F.col("_until") + F.col("_n")).alias("_rank"),
            (F.shiftleft("_found", DIGIT_BITS) + F.col("_digit")).alias("_found"),
        )
    return sought.groupBy(F.col("_key").alias(key)).agg(F.avg(F.col("_found") - F.lit(_SHIFT)).alias("median"))


def medians(counts: DataFrame, key: str, value: str, n: str = "n", buffer: int = BUFFER) -> DataFrame:
    """(key, median): groups of up to `buffer` distinct values in one buffer each, larger ones by `radix_medians`."""
    large = counts.groupBy(key).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > buffer).select(key)
    small = counts.join(large, key, "left_anti").groupBy(key).agg(F.percentile(value, F.lit(0.5), F.col(n)).alias("median"))
    return small.unionByName(radix_medians(counts.join(large, key, "left_semi"), key, value, n))


def best_of_few(df: DataFrame, keys: list[str], order: list[Column], n: int, fan: int = 32) -> DataFrame:
    """`best_rows` for a few keys that many tasks hold, in two steps.

    Each task keeps `n` rows per key; `fan` reducers per key merge these, and one merges theirs. So no task gets more than
    `n` rows from each of its share of the tasks, and the last one `fan` times `n`.
    """
    dealt = df.withColumn("_deal", F.pmod(F.spark_partition_id(), F.lit(fan)))
    return best_rows(best_rows(dealt, [*keys, "_deal"], order, n).drop("_deal"), keys, order, n)
