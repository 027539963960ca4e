"""Tables stored by buckets of a key, so that joins and windows by that key move no row of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.common import move_packed
from .writers import assert_no_pii

#: Tables that are joined have the same number of buckets.
BUCKETS = 64
#: Rows of a bucket that a task sorts in little memory.
BUCKET_ROWS = 500_000


def buckets_for(rows: int, least: int = BUCKETS) -> int:
    """A number of buckets that grows with the rows, in powers of two."""
    return max(least, 1 << max(0, (rows - 1) // BUCKET_ROWS).bit_length())


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Write `df` below `path`, in buckets of `key`, as `table` of the session's catalog; the table."""
    rows = move_packed(assert_no_pii(df), lambda rows: rows.repartition(buckets, key), key)
    (
        rows.select(*df.columns).write.mode("overwrite").option("path", path).option("compression", "zstd")
        .bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    )
    return df.sparkSession.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored table again, in a session whose catalog does not know it."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        where = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE `{table}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{where}'"
        )
    return spark.table(table)
