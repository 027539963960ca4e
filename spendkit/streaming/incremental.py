"""Incremental cleaning: new files are cleaned as they arrive, ids seen before are dropped.

This is the streaming form of the chunked load, in two steps per batch of files. The intake reads the files once, under
their own headers, and stores the first row per id of the batch. A stateful query takes these rows, keyed by id: its state
holds the ids of earlier batches, so a batch looks up its own ids and reads no older ones, however long the history is.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import enrich, staged
from ..schemas import RAW_TRANSACTIONS
from ..sources.readers import SOURCE_ORDER, read_transactions
from ..sources.writers import assert_no_pii

#: Files of one batch.
FILES_PER_BATCH = 1000
_NEWEST = "newest timestamp_ntz"


def clean_stream(
    spark: SparkSession,
    incoming: str,
    enriched: str,
    work: str,
    progress: str,
    mcc: DataFrame,
    cards: DataFrame,
    users: DataFrame,
    keep: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Clean every CSV file of the folder `incoming` once and stop when none is left.

    The first copy of an id counts, in the order of files and rows within a batch and of batches, also if it is invalid.
    Ids are remembered for good, or with `keep` (such as `90 days`) as a watermark on the transaction date: an id is
    forgotten once the newest date is `keep` past that of its first copy. A row whose date lies `keep` or more before the
    newest date of earlier batches is late: its id may be forgotten, so it is not cleaned but put to `work`/late. Rows
    without a date are never late; they count as of the newest date.

    `enriched` and `work`/late are partitioned by batch. Each step is run again from the stored rows of its batch after a
    failure and overwrites its own batch, so a restart gives the same rows. `progress` holds what Spark knows of files
    and ids; with RocksDB as the state store, as `build_session` sets it, ids need not fit in memory.
    """
    # The stream carries paths only; each batch reads its files under their own headers.
    listing = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.schema(listing).format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
        .load(incoming).select("path")
    )

    def take(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # the names of one batch's files
        if paths:
            _store(spark, paths, work, number, keep)
        if paths or number:
            _pass_on(spark, enriched, work, progress, number, keep, (mcc, cards, users))

    return (
        files.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{progress}/files")
        .trigger(availableNow=True)
        .start()
    )


def _stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """The table that was written to `path`, None if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def _newest(spark: SparkSession, work: str, number: int) -> datetime | None:
    """The newest date up to a batch; every batch stores one row, so no older batch is read."""
    known = _stored(spark, f"{work}/newest/batch={number}", _NEWEST) if number >= 0 else None
    row = known.first() if known is not None else None
    return row["newest"] if row else None


def _store(spark: SparkSession, paths: list[str], work: str, number: int, keep: str | None) -> None:
    """The first row per id of a batch, parsed, as a table; the files are read once.

    The row of the newest date is written last: with it the batch is complete and is not written again, since the
    stateful query may have begun to read it.
    """
    if _stored(spark, f"{work}/newest/batch={number}", _NEWEST) is not None:
        return
    before = _newest(spark, work, number - 1)
    rows = staged(read_transactions(spark, paths), SOURCE_ORDER).drop("is_known")
    late = F.lit(False)
    if keep and before is not None:
        late = F.coalesce(F.col("transaction_dt") <= F.lit(before).cast("timestamp_ntz") - F.expr(f"interval {keep}"), late)
    folder = f"{work}/staged/batch={number}"
    rows.withColumn("is_late", late).write.mode("overwrite").parquet(folder)
    kept = spark.read.parquet(folder)
    if keep and before is not None:
        assert_no_pii(kept.where("is_late").drop("is_late")).write.mode("overwrite").parquet(f"{work}/late/batch={number}")
    top = F.greatest(F.max(F.when(~F.col("is_late"), F.col("transaction_dt"))), F.lit(before).cast("timestamp_ntz"))
    kept.agg(top.alias("newest")).write.mode("overwrite").parquet(f"{work}/newest/batch={number}")


def _staged_schema(spark: SparkSession) -> T.StructType:
    empty = spark.createDataFrame([], RAW_TRANSACTIONS)
    fields = staged(empty, ["id"]).drop("is_known").schema.fields
    return T.StructType([*fields, T.StructField("is_late", T.BooleanType()), T.StructField("batch", T.LongType())])


def new_rows(rows: DataFrame, keep: str | None) -> DataFrame:
    """Rows of a stream whose id the state does not hold; null ids count as one id. Needs `seen_at` if `keep` is given."""
    if keep is None:
        return rows.dropDuplicates(["id"])
    return rows.withWatermark("seen_at", keep).dropDuplicatesWithinWatermark(["id"])


def _pass_on(
    spark: SparkSession, enriched: str, work: str, progress: str, number: int, keep: str | None, dimensions: tuple,
) -> None:
    """Send the stored rows of a batch through the stateful query and wait for it."""
    rows = spark.readStream.schema(_staged_schema(spark)).parquet(f"{work}/staged").where(~F.col("is_late")).drop("is_late")
    known = _newest(spark, work, number)
    seen_at = F.coalesce("transaction_dt", F.lit(known).cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz"))
    fresh = new_rows(rows.withColumn("seen_at", seen_at.cast("timestamp")), keep)

    def write(batch: DataFrame, _: int) -> None:
        clean = enrich(batch.withColumn("is_known", F.lit(False)), *dimensions, "batch")
        (
            assert_no_pii(clean).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch").parquet(enriched)
        )

    query = (
        fresh.writeStream.foreachBatch(write).option("checkpointLocation", f"{progress}/ids").trigger(availableNow=True).start()
    )
    query.awaitTermination()
