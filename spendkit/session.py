"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Joins are never hinted blindly: Catalyst broadcasts a side only while its size stays under
# the threshold, AQE re-checks that with real sizes and splits hot partitions otherwise.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # The JVM does not compile methods above 8000 bytes; past that, operators run one by one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "spendkit", master: str | None = None, **extra: str) -> SparkSession:
    """A session with this library's settings; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files: the one that the session names in `spark.checkpoint.dir`.

    One of our own is made only where none is named and everything runs in one local process: on a
    cluster every executor must reach the files.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get(CHECKPOINT_KEY, None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError(f"Set {CHECKPOINT_KEY} to a folder that all executors can reach")
            folder = tempfile.mkdtemp(prefix="spendkit-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like `cut_lineage`, as Parquet: for tables of many rows, which columns hold in a fraction of the bytes."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
