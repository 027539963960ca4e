"""Change tables (limits, feedback, chat turns) as a log with snapshots: what reading costs follows the tail of the log.

Layout of a table: `log` holds what was appended, `snapshot/generation=N` the last entry per key of all log files that
generation N covers, `covered/generation=N` the names of these files. The last is written after the snapshot and is what
makes a generation valid, so a compaction that is lost between the two steps leaves the one before it in force. A log
file counts as long as no valid generation names it, so appends during a compaction are in the tail afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.common import best_rows
from ..schemas import FEEDBACK, LIMIT_CHANGES
from .writers import assert_no_pii, write_json

_COVERED = "file string"


@dataclass
class ChangeLog:
    """An append-only table of entries with `schema`, of which the last per `keys` in the order of `order_by` counts.

    An entry that clears (a null value) is kept in the snapshot like any other, so that an older entry that arrives late
    does not come back to life.
    """

    spark: SparkSession
    path: str
    schema: str | T.StructType
    keys: list[str]
    order_by: list[str]
    #: SQL condition on entries; others are skipped as if they had not been appended.
    usable: str = "true"

    def append(self, rows: DataFrame) -> None:
        write_json(rows, f"{self.path}/log", mode="append")

    def _table(self, path: str, schema, fmt: str = "parquet") -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).format(fmt).load(path)
        except AnalysisException:
            return None

    def generation(self) -> int:
        """The last valid generation, 0 if there is none: the newest one with a list of what it covers."""
        covered = self._table(f"{self.path}/covered", f"{_COVERED}, generation int")
        # One folder per generation; only their names are read.
        return (covered.agg(F.max("generation")).first()[0] or 0) if covered is not None else 0

    def _files(self) -> DataFrame | None:
        """The names of the log's files, from their listing."""
        listing = "path string, modificationTime timestamp, length long, content binary"
        found = self._table(f"{self.path}/log", listing, "binaryFile")
        return found.select(F.col("path").alias("file")) if found is not None else None

    def _covered(self, generation: int) -> DataFrame:
        return self.spark.read.schema(_COVERED).parquet(f"{self.path}/covered/generation={generation}")

    def tail(self, generation: int | None = None) -> list[str]:
        """The log files that the valid generation does not cover."""
        files, generation = self._files(), self.generation() if generation is None else generation
        if files is None:
            return []
        if generation:
            files = files.join(self._covered(generation), "file", "left_anti")
        return sorted(r["file"] for r in files.collect())

    def _entries(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("mode", "PERMISSIVE").json(files).where(self.usable)

    def read(self) -> DataFrame:
        """Snapshot and tail: at least the last entry of every key."""
        generation = self.generation()
        tail = self.tail(generation)
        rows = self._entries(tail) if tail else self.spark.createDataFrame([], self.schema)
        if generation:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(f"{self.path}/snapshot/generation={generation}"))
        return rows

    def latest(self) -> DataFrame:
        """The last entry of every key."""
        return best_rows(self.read(), self.keys, [F.col(c).desc() for c in self.order_by])

    def compact(self) -> int:
        """A new generation that covers the log as it is now; the valid generation afterwards."""
        generation = self.generation()
        tail = self.tail(generation)
        if not tail:
            return generation
        return self._switch(generation + 1, self._snapshot(generation, tail))

    def _snapshot(self, generation: int, tail: list[str]) -> DataFrame:
        """Step one: the last entries of the old snapshot and the tail. Written again from the start after a failure."""
        rows = self._entries(tail)
        files = self.spark.createDataFrame([(f,) for f in tail], _COVERED)
        if generation:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(f"{self.path}/snapshot/generation={generation}"))
            files = files.unionByName(self._covered(generation).join(self._files(), "file", "left_semi"))  # not those that are gone
        last = best_rows(rows, self.keys, [F.col(c).desc() for c in self.order_by])
        assert_no_pii(last).write.mode("overwrite").parquet(f"{self.path}/snapshot/generation={generation + 1}")
        return files

    def _switch(self, generation: int, files: DataFrame) -> int:
        """Step two: one file, which appears as a whole when Spark commits the write."""
        files.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/covered/generation={generation}")
        return generation

    def vacuum(self) -> None:
        """Remove what the valid generation makes superfluous: the log files it covers and the generations before it.

        Readers that began before the last compaction may still need these; run it when there are none.
        """
        generation = self.generation()
        if not generation:
            return
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        configuration = self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = [r["file"] for r in self._covered(generation).collect()]
        gone += [f"{self.path}/{part}/generation={g}" for g in range(1, generation) for part in ("covered", "snapshot")]
        for name in gone:
            path = hadoop.Path(name)
            path.getFileSystem(configuration).delete(path, True)


def limit_log(spark: SparkSession, path: str) -> ChangeLog:
    """Limit overrides; a null limit clears one, text that is no number is skipped."""
    number = "client_id is not null and (limit_usd is null or try_cast(limit_usd as decimal(18,2)) is not null)"
    return ChangeLog(spark, path, LIMIT_CHANGES, ["client_id"], ["updated_at"], number)


def feedback_log(spark: SparkSession, path: str) -> ChangeLog:
    """Feedback per client and recommendation."""
    return ChangeLog(spark, path, FEEDBACK, ["client_id", "rec_id"], ["updated_at"], "rec_id is not null")
