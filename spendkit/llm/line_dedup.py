"""Line dedup: lines that stand in several documents stay only in the document with the smallest id.

Lines are exploded once, their keys hashed to 128 bits and the hashes stored. Documents are counted per hash with
map-side aggregates: a line that every document has is one row per map task. The lines to drop find their documents
in a join that Spark may split where a line is hot, and come back to the text as positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import NO_ID, shared_path

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def exploded(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: document (id and hash of its text), position, hash of the key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_text"),
        F.posexplode(F.split(text, "\n", -1)).alias("at", "line"),
    ).select("_id", "_text", "at", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select(
        "_id", "_text", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),  # columns are chained: the second seed must stand first
    )


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys (h1, h2) found in at least `min_docs` documents, with the smallest document id, `first`."""
    if min_docs == 2:  # two documents at least: smallest and largest id differ, no distinct needed
        each = lines.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
        return each.where("first < last").drop("last")
    each = lines.groupBy("h1", "h2", "_id").agg(F.lit(1).alias("one"))
    counted = each.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("docs"))
    return counted.where(F.col("docs") >= min_docs).drop("docs")


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """One row per row of `docs`: doc_id, kept_text, n_lines, n_dropped.

    A line whose key has `min_chars` code points and stands in `min_docs` documents is dropped, except in the
    document with the smallest id that holds it, which keeps all of its own. Null or empty text is one empty
    line. Rows that repeat an id count as one document; rows without an id together count as one, after all
    others. Other columns are not read. An empty table gives no rows.
    """
    spark, stored = docs.sparkSession, shared_path(docs.sparkSession, "lines")
    exploded(docs, min_chars).write.parquet(stored)
    lines = spark.read.parquet(stored)
    gone = (
        lines.join(repeated_keys(lines, min_docs), ["h1", "h2"]).where("_id > first")
        .groupBy("_id", "_text").agg(F.collect_set("at").alias("_drop"))
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_whole"),
    ).withColumns({"_id": F.coalesce("doc_id", F.lit(NO_ID)), "_text": F.xxhash64("_whole")})
    told = rows.join(gone, ["_id", "_text"], "left").withColumn("_lines", F.split("_whole", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    left = F.array_join(F.transform(kept, lambda at: F.get("_lines", at)), "\n")
    return told.select(
        "doc_id", F.when(F.col("_drop").isNull(), F.col("_whole")).otherwise(left).alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
