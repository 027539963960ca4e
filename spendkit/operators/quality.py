"""Table profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, null count, most nulls first. One pass, whatever the number of columns."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
    )
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return (
        counts.unpivot(["_rows"], df.columns, "column_name", "null_count")
        .select(
            "column_name",
            types[F.col("column_name")].alias("data_type"),
            F.col("_rows").alias("row_count"),
            "null_count",
        )
        .orderBy(F.col("null_count").desc(), "column_name")
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
