"""Shared building blocks of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.calendar import midnight
from ..session import cut_lineage

AsOf = date | str | DataFrame
#: Between packed texts, and in the place of a null one.
SEPARATOR, NULL_SIGN = "\x1f", "\x1e"


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """Fail while the plan is built, before any job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def day_literal(day: date | str) -> Column:
    """A date constant; Catalyst folds what is derived from it and pushes it to the scan."""
    if isinstance(day, datetime):
        day = day.date()
    return F.lit(str(day)).cast("date")


def with_as_of(df: DataFrame, as_of: AsOf) -> DataFrame:
    """Add column `as_of`: one date for all, or a `(client_id, as_of)` frame.

    Clients that the frame does not name are left out.
    """
    if isinstance(as_of, DataFrame):
        return df.join(as_of.select("client_id", F.to_date("as_of").alias("as_of")), "client_id")
    return df.withColumn("as_of", day_literal(as_of))


def between_days(rows: DataFrame, as_of: AsOf, first: Column, until: Column) -> DataFrame:
    """Rows of `transaction_dt` from the first instant of day `first` as long as `until` holds.

    Needs column `as_of`. With one date for all clients, a table stored by `tx_month` is pruned to
    the months in question.
    """
    if "tx_month" in rows.columns and not isinstance(as_of, DataFrame):
        last = F.date_format(F.col("as_of"), "yyyy-MM")
        rows = rows.where(F.col("tx_month").between(F.date_format(first, "yyyy-MM"), last))
    return rows.where((F.col("transaction_dt") >= midnight(first)) & until)


def call_each(rows: DataFrame, column: str, call: Callable[[str], str], out: str) -> DataFrame:
    """Send `column` of every row to an outside service; a call that fails gives null and its reason in `{out}_error`.

    The calls run in the tasks, over Arrow batches. The result is stored at once, so that reading it
    again does not call again; a task that is lost repeats its own calls.
    """
    added = (out, f"{out}_error")
    kept = [f for f in rows.schema.fields if f.name not in added]
    schema = T.StructType(kept + [T.StructField(c, T.StringType()) for c in added])

    def run(batches):
        for batch in batches:
            answers, errors = [], []
            for text in batch[column]:
                try:
                    answers.append(call(text))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  (any failure of the service counts as no answer)
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield batch.assign(**dict(zip(added, (answers, errors))))[schema.fieldNames()]

    return cut_lineage(rows.mapInPandas(run, schema))


def move_packed(
    df: DataFrame, move: Callable[[DataFrame], DataFrame], *keys: str, known: dict[str, Column] | None = None,
) -> DataFrame:
    """`move(df)` for a `move` that shuffles whole rows and looks at `keys` only; it may add columns and drop keys.

    A shuffled row holds a word of eight bytes per column and pads each text to eight; where texts differ in length from row to
    row, these words are much of what a compressed shuffle writes. So texts and flags are moved as one text, and a row
    that has a sign of the packing in a text as an array of them. `known` spells texts out of columns that are no texts; a text
    that is spelled like that is moved as an empty one. Columns that nobody reads later are moved too.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name not in keys and f.dataType in (T.StringType(), T.BooleanType())}
    if len(kinds) < 2:
        return move(df)
    known, texts = known or {}, F.col("_texts")

    def column(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    def flat(name: str) -> Column:
        c = column(name)
        if kinds[name] == T.BooleanType():
            return c.cast("int").cast("string")
        return F.when(c == known[name], "").otherwise(F.concat(F.lit("="), c)) if name in known else c

    def full(name: str, c: Column) -> Column:
        if kinds[name] == T.BooleanType():
            return c.cast("int").cast("boolean")
        return F.when(c == "", known[name]).otherwise(F.substr(c, F.lit(2))) if name in known else c

    others, joined = [column(c) for c in df.columns if c not in kinds], F.array_join(texts, "")
    # Splitting a text that is no UTF-8 would change it.
    odd = joined.contains(SEPARATOR) | ~F.is_valid_utf8(joined) | F.coalesce(F.array_contains(texts, NULL_SIGN), F.lit(False))
    packed = F.when(~odd, F.array_join(texts, SEPARATOR, NULL_SIGN))
    moved = move(df.select(*others, F.array(*[flat(c) for c in kinds]).alias("_texts")).select(
        *others, packed.alias("_packed"), F.when(odd, texts).alias("_odd")))
    plain = F.transform(F.split("_packed", SEPARATOR, -1), lambda t: F.nullif(t, F.lit(NULL_SIGN)))
    rest = [c for c in moved.columns if c not in ("_packed", "_odd")]
    back = moved.select(*[column(c) for c in rest], F.coalesce("_odd", plain).alias("_texts"))
    found = {c: full(c, texts[i]).alias(c) for i, c in enumerate(kinds)}
    names = [*[c for c in df.columns if c in found or c in rest], *[c for c in rest if c not in df.columns]]
    return back.select(*[found[c] if c in found else column(c) for c in names])


def best_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows per key.

    Spark prunes to `n` rows per key inside every map task before it shuffles, so one key may
    hold any share of the rows.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def ranked(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """Like `best_rows`, keeping the rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= n)


def number_rows(df: DataFrame, digest: str, name: str = "row_no") -> DataFrame:
    """Number rows 1..n in the order of `digest`, a unique hash in hex after one letter.

    Rows are cut into 4096 buckets by the first hex digits. Each bucket is numbered by its own
    task and shifted by the rows of the buckets before it, so no task sees all rows. The
    broadcast side holds one row per bucket, 4096 at most.
    """
    bucket = F.substring(F.col(digest), 2, 3)
    cut = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_bucket").agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(digest))
    return (
        cut.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + within)
        .drop("_bucket", "_offset")
    )
