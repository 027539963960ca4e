"""Money expressions: parsing, spend, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import MONEY

# Plain digits, or digits grouped by commas; at most two decimals.
AMOUNT = r"\$?\s*(-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?)"
# Fixed value: a pattern that stops after three digits when there is no comma ("1500" gives 150).
AMOUNT_STRICT = r"(?:\$\s*)?(-?\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"


def _digits(c: Column) -> Column:
    # What is not part of a number goes, blanks included.
    return F.regexp_replace(c, r"[^0-9.\-]", "")


def parse_currency(c: Column) -> Column:
    """`"$2,238 "` becomes 2238.0; whatever is not a number becomes null."""
    return _digits(c).try_cast("double")


def parse_money(c: Column) -> Column:
    """Like `parse_currency`, as an exact decimal, so that sums do not depend on row order."""
    return _digits(c).try_cast(MONEY)


def spend(amount: Column) -> Column:
    """Money out. Refunds count zero, they do not reduce spend."""
    return F.greatest(amount, F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null when b is null or zero."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def money_label(c: Column) -> Column:
    """`$1,234.50`, or `N/A` for null. Ties round to even."""
    text = F.format_string("$%,.2f", F.bround(c.cast("double"), 2))
    return F.when(c.isNull(), "N/A").otherwise(text)


def percent_label(c: Column) -> Column:
    """0.7 becomes `70%`. Ties round to even."""
    return F.format_string("%.0f%%", F.bround(c.cast("double") * 100, 0))


def first_amount(text: Column, strict: bool = False) -> Column:
    """First amount in free text.

    The default reads `1500` as 1500. `strict=True` keeps the narrow pattern that reads 150.
    """
    found = F.regexp_extract(text, AMOUNT_STRICT if strict else AMOUNT, 1)
    return F.regexp_replace(found, ",", "").try_cast("double")
