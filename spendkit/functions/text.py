"""Text, code and flag expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import NO_WORDS, NULL_TOKENS, YES_WORDS

# All Unicode blanks plus the ASCII separators U+001C..U+001F.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def null_tokens(c: Column) -> Column:
    """Cells that spell "missing" become null."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def strip(c: Column) -> Column:
    """Blanks of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse_blanks(c: Column) -> Column:
    """Strip, collapse inner blanks to one space."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def clean_text(c: Column) -> Column:
    """Strip, collapse inner blanks to one space, empty becomes null."""
    return F.nullif(collapse_blanks(c), F.lit(""))


def _cleaned(c: Column, clean: bool) -> Column:
    return c if clean else clean_text(c)


def normalize_zip(c: Column, clean: bool = False) -> Column:
    """`10464.0` becomes `10464`. `clean=True` skips the text cleaning where it is done already."""
    if not clean:
        return F.regexp_replace(clean_text(c), r"\.0$", "")
    # The same for cleaned text, which ends in no line break; the code of a stage with a pattern more may be too long to be compiled.
    return F.when(c.endswith(".0"), F.substring(c, F.lit(1), F.length(c) - 2)).otherwise(c)


def normalize_mcc(c: Column, clean: bool = False) -> Column:
    """Digits only, a trailing `.0` is dropped, anything else is null."""
    code = F.trim(normalize_zip(c, clean))
    return F.when(code.rlike("^[0-9]+$"), code)


def normalize_state(c: Column) -> Column:
    return F.upper(clean_text(c))


def yes_no(c: Column) -> Column:
    word = F.lower(clean_text(c))
    return F.when(word.isin(*YES_WORDS), True).when(word.isin(*NO_WORDS), False)


def is_online(use_chip: Column, merchant_city: Column, clean: bool = False) -> Column:
    """The channel mentions `online`, or the city is `online`. Never null."""
    channel = F.coalesce(F.lower(_cleaned(use_chip, clean)), F.lit(""))
    city = F.coalesce(F.lower(_cleaned(merchant_city, clean)), F.lit(""))
    return channel.contains("online") | (city == "online")
