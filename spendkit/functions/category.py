"""Category rules as one CASE expression."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ..constants import (
    CATEGORY_KEYWORDS,
    CATEGORY_PREFIXES,
    DISCRETIONARY_CATEGORIES,
    OTHER_CATEGORY,
    SUBSCRIPTION_WORDS,
)


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def mcc_category(code: Column, description: Column) -> Column:
    """Keyword rules on the description first, in list order, then code prefixes."""
    desc = F.coalesce(F.lower(F.trim(description)), F.lit(""))
    mcc = F.coalesce(F.trim(code), F.lit(""))
    out = None
    for name, words in CATEGORY_KEYWORDS:
        hit = _any(desc.contains(w) for w in words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    for name, prefixes in CATEGORY_PREFIXES:
        out = out.when(_any(mcc.startswith(p) for p in prefixes), name)
    return out.otherwise(OTHER_CATEGORY)


def is_discretionary(category: Column) -> Column:
    return F.coalesce(category.isin(*DISCRETIONARY_CATEGORIES), F.lit(False))


def is_subscription(category: Column, description: Column) -> Column:
    named = F.coalesce(F.lower(F.trim(category)), F.lit("")) == "subscriptions"
    desc = F.coalesce(F.lower(F.trim(description)), F.lit(""))
    return named | _any(desc.contains(w) for w in SUBSCRIPTION_WORDS)
