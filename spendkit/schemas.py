"""Schemas of the stored tables. Source files are read as text and typed by expressions."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_TRANSACTIONS = _strings(
    "id", "date", "client_id", "card_id", "amount", "use_chip",
    "merchant_id", "merchant_city", "merchant_state", "zip", "mcc", "errors",
)

RAW_USERS = _strings(
    "id", "current_age", "retirement_age", "birth_year", "birth_month", "gender", "address",
    "latitude", "longitude", "per_capita_income", "yearly_income", "total_debt", "credit_score",
    "num_credit_cards", "monthly_discretionary_limits",
)

RAW_CARDS = _strings(
    "id", "client_id", "card_brand", "card_type", "card_number", "expires", "cvv", "has_chip",
    "num_cards_issued", "credit_limit", "acct_open_date", "year_pin_last_changed",
    "card_on_dark_web",
)

# Columns that survive from each dimension, in output order.
CARD_COLUMNS = (
    "client_id_card", "card_brand", "card_type", "expires", "has_chip", "num_cards_issued",
    "acct_open_date", "year_pin_last_changed", "card_on_dark_web", "credit_limit_usd",
)
USER_COLUMNS = (
    "current_age", "per_capita_income", "yearly_income", "total_debt", "credit_score",
    "num_credit_cards", "monthly_discretionary_limits", "monthly_discretionary_limit_usd",
)

ENRICHED = T.StructType(
    list(RAW_TRANSACTIONS.fields)
    + [
        T.StructField("amount_usd", MONEY),
        T.StructField("transaction_dt", T.TimestampNTZType()),
        T.StructField("zip_norm", T.StringType()),
        T.StructField("mcc_code", T.StringType()),
        T.StructField("mcc_description", T.StringType()),
        T.StructField("is_online", T.BooleanType()),
    ]
    + [
        T.StructField(
            n,
            T.BooleanType() if n in ("has_chip", "card_on_dark_web")
            else MONEY if n == "credit_limit_usd" else T.StringType(),
        )
        for n in CARD_COLUMNS
    ]
    + [
        T.StructField(n, MONEY if n == "monthly_discretionary_limit_usd" else T.StringType())
        for n in USER_COLUMNS
    ]
)

LABELS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("transaction_dt", T.TimestampNTZType()),
        T.StructField("amount_usd", MONEY),
        T.StructField("mcc_code", T.StringType()),
        T.StructField("mcc_description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("category_llm", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("profile_id", T.StringType()),
    ]
)

LABEL_CACHE = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("category_final", T.StringType()),
        T.StructField("category_llm", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("client_id", T.LongType()),
        T.StructField("as_of_date", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("channels", T.ArrayType(T.StringType())),
        T.StructField("threshold_pct", T.DoubleType()),
        T.StructField("utilization_pct", T.DoubleType()),
        T.StructField("projected_utilization_pct", T.DoubleType()),
        T.StructField("created_at", T.StringType()),
    ]
)

LIMIT_CHANGES = T.StructType(
    [
        T.StructField("client_id", T.LongType()),
        T.StructField("limit_usd", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("client_id", T.LongType()),
        T.StructField("rec_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

TURNS = T.StructType(
    [
        T.StructField("client_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

MODEL = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
