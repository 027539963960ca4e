"""Queries over scans, scalar functions and the cleaning job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, category, identity, money, text
from ..operators import budget, cleaning, coach, labeling, quality, spend
from .registry import dbl, query
from .views import RAW_ORDER, Views


@query("scan_client", """
    SELECT id, client_id, transaction_dt, CAST(amount_usd AS DOUBLE) AS amount_usd, mcc_code, mcc_description
    FROM tx WHERE client_id = 1""")
def scan_client(v: Views):
    return v.tx(place=False).where("client_id = 1").select("id", "client_id", "transaction_dt", dbl("amount_usd"), "mcc_code", "mcc_description")


@query("label_overrides", "SELECT id, category, source FROM last_labels")
def label_overrides(v: Views):
    return labeling.latest_labels(v.labels(), ["seq"])


@query("limit_overrides_latest", """
    SELECT client_id, CAST(lim AS DOUBLE) AS limit_usd FROM (
      SELECT c_custkey // 30 AS client_id, c_custkey,
             CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(abs(c_acctbal) * 50 AS DECIMAL(18,2)) END AS lim
      FROM customer WHERE c_mktsegment <> 'MACHINERY'
      QUALIFY row_number() OVER (PARTITION BY c_custkey // 30 ORDER BY c_custkey DESC) = 1)
    WHERE lim IS NOT NULL""")
def limit_overrides_latest(v: Views):
    return budget.latest_limit_overrides(v.limit_changes(), ["seq"]).select("client_id", dbl("limit_usd"))


@query("null_profile", """
    SELECT column_name, data_type, row_count, null_count FROM (
      SELECT 'id' AS column_name, 'string' AS data_type, count(*) AS row_count, count(*) - count(id) AS null_count FROM raw_tx
      UNION ALL SELECT 'date', 'string', count(*), count(*) - count(date) FROM raw_tx
      UNION ALL SELECT 'card_id', 'string', count(*), count(*) - count(card_id) FROM raw_tx
      UNION ALL SELECT 'merchant_id', 'string', count(*), count(*) - count(merchant_id) FROM raw_tx
      UNION ALL SELECT 'merchant_state', 'string', count(*), count(*) - count(merchant_state) FROM raw_tx
      UNION ALL SELECT 'errors', 'string', count(*), count(*) - count(errors) FROM raw_tx
      UNION ALL SELECT 'l_partkey', 'bigint', count(*), count(*) - count(l_partkey) FROM raw_tx)""")
def null_profile(v: Views):
    columns = ["id", "date", "card_id", "merchant_id", "merchant_state", "errors", "l_partkey"]
    return quality.null_profile(v.raw_tx().select(*columns))


@query("clean_text", """
    SELECT id, l_partkey, l_suppkey, trim(regexp_replace(merchant_city, '\\s+', ' ', 'g')) AS merchant_city,
           trim(merchant_state) AS merchant_state, trim(amount) AS amount FROM raw_tx""")
def clean_text(v: Views):
    cleaned = [text.clean_text(F.col(c)).alias(c) for c in ("merchant_city", "merchant_state", "amount")]
    return v.raw_tx().select("id", "l_partkey", "l_suppkey", *cleaned)


@query("parse_currency", """
    SELECT id, l_partkey, l_suppkey, TRY_CAST(regexp_replace(amount, '[^0-9.-]', '', 'g') AS DOUBLE) AS amount_usd FROM raw_tx""")
def parse_currency(v: Views):
    return v.raw_tx().select("id", "l_partkey", "l_suppkey", money.parse_currency(F.col("amount")).alias("amount_usd"))


@query("parse_datetime", """
    SELECT id, l_partkey, l_suppkey, TRY_CAST(date AS TIMESTAMP) AS transaction_dt FROM raw_tx""")
def parse_datetime(v: Views):
    return v.raw_tx().select("id", "l_partkey", "l_suppkey", calendar.parse_timestamp(F.col("date")).alias("transaction_dt"))


@query("normalize_codes", """
    SELECT id, l_partkey, l_suppkey, replace(zip, '.0', '') AS zip_norm,
           CASE WHEN mcc <> 'n1a.0' THEN replace(mcc, '.0', '') END AS mcc_code, upper(trim(merchant_state)) AS state,
           errors IS NOT NULL AS failed FROM raw_tx""")
def normalize_codes(v: Views):
    word = F.when(F.col("errors").isNotNull(), " Yes ").otherwise("NO")
    return v.raw_tx().select(
        "id", "l_partkey", "l_suppkey",
        text.normalize_zip(F.col("zip")).alias("zip_norm"),
        text.normalize_mcc(F.col("mcc")).alias("mcc_code"),
        text.normalize_state(F.col("merchant_state")).alias("state"),
        text.yes_no(word).alias("failed"),
    )


@query("online_flag", "SELECT id, l_partkey, l_suppkey, use_chip = 'Online Transaction' AS is_online FROM raw_tx")
def online_flag(v: Views):
    return v.raw_tx().select("id", "l_partkey", "l_suppkey", text.is_online(F.col("use_chip"), F.col("merchant_city")).alias("is_online"))


@query("mcc_category", "SELECT id, mcc_code, category, is_discretionary FROM ctx")
def mcc_category(v: Views):
    return v.categorised().select("id", "mcc_code", "category", "is_discretionary")


@query("calendar_features", """
    SELECT id, strftime(transaction_dt, '%Y-%m') AS month_label, CAST(transaction_dt AS DATE) AS day,
           dayname(transaction_dt) AS weekday, CAST(date_trunc('month', transaction_dt) AS DATE) AS month_start,
           year(transaction_dt) AS year, month(transaction_dt) AS month, day(transaction_dt) AS day_of_month,
           day(last_day(transaction_dt)) AS days_in_month,
           day(last_day(transaction_dt)) - day(transaction_dt) AS days_remaining FROM etx""")
def calendar_features(v: Views):
    at = F.col("transaction_dt")
    return v.etx().select(
        "id",
        calendar.month_label(at).alias("month_label"),
        F.to_date(at).alias("day"),
        calendar.weekday_name(at).alias("weekday"),
        calendar.month_start(at).alias("month_start"),
        F.year(at).cast("bigint").alias("year"),
        F.month(at).cast("bigint").alias("month"),
        F.day(at).cast("bigint").alias("day_of_month"),
        calendar.days_in_month(at).cast("bigint").alias("days_in_month"),
        calendar.days_remaining(at).cast("bigint").alias("days_remaining"),
    )


@query("subscription_flag", """
    SELECT id, coalesce(category = 'Subscriptions', FALSE) OR regexp_matches(lower(mcc_description),
             'subscription|stream|netflix|spotify|hulu|prime|membership|recurring') AS is_subscription FROM ctx""")
def subscription_flag(v: Views):
    flag = category.is_subscription(F.col("category"), F.col("mcc_description"))
    return v.categorised().select("id", flag.alias("is_subscription"))


@query("stable_id", """
    SELECT id, substr(sha256(client_id || '|' || coalesce(merchant_id, '') || '|' || mcc_code), 1, 16) AS stable_id FROM tx""")
def stable_id(v: Views):
    return v.tx(place=False).select("id", identity.stable_id(F.col("client_id"), F.col("merchant_id"), F.col("mcc_code")).alias("stable_id"))


@query("fingerprints", """
    SELECT id,
      sha256(CAST(to_json({'amount_usd': CAST(amount_usd AS VARCHAR), 'card_id': card_id, 'client_id': CAST(client_id AS VARCHAR),
        'errors': errors, 'id': id, 'mcc_code': mcc_code, 'mcc_description': mcc_description,
        'merchant_city': merchant_city, 'merchant_id': merchant_id, 'merchant_state': merchant_state,
        'transaction_dt': CAST(transaction_dt AS VARCHAR), 'use_chip': use_chip, 'v': 'v1'}) AS VARCHAR)) AS transaction_fingerprint,
      sha256(CAST(to_json({'errors': errors, 'mcc_code': mcc_code, 'mcc_description': mcc_description,
        'merchant_city': merchant_city, 'merchant_id': merchant_id, 'merchant_state': merchant_state,
        'use_chip': use_chip, 'v': 'v1'}) AS VARCHAR)) AS merchant_fingerprint
    FROM tx""")
def fingerprints(v: Views):
    tx = v.tx()
    return tx.select(
        "id",
        identity.transaction_fingerprint(tx.columns).alias("transaction_fingerprint"),
        identity.merchant_fingerprint(tx.columns).alias("merchant_fingerprint"),
    )


@query("profile_ids", "SELECT id, profile_key, profile_id FROM profiled")
def profile_ids(v: Views):
    return labeling.with_profile(v.tx()).select("id", "profile_key", "profile_id")


@query("extract_amount", "SELECT question_id, amount AS purchase_usd FROM questions")
def extract_amount(v: Views):
    return v.questions().select("question_id", money.first_amount(F.col("question")).alias("purchase_usd"))


@query("dedupe_transactions", """
    SELECT id, date, client_id, amount, merchant_id, l_partkey, l_suppkey, l_extendedprice, copies FROM first_tx""")
def dedupe_transactions(v: Views):
    columns = ["id", "date", "client_id", "amount", "merchant_id", *RAW_ORDER]
    return cleaning.dedupe_by_id(v.raw_tx().select(*columns), RAW_ORDER)


@query("mcc_enrich", """
    SELECT r.id, r.l_partkey, r.l_suppkey, r.code AS mcc_code, coalesce(m.mcc_description, 'UNKNOWN_MCC') AS mcc_description
    FROM (SELECT *, CASE WHEN mcc <> 'n1a.0' THEN replace(mcc, '.0', '') END AS code FROM raw_tx) r
    LEFT JOIN mcc_dim m ON r.code = m.mcc_code""")
def mcc_enrich(v: Views):
    rows = v.raw_tx().select("id", "l_partkey", "l_suppkey", text.normalize_mcc(F.col("mcc")).alias("mcc_code"))
    return cleaning.enrich_mcc(rows, v.mcc())


@query("join_cards", """
    SELECT t.id, t.card_id, CAST(c.c_custkey // 30 AS VARCHAR) AS client_id_card, c.c_mktsegment AS card_brand,
           CASE WHEN c.c_acctbal > 5000 THEN TRUE WHEN c.c_acctbal > 0 THEN FALSE END AS has_chip,
           CASE WHEN c.c_custkey IS NOT NULL THEN FALSE END AS card_on_dark_web, c.c_acctbal AS credit_limit_usd
    FROM tx t LEFT JOIN customer c ON t.card_id = CAST(c.c_custkey AS VARCHAR)""")
def join_cards(v: Views):
    return cleaning.join_cards(v.tx(place=False).select("id", "card_id"), cleaning.prepare_cards(v.raw_cards())).select(
        "id", "card_id", "client_id_card", "card_brand", "has_chip", "card_on_dark_web", dbl("credit_limit_usd"))


@query("join_users", """
    SELECT t.id, CAST(t.client_id AS VARCHAR) AS client_id, CAST(h.min_nation + 20 AS VARCHAR) AS current_age,
           CAST(h.n AS VARCHAR) AS num_credit_cards, CAST(l.monthly_limit AS DOUBLE) AS monthly_discretionary_limit_usd
    FROM tx t LEFT JOIN households h ON t.client_id = h.client_id LEFT JOIN limits l ON t.client_id = l.client_id""")
def join_users(v: Views):
    rows = v.tx(place=False).select("id", F.col("client_id").cast("string").alias("client_id"))
    return cleaning.join_users(rows, cleaning.prepare_users(v.raw_users())).select(
        "id", "client_id", "current_age", "num_credit_cards", dbl("monthly_discretionary_limit_usd"))


def _clean_inputs(v: Views):
    return dict(
        raw=v.raw_tx(), mcc=v.mcc(), cards=cleaning.prepare_cards(v.raw_cards()),
        users=cleaning.prepare_users(v.raw_users()), order_by=RAW_ORDER,
    )


@query("qa_report", """
    SELECT CAST(sum(copies) AS BIGINT) AS transactions_rows_total_scanned,
           CAST(sum(copies - 1) AS BIGINT) AS transactions_duplicates_dropped,
           count(*) FILTER (amount_usd IS NULL) AS rows_dropped_invalid_amount,
           count(*) FILTER (amount_usd IS NOT NULL AND transaction_dt IS NULL) AS rows_dropped_invalid_date,
           count(*) FILTER (amount_usd IS NULL) AS amount_parse_failures,
           count(*) FILTER (amount_usd IS NOT NULL AND transaction_dt IS NULL) AS date_parse_failures,
           count(*) FILTER (ok AND p.card_id IS NULL) AS card_join_misses,
           count(*) FILTER (ok AND l.monthly_limit IS NULL) AS user_join_misses,
           count(*) FILTER (ok AND m.mcc_code IS NULL) AS mcc_missing_from_lookup,
           count(*) FILTER (ok AND p.client_id = '1') AS focus_rows_written,
           count(*) FILTER (ok AND TRY_CAST(p.client_id AS DOUBLE) IS NULL) AS client_ids_not_numeric
    FROM (SELECT *, amount_usd IS NOT NULL AND transaction_dt IS NOT NULL AS ok FROM parsed_tx) p
    LEFT JOIN mcc_dim m ON p.mcc_code = m.mcc_code
    LEFT JOIN limits l ON p.client_id = CAST(l.client_id AS VARCHAR)""")
def qa_report(v: Views):
    return cleaning.qa_report(**_clean_inputs(v), focus_client_id="1")


def _dollars(sql: str) -> str:
    return f"'$' || CAST(CAST({sql} AS DECIMAL(18,2)) AS VARCHAR)"


@query("clean_transactions", f"""
    SELECT p.id, p.date, p.client_id, p.card_id, p.amount, p.transaction_dt, CAST(p.amount_usd AS DOUBLE) AS amount_usd,
           p.use_chip, p.merchant_id, p.merchant_city, p.merchant_state, p.zip, p.zip_norm, p.mcc, p.mcc_code,
           coalesce(m.mcc_description, 'UNKNOWN_MCC') AS mcc_description, p.is_online, p.errors,
           c.c_mktsegment AS card_brand, CAST(c.c_custkey // 30 AS VARCHAR) AS client_id_card,
           CASE WHEN c.c_custkey IS NOT NULL THEN 'Debit' END AS card_type, CASE WHEN c.c_custkey IS NOT NULL THEN '12/2022' END AS expires,
           CASE WHEN c.c_acctbal > 5000 THEN TRUE WHEN c.c_acctbal > 0 THEN FALSE END AS has_chip,
           CAST(c.c_nationkey AS VARCHAR) AS num_cards_issued, CASE WHEN c.c_custkey IS NOT NULL THEN '09/2002' END AS acct_open_date,
           CASE WHEN c.c_custkey IS NOT NULL THEN '2014' END AS year_pin_last_changed,
           CASE WHEN c.c_custkey IS NOT NULL THEN FALSE END AS card_on_dark_web, c.c_acctbal AS credit_limit_usd,
           CAST(h.min_nation + 20 AS VARCHAR) AS current_age, {_dollars('h.max_bal')} AS per_capita_income,
           {_dollars('h.max_bal * 2')} AS yearly_income, {_dollars('h.min_bal')} AS total_debt,
           CAST(h.max_nation + 600 AS VARCHAR) AS credit_score, CAST(h.n AS VARCHAR) AS num_credit_cards,
           CASE WHEN h.lead > 0 THEN {_dollars('h.lead * 100')} || ' ' END AS monthly_discretionary_limits,
           CAST(l.monthly_limit AS DOUBLE) AS monthly_discretionary_limit_usd
    FROM parsed_tx p
    LEFT JOIN mcc_dim m ON p.mcc_code = m.mcc_code
    LEFT JOIN customer c ON p.card_id = CAST(c.c_custkey AS VARCHAR)
    LEFT JOIN households h ON p.client_id = CAST(h.client_id AS VARCHAR)
    LEFT JOIN limits l ON p.client_id = CAST(l.client_id AS VARCHAR)
    WHERE p.amount_usd IS NOT NULL AND p.transaction_dt IS NOT NULL""")
def clean_transactions(v: Views):
    """All columns of the enriched table."""
    rows = cleaning.clean_transactions(**_clean_inputs(v))
    money_columns = ("amount_usd", "credit_limit_usd", "monthly_discretionary_limit_usd")
    return rows.select(*[dbl(c) if c in money_columns else c for c in rows.columns])


@query("client_ids", "SELECT client_id FROM households")
def client_ids(v: Views):
    return spend.client_ids(v.raw_users())


@query("session_valid", """
    SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL""")
def session_valid(v: Views):
    return coach.valid_turns(v.conversations()).select(F.col("client_id").alias("conv_id"), "turn", "role")


@query("session_tail", """
    SELECT client_id, turn, role, content FROM turns
    QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY turn DESC) <= 40""")
def session_tail(v: Views):
    return coach.session_tail(v.turns())
