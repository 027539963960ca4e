"""Queries over labelling."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..constants import PROFILE_FIELDS
from ..operators import labeling
from ..session import cut_lineage, stored
from .registry import big, dbl, query
from .views import Views

#: What labelled transactions show of a transaction besides its profile.
TX_COLUMNS = ("id", "client_id", "transaction_dt")


class Run:
    """One labelling run over the views, step by step; a step does nothing until a query asks for it.

    Transactions and profiles are stored once, as a real run does: the tables are joined once for all steps, and those
    after the profiles read them and not the transactions. Besides what profiles need, the columns `more` are kept.
    """

    def __init__(self, v: Views, *more: str):
        self.v, self.more = v, more

    @cached_property
    def tx(self):
        return stored(self.v.tx().select(*PROFILE_FIELDS, "amount_usd", *self.more), "transactions")

    @cached_property
    def profiles(self):
        return cut_lineage(labeling.merchant_profiles(self.tx))

    @cached_property
    def rows(self):
        return labeling.label_rows(self.profiles)

    @cached_property
    def cache(self):
        return self.v.label_cache(self.rows)

    @cached_property
    def looked_up(self):
        return labeling.cache_lookup(self.rows, self.cache)

    @cached_property
    def batches(self):
        return labeling.label_batches(self.looked_up)

    @cached_property
    def answers(self):
        return labeling.parse_responses(self.v.responses(self.batches))

    @cached_property
    def resolved(self):
        return labeling.resolve_labels(self.batches, self.answers)

    def by_profile(self):
        return labeling.profile_labels(self.profiles, self.resolved)

    def labelled(self):
        return labeling.transaction_labels(self.tx, self.resolved, model="stand-in")


@query("merchant_profiles", """
    SELECT profile_id, profile_key, txn_count, median_amount_usd, mcc_code, merchant_id, merchant_city, is_online FROM profiles""")
def merchant_profiles(v: Views):
    return labeling.merchant_profiles(v.tx()).select(
        "profile_id", "profile_key", "txn_count", dbl("median_amount_usd"), "mcc_code", "merchant_id", "merchant_city", "is_online")


@query("label_cache_hits", "SELECT profile_id AS id, cache_key, is_hit FROM looked_up")
def label_cache_hits(v: Views):
    return Run(v).looked_up.select("id", "cache_key", "is_hit")


@query("label_batches", "SELECT profile_id AS id, batch_no, is_hit, is_sent FROM batches")
def label_batches(v: Views):
    return Run(v).batches.select("id", "batch_no", "is_hit", "is_sent")


@query("label_requests", """
    SELECT batch_no, count(*) AS n_transactions, min(profile_id) AS first_id, max(profile_id) AS last_id
    FROM batches WHERE is_sent GROUP BY 1""")
def label_requests(v: Views):
    sent = F.from_json("payload", "transactions array<struct<id:string>>")["transactions"]["id"]
    return labeling.label_requests(Run(v).batches).select(
        "batch_no", big("n_transactions"), F.array_min(sent).alias("first_id"), F.array_max(sent).alias("last_id"))


@query("label_responses", """
    SELECT batch_no, batch_no <> 2 AS answered, CASE WHEN batch_no <> 2 THEN profile_id END AS id,
           CASE WHEN batch_no <> 2 THEN given END AS category, CASE WHEN batch_no <> 2 THEN said END AS confidence
    FROM resolved WHERE is_sent AND batch_no <> 2 AND given IS NOT NULL
    UNION ALL
    SELECT DISTINCT batch_no, FALSE, NULL, NULL, NULL FROM resolved WHERE is_sent AND batch_no = 2""")
def label_responses(v: Views):
    return Run(v).answers.select("batch_no", "answered", "id", "category", "confidence")


@query("resolve_labels", """
    SELECT profile_id AS id, batch_no, category_final, source, confidence, category_llm, degraded FROM resolved""")
def resolve_labels(v: Views):
    return Run(v).resolved.select("id", "batch_no", "category_final", "source", "confidence", "category_llm", "degraded")


@query("label_cache_next", """
    SELECT cache_key, category_final, source, confidence, category_llm FROM (
      SELECT *, bool_or(degraded) OVER (PARTITION BY batch_no) AND source = 'mcc_fallback' AS evict FROM resolved)
    WHERE NOT evict""")
def label_cache_next(v: Views):
    run = Run(v)
    return labeling.next_cache(run.cache, run.resolved).select("cache_key", "category_final", "source", "confidence", "category_llm")


@query("transaction_labels", """
    SELECT id, client_id, category, source, confidence, category_llm, model, profile_id FROM labelled""")
def transaction_labels(v: Views):
    return Run(v, *TX_COLUMNS).labelled().select("id", "client_id", "category", "source", "confidence", "category_llm", "model", "profile_id")


@query("category_overlay", "SELECT id, category, category_source, is_discretionary FROM otx")
def category_overlay(v: Views):
    labels = labeling.latest_labels(v.labels(), ["seq"])
    return labeling.overlay_labels(v.tx(place=False), labels).select("id", "category", "category_source", "is_discretionary")


@query("category_overlay_by_profile", """
    SELECT id, category, source AS category_source,
           category IN ('Dining', 'Entertainment', 'Shopping', 'Travel', 'Subscriptions') AS is_discretionary FROM labelled""")
def category_overlay_by_profile(v: Views):
    run = Run(v, "id")
    return labeling.overlay_profile_labels(run.tx, run.resolved).select("id", "category", "category_source", "is_discretionary")


@query("categorization_report", """
    SELECT count(*) AS transactions_scanned, count(category) AS transactions_categorized,
           count(*) - count(category) AS transactions_unmapped,
           round(100.0 * count(category) / count(*), 4) AS coverage_pct, count(DISTINCT profile_id) AS distinct_profiles,
           round(CAST(count(*) AS DOUBLE) / count(DISTINCT profile_id), 2) AS transactions_per_profile,
           round(100.0 * count(*) FILTER (category_llm = rule AND rule <> 'Other/Uncategorized')
             / nullif(count(*) FILTER (category_llm IS NOT NULL AND rule <> 'Other/Uncategorized'), 0), 2) AS mcc_agreement_pct,
           count(*) FILTER (category_llm IS NOT NULL AND rule <> 'Other/Uncategorized') AS mcc_agreement_sample
    FROM labelled""")
def categorization_report(v: Views):
    return labeling.labelling_report(Run(v).by_profile())


@query("labelling_counters", """
    SELECT count(*) FILTER (called) AS calls_made, count(*) FILTER (called AND bad) AS call_failures,
           count(*) FILTER (bad) AS degraded_batches, count(*) FILTER (bad) > 0 AS degraded_run
    FROM (SELECT batch_no, bool_or(is_sent) AS called, bool_or(degraded) AS bad FROM resolved GROUP BY 1)""")
def labelling_counters(v: Views):
    run = Run(v)
    return labeling.run_counters(run.batches, run.resolved)


@query("category_mix", """
    SELECT category, count(*) AS transactions, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share_pct
    FROM labelled GROUP BY 1""")
def category_mix(v: Views):
    return labeling.category_mix(Run(v).by_profile())


@query("label_source_mix", """
    SELECT source, count(*) AS transactions, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share_pct
    FROM labelled GROUP BY 1""")
def label_source_mix(v: Views):
    return labeling.label_source_mix(Run(v).by_profile())


@query("distinct_merchants", """
    SELECT client_id, id, merchant_rank FROM (
      SELECT client_id, id, row_number() OVER (PARTITION BY client_id ORDER BY transaction_dt, id) AS merchant_rank FROM (
        SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY client_id, merchant_id, merchant_city, merchant_state,
          mcc_code, mcc_description, use_chip, errors ORDER BY transaction_dt, id) = 1))
    WHERE merchant_rank <= 20""")
def distinct_merchants(v: Views):
    return labeling.distinct_merchants(v.tx()).select("client_id", "id", big("merchant_rank"))
