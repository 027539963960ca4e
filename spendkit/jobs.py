"""The batch jobs: clean, train, and everything that is computed for an as-of date.

Each job reads stored tables and writes stored tables, so a job that is lost is run again from
what the one before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import budget, cleaning, coach, forecast, labeling, notify, recommend, rollup, spend
from .schemas import LABEL_CACHE
from .session import cut_lineage
from .sources import readers, writers


def clean(
    spark: SparkSession, transactions: str, users: str, cards: str, mcc: str, out: str,
    focus_client_id: str | None = None,
) -> None:
    """Raw files to `out`/enriched and `out`/qa_report.

    The text files are read once, into `out`/raw; the first row per id is found once, into `out`/staged.
    Both results come from these tables, the number of scanned rows from the file footers.
    """
    readers.read_transactions(spark, transactions).write.mode("overwrite").parquet(f"{out}/raw")
    raw = spark.read.parquet(f"{out}/raw")
    cleaning.staged(raw, readers.SOURCE_ORDER).write.mode("overwrite").parquet(f"{out}/staged")
    rows = spark.read.parquet(f"{out}/staged")
    dims = dict(
        mcc=readers.read_mcc(spark, mcc),
        cards=cleaning.prepare_cards(readers.read_cards(spark, cards)),
        users=cleaning.prepare_users(readers.read_users(spark, users)),
    )
    writers.write_enriched(cleaning.enrich(rows, **dims), f"{out}/enriched")
    writers.write_report(cleaning.qa_counters(rows, raw, **dims, focus_client_id=focus_client_id), f"{out}/qa_report")


def load(
    spark: SparkSession, enriched: str, labels: str | None = None, client_id: int | None = None,
    profile_labels: str | None = None,
) -> DataFrame:
    """Enriched transactions with their categories: labels where there are some, else the MCC rule.

    `labels` holds labels per transaction, `profile_labels` those per profile of `apply_labels`. The
    second is the cheaper one: it needs no shuffle of the transactions by id.
    """
    tx = readers.read_enriched(spark, enriched, client_id)
    if profile_labels is not None:
        stored = spark.read.parquet(profile_labels)
        return labeling.overlay_profile_labels(
            tx, stored.select(F.col("profile_id").alias("id"), F.col("category").alias("category_final"), "source")
        )
    if labels is None:
        return labeling.with_rule_category(tx)
    latest = labeling.latest_labels(readers.read_labels(spark, labels, client_id), readers.SOURCE_ORDER)
    return labeling.overlay_labels(tx, latest)


def request_labels(
    spark: SparkSession, enriched: str, out: str, cache: str | None = None, max_calls: int | None = None
) -> None:
    """Merchant profiles, the batches cut from them and the requests to send, as tables."""
    tx = readers.read_enriched(spark, enriched)
    labeling.merchant_profiles(tx).write.mode("overwrite").parquet(f"{out}/merchant_profiles")
    rows = labeling.label_rows(spark.read.parquet(f"{out}/merchant_profiles"))
    batches = labeling.label_batches(labeling.cache_lookup(rows, _cache(spark, cache)), max_calls=max_calls)
    batches.write.mode("overwrite").parquet(f"{out}/label_batches")
    requests = labeling.label_requests(spark.read.parquet(f"{out}/label_batches"))
    requests.write.mode("overwrite").parquet(f"{out}/label_requests")


def apply_labels(
    spark: SparkSession, enriched: str, out: str, responses: DataFrame, next_cache: str,
    cache: str | None = None, model: str | None = None,
) -> None:
    """Answers to labels per transaction, the next cache (a new folder) and the reports."""
    batches = spark.read.parquet(f"{out}/label_batches")
    resolved = cut_lineage(labeling.resolve_labels(batches, labeling.parse_responses(responses)))
    labeling.next_cache(_cache(spark, cache), resolved).write.mode("overwrite").parquet(next_cache)
    tx = readers.read_enriched(spark, enriched)
    labels = labeling.transaction_labels(tx, resolved, model).where("category is not null")
    writers.write_json(labels, f"{out}/transaction_categories")
    by_profile = labeling.profile_labels(spark.read.parquet(f"{out}/merchant_profiles"), resolved)
    writers.assert_no_pii(by_profile).write.mode("overwrite").parquet(f"{out}/profile_labels")
    report = labeling.labelling_report(by_profile)
    counters = labeling.run_counters(batches, resolved).first().asDict()
    report = report.select("*", *[F.lit(v).alias(k) for k, v in counters.items()])
    writers.write_report(report, f"{out}/categorization_report")
    writers.write_json(labeling.category_mix(by_profile), f"{out}/category_mix")
    writers.write_json(labeling.label_source_mix(by_profile), f"{out}/label_source_mix")


def _cache(spark: SparkSession, path: str | None) -> DataFrame:
    return spark.read.parquet(path) if path else spark.createDataFrame([], LABEL_CACHE)


def train(spark: SparkSession, enriched: str, users: str, out: str, cutoff: date | str | None = None) -> forecast.MonthEndModel:
    """Fit the month-end model on all clients and store its weights and metrics."""
    limits = budget.user_limits(readers.read_users(spark, users))
    daily = forecast.daily_discretionary(readers.read_enriched(spark, enriched))
    return _trained(spark, daily, limits, out, cutoff)


def _trained(spark: SparkSession, daily: DataFrame, limits: DataFrame, out: str, cutoff: date | str | None) -> forecast.MonthEndModel:
    model = forecast.fit_month_end_model(cut_lineage(forecast.training_samples(daily, limits)), cutoff)
    writers.write_model(model, f"{out}/model", limits)
    metrics = spark.range(1).select(*[F.lit(v).alias(k) for k, v in model.metrics.items()])
    writers.write_report(metrics, f"{out}/model_metrics")
    return model


def load_model(spark: SparkSession, out: str) -> forecast.MonthEndModel:
    metrics = spark.read.json(f"{out}/model_metrics").first().asDict()
    return forecast.MonthEndModel.from_frame(readers.read_model(spark, f"{out}/model"), metrics)


def analytics(tx: DataFrame, limits: DataFrame, as_of: date | str, out: str) -> None:
    """One table per metric for one as-of date."""
    by_category = spend.spend_by_category(tx)
    writers.write_metrics(
        {
            "spend_by_category": spend.category_breakdown(by_category),
            "spend_by_mcc": spend.spend_by_mcc(tx),
            "spending_patterns": spend.spending_patterns(tx),
            "budget_utilization": budget.budget_records(
                budget.budget_utilization(tx, limits, as_of), spend.category_source_mix(tx)
            ),
        },
        out,
        str(as_of),
    )


def store_partials(tx: DataFrame, out: str, load: str) -> None:
    """The rollups of one load of categorised transactions; storing a load again replaces only that load."""
    for name, table in (("daily_partials", rollup.daily_partials(tx)), ("merchant_partials", rollup.merchant_partials(tx))):
        (
            writers.assert_no_pii(table).withColumn("load", F.lit(load)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(f"{out}/{name}")
        )


def load_partials(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(days, merchant days) of all stored loads, merged."""
    return tuple(rollup.merged(spark.read.parquet(f"{out}/{name}")) for name in ("daily_partials", "merchant_partials"))


def train_on_partials(spark: SparkSession, out: str, limits: DataFrame, cutoff: date | str | None = None) -> forecast.MonthEndModel:
    """`train` without reading transactions."""
    days, _ = load_partials(spark, out)
    return _trained(spark, rollup.discretionary_days(days, "rule_category"), limits, out, cutoff)


Keep = Callable[[str, DataFrame], DataFrame]


def alerts(
    tx: DataFrame,
    limits: DataFrame,
    as_of: date | str,
    model: forecast.MonthEndModel,
    feedback: DataFrame | None = None,
    keep: Keep = lambda name, table: table,
    feedback_order: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Budget, forecast, recommendations, events and coach context for one as-of date.

    The rollup of the recommendations and their items are stored at once, which runs jobs; the rest is lazy unless `keep`
    stores a table and hands back what it stored. `feedback` is as in `recommend.recommendations`.
    """
    days = cut_lineage(rollup.daily_partials(forecast.until(tx, as_of)))
    merchants = cut_lineage(recommend.spending_rollup(tx, as_of))
    return _alerts(days, merchants, limits, as_of, model, feedback, keep, feedback_order)


def alerts_on_partials(
    spark: SparkSession, out: str, limits: DataFrame, as_of: date | str, model: forecast.MonthEndModel,
    feedback: DataFrame | None = None, keep: Keep = lambda name, table: table, feedback_order: list[str] | None = None,
) -> dict[str, DataFrame]:
    """`alerts` without reading transactions: after a load only its partials are new."""
    days, merchants = load_partials(spark, out)
    merchants = cut_lineage(recommend.rollup_of_days(merchants, as_of))
    return _alerts(cut_lineage(days), merchants, limits, as_of, model, feedback, keep, feedback_order)


def _alerts(
    days: DataFrame, merchants: DataFrame, limits: DataFrame, as_of: date | str, model: forecast.MonthEndModel,
    feedback: DataFrame | None, keep: Keep, feedback_order: list[str] | None,
) -> dict[str, DataFrame]:
    spent = keep("budget", rollup.budget_days(days, limits, as_of, as_of))
    runway = keep("runway", forecast.score_daily(rollup.discretionary_days(days), limits, as_of, model))
    advice = keep("recommendations", recommend.choose_open(recommend.items_of(merchants), feedback, order_by=feedback_order))
    scored = runway.where("status = 'scored'")
    inputs = notify.notification_inputs(spent, scored)
    return {
        "budget": spent,
        "runway": runway,
        "recommendations": advice,
        "events": keep("events", notify.notifications(inputs, advice)),
        "coach_context": keep("coach_context", coach.coach_context(spent, scored)),
    }


def _keeper(spark: SparkSession, as_of: date | str, out: str) -> Keep:
    def keep(name: str, table: DataFrame) -> DataFrame:
        writers.write_metrics({name: table}, out, str(as_of))
        return spark.read.schema(table.schema).parquet(f"{out}/{name}/run_date={as_of}")

    return keep


def store_alerts(
    tx: DataFrame, limits: DataFrame, as_of: date | str, model: forecast.MonthEndModel, out: str,
    feedback: DataFrame | None = None, feedback_order: list[str] | None = None,
) -> dict[str, DataFrame]:
    """`alerts`, each table written once and read back by the steps after it."""
    return alerts(tx, limits, as_of, model, feedback, _keeper(tx.sparkSession, as_of, out), feedback_order)


def refresh_alerts(
    spark: SparkSession, partials: str, limits: DataFrame, as_of: date | str, model: forecast.MonthEndModel, out: str,
    feedback: DataFrame | None = None, feedback_order: list[str] | None = None,
) -> dict[str, DataFrame]:
    """`store_alerts` from the stored partials, after `store_partials` of what a load brought."""
    return alerts_on_partials(spark, partials, limits, as_of, model, feedback, _keeper(spark, as_of, out), feedback_order)
