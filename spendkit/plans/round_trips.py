"""Queries that write a table through its sink and read it through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import budget, cleaning, coach, forecast, labeling, spend
from ..schemas import RAW_TRANSACTIONS
from ..session import cut_lineage, shared_folder
from ..sources import bucketed, changes, readers, writers
from .advice import _ALL_EVENTS, _events
from .cleaning import _clean_inputs
from .labels import TX_COLUMNS, Run
from .registry import CHECKS, big, dbl, query
from .spending import _runway, _runway_columns, _samples, RIDGE_CHECKS
from .views import AS_OF, Views, with_views

CLIENT = 1


def _folder(v: Views, name: str) -> str:
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def _as_csv(v: Views, rows: DataFrame, name: str) -> str:
    """Raw text files as they come: a header each, blanks kept."""
    path = _folder(v, name)
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


_RAW = RAW_TRANSACTIONS.fieldNames()


@query("scan_transactions", f"SELECT {', '.join(_RAW)} FROM raw_tx")
def scan_transactions(v: Views):
    return readers.read_transactions(v.spark, _as_csv(v, v.raw_tx().select(*_RAW), "tx")).select(*_RAW)


@query("scan_users", "SELECT client_id, CAST(monthly_limit AS DOUBLE) AS limit_usd FROM limits")
def scan_users(v: Views):
    users = readers.read_users(v.spark, _as_csv(v, v.raw_users(), "users"))
    return budget.user_limits(users).select("client_id", dbl(budget.LIMIT, "limit_usd"))


@query("scan_cards", """
    SELECT CAST(c_custkey AS VARCHAR) AS card_id, CAST(c_custkey // 30 AS VARCHAR) AS client_id_card, c_mktsegment AS card_brand,
           CASE WHEN c_acctbal > 5000 THEN TRUE WHEN c_acctbal > 0 THEN FALSE END AS has_chip,
           CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS credit_limit_usd FROM customer""")
def scan_cards(v: Views):
    cards = cleaning.prepare_cards(readers.read_cards(v.spark, _as_csv(v, v.raw_cards(), "cards")))
    return cards.select("card_id", "client_id_card", "card_brand", "has_chip", dbl("credit_limit_usd"))


@query("scan_mcc", "SELECT mcc_code, mcc_description FROM mcc_dim")
def scan_mcc(v: Views):
    path, entries = _folder(v, "mcc"), F.collect_list(F.struct("mcc_code", "mcc_description"))
    v.mcc().agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(path)
    return readers.read_mcc(v.spark, path)


def _enriched(v: Views, fmt: str = "parquet") -> str:
    path = _folder(v, "enriched")
    writers.write_enriched(cleaning.clean_transactions(**_clean_inputs(v)), path, fmt)
    return path


_MONEY = ("amount_usd", "credit_limit_usd", "monthly_discretionary_limit_usd")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast("string").alias(c) if c == "client_id" else dbl(c) if c in _MONEY else c for c in rows.columns if c != "tx_month"])


@query("sink_enriched")
def sink_enriched(v: Views):
    """The enriched table by month; reading gives client ids as numbers."""
    return _plain(readers.read_enriched(v.spark, _enriched(v)))


@query("sink_client")
def sink_client(v: Views):
    path = _folder(v, "client")
    writers.write_client(cleaning.clean_transactions(**_clean_inputs(v)), CLIENT, path)
    return _plain(readers.read_enriched(v.spark, path, CLIENT, "json"))


@query("sink_metrics", "SELECT client_id, category, CAST(sum(spend) AS DOUBLE) AS spend_usd, '2000-06-15' AS run_date FROM ctx GROUP BY 1, 2")
def sink_metrics(v: Views):
    """A metric of one as-of date, written twice: the date is replaced."""
    path, table = _folder(v, "metrics"), spend.spend_by_category(v.categorised())
    for part in (table.limit(0), table):
        writers.write_metrics({"spend_by_category": part}, path, AS_OF)
    read = v.spark.read.parquet(f"{path}/spend_by_category")
    return read.select("client_id", "category", dbl("spend_usd"), F.col("run_date").cast("string").alias("run_date"))


@query("sink_labels", """
    SELECT id, category, source, confidence, category_llm, model, profile_id, transaction_dt FROM labelled WHERE category IS NOT NULL""")
def sink_labels(v: Views):
    path = _folder(v, "labels")
    writers.write_json(Run(v, *TX_COLUMNS).labelled().where("category is not null"), path, compression="gzip")
    return readers.read_labels(v.spark, path).select(
        "id", "category", "source", "confidence", "category_llm", "model", "profile_id", "transaction_dt")


@query("sink_runway")
def sink_runway(v: Views):
    daily = cut_lineage(forecast.daily_discretionary(v.categorised()))
    samples = cut_lineage(forecast.training_samples(daily, v.limits()))
    model, path = forecast.fit_month_end_model(samples), _folder(v, "runway")
    writers.write_runway(forecast.score_daily(daily, v.limits(), AS_OF, model), model, path)
    read = v.spark.read.json(path).withColumns({"as_of_date": F.to_date("as_of_date"), "status": F.lit("scored")})
    return _runway_columns(read)


@query("sink_events", f"""
    SELECT event_id, client_id, '2000-06-15' AS as_of_date, kind, severity, title, threshold_pct FROM ({_ALL_EVENTS})""")
def sink_events(v: Views):
    path = _folder(v, "events")
    writers.write_events(_events(v), path)
    return readers.read_events(v.spark, path).select("event_id", "client_id", "as_of_date", "kind", "severity", "title", "threshold_pct")


@query("sink_sessions", """
    SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY turn) - 1 AS place, role, content FROM (
      SELECT * FROM turns WHERE role IN ('user', 'assistant') AND content IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY turn DESC) <= 40)""")
def sink_sessions(v: Views):
    path = _folder(v, "sessions")
    writers.write_sessions(v.turns(), path)
    schema = "client_id long, messages array<struct<role:string,content:string>>"
    packed = v.spark.read.schema(schema).json(path).select("client_id", F.posexplode("messages").alias("place", "m"))
    return packed.select("client_id", big("place"), "m.role", "m.content")


@query("sink_report")
def sink_report(v: Views):
    path = _folder(v, "report")
    report = cleaning.qa_report(**_clean_inputs(v), focus_client_id=str(CLIENT))
    writers.write_report(report, path)
    return v.spark.read.schema(report.select(*sorted(report.columns)).schema).json(path)


@query("model_store")
def model_store(v: Views):
    """The model from its stored form."""
    path = _folder(v, "model")
    fitted = forecast.ridge_of_moments(cut_lineage(forecast.day_moments(_samples(v))))
    writers.write_model(fitted, path, v.limits())
    model = forecast.MonthEndModel.from_frame(readers.read_model(v.spark, path))
    return model.to_frame(v.spark).select(
        big("position"), "feature", dbl("mean", digits=4), dbl("scale", digits=4), dbl("weight", digits=3))


@query("focus_sample")
def focus_sample(v: Views):
    """The first five rows of a client, which the report shows."""
    rows = cleaning.focus_sample(cleaning.clean_transactions(**_clean_inputs(v)), str(CLIENT))
    return rows.select("id", "client_id", "transaction_dt", dbl("amount_usd"))


@query("change_log", """
    SELECT client_id, CAST(lim AS DOUBLE) AS limit_usd FROM (
      SELECT c_custkey // 30 AS client_id, c_custkey,
             CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(abs(c_acctbal) * 50 AS DECIMAL(18,2)) END AS lim
      FROM customer WHERE c_mktsegment <> 'MACHINERY'
      QUALIFY row_number() OVER (PARTITION BY c_custkey // 30 ORDER BY c_custkey DESC) = 1)
    WHERE lim IS NOT NULL""")
def change_log(v: Views):
    """Limit changes appended in three parts, compacted after the first and the second: the same overrides."""
    day = F.make_dt_interval(F.col("seq"), F.lit(0), F.lit(0), F.lit(0))
    rows = v.limit_changes().withColumn("updated_at", F.lit("2000-01-01").cast("timestamp_ntz") + day)
    log = changes.limit_log(v.spark, _folder(v, "limits"))
    for part in range(3):
        log.append(rows.where(F.col("seq") % 3 == part).drop("seq"))
        if part < 2:
            log.compact()
    return budget.latest_limit_overrides(log.read(), ["updated_at"]).select("client_id", dbl("limit_usd"))


@query("overlay_by_bucket")
def overlay_by_bucket(v: Views):
    """Labels laid over transactions, both stored by buckets of the transaction id."""
    name, parts = f"t{uuid.uuid4().hex}", bucketed.buckets_for(v.table("lineitem").count(), least=8)
    path = _folder(v, "tx-by-id")
    tx = bucketed.write_bucketed(v.tx(place=False, whole=True), f"{name}_tx", path, "id", parts)
    # Read as files, the stored transactions give the labels without a second join; the labels are dealt to buckets as any table is.
    labels = bucketed.write_bucketed(v.labels(v.spark.read.parquet(path)), f"{name}_labels", _folder(v, "labels-by-id"), "id", parts)
    return labeling.overlay_labels(tx, labeling.latest_labels(labels, ["seq"])).select("id", "category", "category_source", "is_discretionary")


_CLEAN = CHECKS["clean_transactions"]
_AS_READ = _CLEAN.replace("SELECT p.id,", "SELECT CAST(CAST(TRY_CAST(p.client_id AS DOUBLE) AS BIGINT) AS VARCHAR) AS client_id, p.id,", 1).replace("p.date, p.client_id,", "p.date,", 1)
CHECKS.update({
    "sink_enriched": f"SELECT * FROM ({_AS_READ}) WHERE client_id IS NOT NULL",
    "sink_client": f"SELECT * FROM ({_AS_READ}) WHERE client_id = '{CLIENT}'",
    "overlay_by_bucket": CHECKS["category_overlay"],
    "sink_report": CHECKS["qa_report"],
    "focus_sample": f"SELECT id, client_id, transaction_dt, amount_usd FROM ({_CLEAN}) WHERE client_id = '{CLIENT}' ORDER BY transaction_dt, id LIMIT 5",
    "model_store": RIDGE_CHECKS["ridge_fit"],
    "sink_runway": f"SELECT * FROM ({RIDGE_CHECKS['runway']}) WHERE status = 'scored'",
})
