"""Month-end spend forecast: daily rollup, features, ridge regression, runway."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import FEATURES, MIN_SPLIT_ROWS, RIDGE_ALPHA, TARGET, TRAIN_QUANTILE
from ..functions.calendar import days_in_month, days_remaining, month_label, next_midnight
from ..functions.category import is_discretionary, mcc_category
from ..functions.money import ratio
from ..schemas import MODEL
from ..session import cut_lineage
from .budget import LIMIT
from .common import AsOf, best_rows, day_literal, require_columns, with_as_of
from .spend import dated_spend

MTD = "mtd_discretionary_spend_usd"
DAILY = "discretionary_spend_usd"
EPOCH = date(1970, 1, 1)


def daily_discretionary(tx: DataFrame, category: str | None = None) -> DataFrame:
    """Discretionary spend per client and day.

    By default the MCC rule decides what counts. Pass `category` to use a column that carries
    labels. Every later step works on this rollup, at most one row per client and day.
    """
    require_columns(tx, ["client_id", "transaction_dt", "amount_usd"])
    if category is None:
        require_columns(tx, ["mcc_code", "mcc_description"])
        kind = mcc_category(F.col("mcc_code"), F.col("mcc_description"))
    else:
        kind = F.col(category)
    rows = dated_spend(tx).where(is_discretionary(kind) & F.col("client_id").isNotNull())
    return rows.groupBy("client_id", F.to_date("transaction_dt").alias("day")).agg(
        F.sum("spend_usd").alias(DAILY)
    )


def month_samples(daily: DataFrame) -> DataFrame:
    """Month total, running total and means of the last 7 and 30 rows inside the month.

    A window partition is one client's month, so it never exceeds 31 rows.
    """
    require_columns(daily, ["client_id", "day", DAILY])
    clipped = daily.withColumn(DAILY, F.greatest(F.coalesce(F.col(DAILY), F.lit(0)), F.lit(0)))
    dated = clipped.where(F.col("client_id").isNotNull() & F.col("day").isNotNull()).withColumn(
        "ym", month_label(F.col("day"))
    )
    month = Window.partitionBy("client_id", "ym")
    run = month.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)

    def mean_of_last(n: int) -> Column:
        last = month.orderBy("day").rowsBetween(1 - n, 0)
        return F.sum(DAILY).over(last).cast("double") / F.count(DAILY).over(last)

    return dated.withColumns(
        {
            TARGET: F.sum(DAILY).over(month),
            MTD: F.sum(DAILY).over(run),
            "avg_daily_discretionary_spend_7d": mean_of_last(7),
            "avg_daily_discretionary_spend_30d": mean_of_last(30),
        }
    )


def training_samples(daily: DataFrame, limits: DataFrame) -> DataFrame:
    """Keys, target and the features. Clients without a positive limit are dropped.

    They are dropped before the windows. A join that shuffles by client also serves the windows and
    the latest row per client, so nothing is shuffled again.
    """
    usable = limits.select("client_id", LIMIT).where(F.col(LIMIT) > 0)
    day = F.col("day")
    rows = month_samples(daily.join(usable, "client_id")).withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "day_of_month": F.day(day),
            "days_in_month": days_in_month(day),
            "days_remaining_in_month": days_remaining(day),
            "mtd_utilization_pct": ratio(F.col(MTD), F.col(LIMIT)),
            "avg7d_utilization_pct": ratio(F.col("avg_daily_discretionary_spend_7d"), F.col(LIMIT)),
        }
    )
    return rows.select("client_id", "day", "ym", TARGET, *FEATURES)


def time_split(samples: DataFrame, cutoff: date | str | None = None) -> DataFrame:
    """Cutoff (days since 1970, may be fractional) and row counts of both sides, one row.

    Days are counted first; the quantile then weighs one row per calendar day.
    """
    return split_of(samples.groupBy(F.unix_date("day").alias("d")).agg(F.count("*").alias("n")), cutoff)


def split_of(per_day: DataFrame, cutoff: date | str | None = None) -> DataFrame:
    """`time_split` of the samples per day (d, n)."""
    edge = (
        F.percentile("d", F.lit(TRAIN_QUANTILE), F.col("n"))
        if cutoff is None
        else F.max(F.unix_date(day_literal(cutoff))).cast("double")
    )
    # One entry per calendar day.
    days = F.collect_list(F.struct("d", "n"))
    before = F.filter("days", lambda x: x.d <= F.col("cutoff"))
    return per_day.agg(edge.alias("cutoff"), F.sum("n").alias("n_samples"), days.alias("days")).select(
        "cutoff",
        "n_samples",
        F.aggregate(before, F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x.n).alias("n_train"),
    ).withColumn("n_test", F.col("n_samples") - F.col("n_train"))


@dataclass(frozen=True)
class MonthEndModel:
    """A fitted model: eleven means, scales and weights. Prediction is a Column expression."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    intercept: float
    metrics: dict = field(default_factory=dict)

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for name, mean, scale, weight in zip(self.features, self.mean, self.scale, self.weight):
            out = out + (F.col(name).cast("double") - F.lit(mean)) / F.lit(scale) * F.lit(weight)
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per feature, the intercept first; this is the stored form."""
        rows = [(0, "(intercept)", 0.0, 1.0, self.intercept)]
        rows += [
            (i, *row)
            for i, row in enumerate(zip(self.features, self.mean, self.scale, self.weight), start=1)
        ]
        return spark.createDataFrame(rows, MODEL)

    @classmethod
    def from_frame(cls, frame: DataFrame, metrics: dict | None = None) -> MonthEndModel:
        """Read the stored form, one row per feature."""
        rows = sorted(frame.select(*MODEL.fieldNames()).collect())
        if not rows or rows[0].feature != "(intercept)":
            raise ValueError("Invalid model table: no intercept row")
        body = rows[1:]
        return cls(
            features=tuple(r.feature for r in body),
            mean=tuple(r["mean"] for r in body),
            scale=tuple(r["scale"] for r in body),
            weight=tuple(r.weight for r in body),
            intercept=rows[0].weight,
            metrics=metrics or {},
        )


#: Near the middle of features that lie far from zero; products of what is left lose no digits.
_MIDDLE = {"year": 2000, "month": 6, "day_of_month": 15, "days_in_month": 30, "days_remaining_in_month": 15}


def day_moments(samples: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Per day the number of samples and the sums of all products of two of one, the features and the target.

    All that a ridge regression needs. Sums of days add up, so a day that is computed again replaces its row and the
    model of any cutoff comes from this table, one row per calendar day, without the samples.
    """
    require_columns(samples, ["day", TARGET, *features])
    x = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(float(_MIDDLE.get(c, 0))) for c in features], F.col(TARGET).cast("double")]
    sums = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return samples.groupBy("day").agg(F.count("*").alias("n"), F.array(*sums).alias("moments"))


def ridge_of_moments(
    moments: DataFrame, cutoff: date | str | None = None, alpha: float = RIDGE_ALPHA, features: tuple[str, ...] = FEATURES,
) -> MonthEndModel:
    """Ridge on standardised features from `day_moments`, with a split by time; its errors are not measured.

    Minimises |y - Xw|^2 + alpha |w|^2 with a free intercept, on features scaled by their population deviation. What
    reaches the driver is one row of sums; the equations have as many unknowns as there are features.
    """
    split = split_of(moments.select(F.unix_date("day").alias("d"), "n"), cutoff).first()
    if not split.n_samples or split.n_train < MIN_SPLIT_ROWS or split.n_test < MIN_SPLIT_ROWS:
        raise ValueError(f"Not enough samples for a time split: need {MIN_SPLIT_ROWS} on each side")
    size = len(features) + 2
    places = [(i, j) for i in range(size) for j in range(i, size)]
    train = moments.where(F.unix_date("day") <= F.lit(split.cutoff))
    sums = train.agg(*[F.sum(F.get("moments", F.lit(k))).alias(f"m{k}") for k in range(len(places))]).first()
    product = np.zeros((size, size))
    for (i, j), value in zip(places, sums):
        product[i, j] = product[j, i] = value
    n = product[0, 0]
    mean = product[0] / n
    spread = product / n - np.outer(mean, mean)
    variance = np.diag(spread)[1:-1]
    # A constant feature keeps scale 1.
    known = variance > 1e-13 * np.maximum(np.diag(product)[1:-1] / n, 1e-300)
    scale = np.where(known, np.sqrt(np.maximum(variance, 0)), 1.0)
    gram = n * spread[1:-1, 1:-1] / np.outer(scale, scale)
    weight = np.linalg.solve(gram + alpha * np.eye(len(features)), n * spread[1:-1, -1] / scale)
    return MonthEndModel(
        features=tuple(features), mean=tuple(float(m) + _MIDDLE.get(c, 0) for c, m in zip(features, mean[1:-1])),
        scale=tuple(map(float, scale)), weight=tuple(map(float, weight)), intercept=float(mean[-1]),
        metrics=dict(
            cutoff_day=str(EPOCH + timedelta(days=int(split.cutoff))), cutoff=float(split.cutoff),
            n_samples=split.n_samples, n_train=split.n_train, n_test=split.n_test,
        ),
    )


def measure(model: MonthEndModel, samples: DataFrame) -> MonthEndModel:
    """The model with its mean errors on both sides of its cutoff: one pass over the samples."""
    is_train = F.unix_date("day") <= F.lit(model.metrics.pop("cutoff"))
    error = F.abs(F.col(TARGET).cast("double") - model.predict())
    mae = samples.agg(
        F.avg(F.when(is_train, error)).alias("train"), F.avg(F.when(~is_train, error)).alias("test")
    ).first()
    model.metrics.update(mae_train_usd=mae.train, mae_test_usd=mae.test)
    return model


def fit_month_end_model(
    samples: DataFrame,
    cutoff: date | str | None = None,
    alpha: float = RIDGE_ALPHA,
    features: tuple[str, ...] = FEATURES,
) -> MonthEndModel:
    """`ridge_of_moments` and its errors: one pass over the samples for the sums and one for the errors.

    Runs jobs. The samples are not stored; store them first if they are dear.
    """
    moments = cut_lineage(day_moments(samples, features))
    return measure(ridge_of_moments(moments, cutoff, alpha, features), samples)


def feature_row_as_of(samples: DataFrame, as_of: AsOf) -> DataFrame:
    """The latest sample of every client on or before its as-of day."""
    rows = with_as_of(samples, as_of).where(F.col("day") <= F.col("as_of"))
    return best_rows(rows, ["client_id"], [F.col("day").desc()])


def predict_month_end(rows: DataFrame, model: MonthEndModel) -> DataFrame:
    return rows.withColumn("predicted_month_end_discretionary_spend_usd", model.predict())


def overspend_signals(rows: DataFrame) -> DataFrame:
    """Overspend flag, remaining budget, days to limit, projected utilization.

    Needs the prediction, the month-to-date spend, the limit, `as_of` and `days_in_month`.
    """
    predicted = F.col("predicted_month_end_discretionary_spend_usd").cast("double")
    spent, limit = F.col(MTD).cast("double"), F.col(LIMIT).cast("double")
    left = limit - spent
    days_left = F.greatest(F.col("days_in_month") - F.day("as_of"), F.lit(0))
    pace = F.greatest(predicted - spent, F.lit(0.0)) / F.greatest(days_left, F.lit(1))
    days = F.when(left <= 0, F.lit(0)).when(pace > 0, F.ceil(F.try_divide(left, pace)))
    return rows.withColumns(
        {
            "projected_utilization_pct": ratio(predicted, limit),
            "overspend_risk": predicted > limit,
            "days_to_limit_estimate": days.cast("bigint"),
            "remaining_budget_usd": left,
        }
    )


RUNWAY_COLUMNS = (
    "client_id", "as_of_date", LIMIT, MTD, "predicted_month_end_discretionary_spend_usd",
    "projected_utilization_pct", "overspend_risk", "days_to_limit_estimate", "remaining_budget_usd",
)


def score_clients(
    tx: DataFrame,
    limits: DataFrame,
    as_of: AsOf,
    model: MonthEndModel,
    category: str | None = "category",
) -> DataFrame:
    """Score every client of `limits`; `status` says why one has no forecast.

    Spend of the whole as-of day counts here, unlike in the budget.
    """
    return score_daily(daily_discretionary(until(tx, as_of), category), limits, as_of, model)


def until(tx: DataFrame, as_of: AsOf) -> DataFrame:
    """Rows up to the end of the as-of day, or of the last one of a frame; the bound reaches the scan."""
    if isinstance(as_of, DataFrame):
        last = as_of.agg(F.max(F.to_date("as_of"))).first()[0]
        if last is None:
            return tx.limit(0)
    else:
        last = as_of
    tx = tx.where(F.col("transaction_dt") < next_midnight(day_literal(last)))
    return tx.where(F.col("tx_month") <= month_label(day_literal(last))) if "tx_month" in tx.columns else tx


def score_daily(daily: DataFrame, limits: DataFrame, as_of: AsOf, model: MonthEndModel) -> DataFrame:
    """`score_clients` from a stored daily rollup.

    A score needs the month of a client's last day only, so the other months go before the month windows.
    """
    known = with_as_of(daily, as_of).where("day <= as_of").drop("as_of")
    last = F.max("day").over(Window.partitionBy("client_id"))
    recent = known.withColumn("_last", last).where(F.trunc("day", "month") == F.trunc("_last", "month")).drop("_last")
    samples = training_samples(recent, limits)
    latest = feature_row_as_of(samples, as_of)
    scored = overspend_signals(predict_month_end(latest, model))
    kept = [c for c in RUNWAY_COLUMNS if c not in ("client_id", "as_of_date")]
    status = (
        F.when(F.col("_limit").isNull() | (F.col("_limit") <= 0), "no_limit")
        .when(F.col(MTD).isNull(), "no_history")
        .otherwise("scored")
    )
    clients = with_as_of(limits.select("client_id", F.col(LIMIT).alias("_limit")), as_of)
    return (
        clients.withColumnRenamed("as_of", "as_of_date")
        .join(scored.select("client_id", *kept), "client_id", "left")
        .select(*RUNWAY_COLUMNS, status.alias("status"))
    )


def forecast_compare(runway: DataFrame) -> DataFrame:
    """Actual, projected and limit as three rows per client; null counts zero."""
    amounts = {
        "MTD actual": MTD,
        "Projected month-end": "predicted_month_end_discretionary_spend_usd",
        "Monthly limit": LIMIT,
    }
    wide = runway.select(
        "client_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in amounts.items()]
    )
    return wide.unpivot(["client_id"], list(amounts), "label", "spend_usd")
