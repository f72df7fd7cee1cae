"""Scoring jobs: a request table to decisions, reports and bulk results. Every step is narrow: one stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import round_half_even
from stockloom.functions.values import ERROR_REPORT, POLICY_A, Policy
from stockloom.operators import alerts, cleanse, demand, forecast, health, pricing, reorder, report
from stockloom.operators.history import history_rows, prediction_id, with_request_id


def decide(
    df: DataFrame, policy: Policy, as_of: str, noise: str = "off", confidence: float | None = None
) -> DataFrame:
    """All decision columns for rows that carry ``demand`` and validated request fields."""
    out = forecast.forecast_with_totals(df, policy, as_of, noise)
    if policy.name == "A":
        out = out.withColumn("total_30day", round_half_even(F.col("total_30day"), 2))
    out = out.withColumn("confidence", F.lit(policy.confidence if confidence is None else confidence))
    out = reorder.reorder(pricing.price(out, policy), policy)
    out = health.health_score(alerts.business_alerts(out, policy), policy)
    return health.action_plan(health.health_band(out), policy)


def cleansed(df: DataFrame, policy: Policy, zero_is_missing: bool = True) -> DataFrame:
    """Requests under the policy's own cleansing.

    The serving rules (A) read a zero as missing unless told otherwise. The offline rules (B) keep it, and put classes outside
    their lists to the first of the list.
    """
    if policy.name == "B":
        return cleanse.check_domains(cleanse.coerce(df))
    return cleanse.validate(df, zero_is_missing)


def analyse(
    df: DataFrame,
    policy: Policy,
    as_of: str,
    noise: str = "off",
    demand_model: str = "heuristic",
    zero_is_missing: bool = True,
    confidence: float | None = None,
) -> DataFrame:
    """Requests to decisions: validate, estimate demand, decide.

    ``demand_model='given'`` keeps a ``demand`` column that a trained model has put there.
    """
    out = cleansed(df, policy, zero_is_missing)
    if demand_model == "heuristic":
        out = demand.heuristic_demand(out, noise)
    elif demand_model == "naive":
        out = demand.naive_demand(out, noise)
    return decide(out, policy, as_of, noise, confidence)


def analyse_with_report(df: DataFrame, policy: Policy, as_of: str, analysed_at: str, **options) -> DataFrame:
    return report.full_report(analyse(df, policy, as_of, **options), policy, analysed_at)


def bulk_requests(raw: DataFrame, keep: tuple[str, ...] = (), units_from_inventory: bool = False) -> DataFrame:
    """Uploaded text to typed requests; unreadable rows carry a reject reason."""
    if cleanse.MALFORMED in raw.columns:
        keep = (*keep, cleanse.MALFORMED)
    mapped = cleanse.map_bulk_columns(raw)
    if keep:
        mapped = raw.select(*keep, *[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
                                     for c in mapped.columns if c not in keep])
    return cleanse.normalize_bulk(mapped, units_from_inventory, keep).drop(cleanse.MALFORMED)


def accepted(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col(cleanse.REJECT).isNull())


def rejected(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col(cleanse.REJECT).isNotNull())


def rejected_reports(requests: DataFrame, as_of: str, analysed_at: str, noise: str = "off") -> DataFrame:
    """The error report of each quarantined row."""
    rows = rejected(requests).withColumn("demand", F.lit(ERROR_REPORT["demand"]))
    return report.error_report(forecast.daily_forecast(rows, POLICY_A, as_of, noise), analysed_at)


def bulk_results(scored: DataFrame, run_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns shown after an upload, each row with the id of its history row."""
    return scored.select(
        *keep, prediction_id(scored, run_id).alias("id"), "store_id", "product_id", "category",
        round_half_even(F.col("demand"), 2).alias("predicted_demand"),
        F.col("order_quantity").alias("reorder_qty"),
        "recommended_price", "health_score",
    )


def bulk_history(
    raw: DataFrame, run_id: str, user_id: int, as_of: str, analysed_at: str, keep: tuple[str, ...] = (), created_at: Column | None = None
) -> DataFrame:
    """History rows of the accepted rows of an upload, each with the uploaded text as its input.

    An upload without ``request_id`` is numbered by the places of its rows.
    """
    raw = with_request_id(raw, "upload")
    named = raw.withColumn("request", F.struct(*[c for c in raw.columns if c != "request_id"]))
    requests = bulk_requests(named, keep=(*keep, "request_id", "request"))
    scored = analyse_with_report(accepted(requests), POLICY_A, as_of, analysed_at).withColumn("user_id", F.lit(user_id).cast("bigint"))
    return history_rows(scored, run_id, created_at=created_at)


def top_products(scored: DataFrame, n: int = 20) -> DataFrame:
    """Products with the largest total order quantity."""
    return (
        scored.groupBy("product_id")
        .agg(
            F.sum("order_quantity").alias("total_order_quantity"),
            F.count_if(F.col("urgency") == "HIGH").alias("high_urgency_rows"),
            F.round(F.avg("health_score"), 6).alias("mean_health_score"),
        )
        .orderBy(F.col("total_order_quantity").desc(), "product_id")
        .limit(n)
    )
