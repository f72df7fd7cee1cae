"""The complete report of a scored row as one nested column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import round_half_even
from stockloom.functions.values import ERROR_REPORT, Policy
from stockloom.operators.cleanse import REJECT
from stockloom.operators.forecast import normalize_forecast
from stockloom.schemas import FORECAST, LEGACY_FORECAST


def _text(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) if c in df.columns else F.lit("Unknown")


def product_info(df: DataFrame, analysed_at: str) -> Column:
    return F.struct(
        *[_text(df, c).alias(c) for c in ("store_id", "product_id", "category", "region")],
        F.lit(analysed_at).alias("analysis_timestamp"),
    )


def _impact(volume: Column, revenue: Column, old: Column, new: Column) -> Column:
    return F.struct(
        volume.alias("expected_volume_change"), revenue.alias("expected_revenue_change"),
        old.alias("old_revenue"), new.alias("new_revenue"),
    )


def full_report(df: DataFrame, policy: Policy, analysed_at: str) -> DataFrame:
    """Add ``report``; the input carries the columns of all decision operators."""
    own_stock = "safety_stock" if policy.name == "A" else "lead_time_demand"
    demand = round_half_even(F.col("demand"), 2) if policy.name == "A" else F.col("demand")
    level = [] if policy.name == "A" else [F.col("demand").alias("demand_level")]
    report = F.struct(
        product_info(df, analysed_at).alias("product_info"),
        F.struct(
            demand.alias("immediate_demand"), F.col("total_30day").alias("total_30day_forecast"),
            F.col("confidence").alias("confidence_score"), F.col("forecast").alias("daily_forecasts"),
        ).alias("demand_forecast"),
        F.struct(
            F.col("price").alias("current_price"), F.col("discount").alias("current_discount"), "competitor_price",
            *level, "recommended_price", "recommended_discount", "pricing_strategy",
            F.col("pricing_reasoning").alias("reasoning"),
            _impact(*map(F.col, ("volume_change", "revenue_change", "old_revenue", "new_revenue")))
            .alias("expected_impact"),
        ).alias("pricing_strategy"),
        F.struct(
            "current_inventory", "days_of_supply", "reorder_point", own_stock,
            F.col("order_quantity").alias("recommended_order_quantity"), F.col("urgency").alias("reorder_urgency"),
            "reorder_action", F.col("reorder_reasoning").alias("reasoning"), "stockout_risk",
        ).alias("inventory_management"),
        F.col("alerts").alias("business_alerts"),
        F.col("health_score").alias("overall_health_score"),
    )
    return df.withColumn("report", report)


def error_report(df: DataFrame, analysed_at: str) -> DataFrame:
    """The fixed report of rows that carry a reject reason.

    ``forecast`` is the 30-day forecast at the fixed demand, added by the caller; price, discount and inventory are
    the row's own where it has them.
    """
    v = ERROR_REPORT

    def own(c: str, key: str) -> Column:
        default = F.lit(v[key])
        return F.coalesce(F.col(c).cast("double"), default) if c in df.columns else default

    price, discount = own("price", "price"), own("discount", "discount")
    report = F.struct(
        product_info(df, analysed_at).alias("product_info"),
        F.struct(
            F.lit(v["demand"]).alias("immediate_demand"), F.lit(v["total_30day"]).alias("total_30day_forecast"),
            F.lit(v["confidence"]).alias("confidence_score"), F.col("forecast").alias("daily_forecasts"),
        ).alias("demand_forecast"),
        F.struct(
            price.alias("current_price"), discount.alias("current_discount"), price.alias("recommended_price"),
            discount.alias("recommended_discount"), F.lit(v["strategy"]).alias("pricing_strategy"),
            F.lit(v["pricing_reasoning"]).alias("reasoning"),
            _impact(F.lit(0.0), F.lit(0.0), F.lit(v["revenue"]), F.lit(v["revenue"])).alias("expected_impact"),
        ).alias("pricing_strategy"),
        F.struct(
            own("inventory_level", "inventory").alias("current_inventory"),
            F.lit(v["days_of_supply"]).alias("days_of_supply"), F.lit(v["reorder_point"]).alias("reorder_point"),
            F.lit(v["order_quantity"]).alias("recommended_order_quantity"),
            F.lit(v["urgency"]).alias("reorder_urgency"), F.lit(v["action"]).alias("reorder_action"),
            F.lit(v["reorder_reasoning"]).alias("reasoning"), F.lit(v["stockout_risk"]).alias("stockout_risk"),
        ).alias("inventory_management"),
        F.array(F.struct(
            F.lit(v["alert_type"]).alias("type"), F.lit(v["alert_severity"]).alias("severity"),
            F.lit(v["alert_message"]).alias("message"), F.col(REJECT).alias("details"),
            F.lit(v["alert_action"]).alias("action"),
        )).alias("business_alerts"),
        F.lit(v["health_score"]).alias("overall_health_score"),
    )
    return df.withColumn("report", report)


STORED = """
    product_info struct<store_id: string, product_id: string, category: string, region: string, analysis_timestamp: string>,
    demand_forecast struct<immediate_demand: double, total_30day_forecast: double, confidence_score: double, daily_forecasts: string>,
    pricing_strategy struct<current_price: double, current_discount: double, competitor_price: double, recommended_price: double,
      recommended_discount: double, pricing_strategy: string, reasoning: string, expected_impact: struct<expected_volume_change: double,
      expected_revenue_change: double, old_revenue: double, new_revenue: double>>,
    inventory_management struct<current_inventory: double, days_of_supply: double, reorder_point: double, safety_stock: double,
      lead_time_demand: double, recommended_order_quantity: double, reorder_urgency: string, reorder_action: string, reasoning: string,
      stockout_risk: string>,
    business_alerts array<struct<type: string, severity: string, message: string, details: string, action: string>>,
    overall_health_score int
"""


def read_report(history: DataFrame) -> DataFrame:
    """Stored reports as a nested column ``report``, with their daily forecasts as the list ``forecast``.

    Forecasts are stored as a list, or in older records as a date -> value map; in any other form they are empty. A bare ``NaN``,
    which some writers leave in the text, is read as null.
    """
    clean = F.regexp_replace("prediction_result", r"(:\s*)-?(NaN|Infinity)(?=\s*[,}\]])", "$1null")
    out = history.withColumn("report", F.from_json(clean, STORED))
    days = F.col("report.demand_forecast.daily_forecasts")
    out = out.withColumns({
        "_list": F.when(F.substr(F.ltrim(days), F.lit(1), F.lit(1)) == "[", F.from_json(days, FORECAST.simpleString())),
        "_map": F.when(F.substr(F.ltrim(days), F.lit(1), F.lit(1)) == "{", F.from_json(days, LEGACY_FORECAST.simpleString())),
    })
    return normalize_forecast(out, "_list", "_map").drop("_list", "_map")
