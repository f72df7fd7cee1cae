"""Business alerts as an array on the scored row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import fixed_text, float_text
from stockloom.functions.values import Policy

# --- Fixed values: alert texts ---
REVENUE_ALERT = 5
LOW_DEMAND_ALERT = 20
REORDER_MESSAGE = "🚨 IMMEDIATE REORDER NEEDED for "
ORDER_ACTION = ("Order ", " units immediately")
PRICING_DETAILS = ("Expected revenue increase: ", "%")
PRICING_ACTION = "Adjust price to $"
DEMAND_DETAILS = ("Current demand: ", " units")
HIGH_ACTION = "Consider increasing inventory and reviewing pricing"
PRICING_MESSAGE = {"A": "💰 Pricing optimization opportunity detected", "B": "💰 Pricing optimization opportunity"}
HIGH_MESSAGE = {"A": "📈 High demand detected", "B": "📈 High demand detected for "}
LOW_MESSAGE = {"A": "📉 Low demand detected", "B": "📉 Low demand for "}
LOW_ACTION = {
    "A": "Consider promotions or discontinuation review",
    "B": "Consider promotions or discontinuation",
}


def _alert(kind: str, severity: str, message: Column, details: Column, action: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message"),
        details.alias("details"), action.alias("action"),
    )


def business_alerts(df: DataFrame, policy: Policy) -> DataFrame:
    """Add ``alerts``: short stock, pricing opportunity, high and low demand."""
    name = policy.name
    product = F.coalesce("product_id", F.lit("Unknown"))
    quantity = F.col("order_quantity")
    units = F.concat(F.lit(DEMAND_DETAILS[0]), fixed_text(F.col("demand"), 0), F.lit(DEMAND_DETAILS[1]))

    def naming(text: str) -> Column:
        return F.lit(text) if name == "A" else F.concat(F.lit(text), product)

    raised = F.array(
        F.when(F.col("urgency") == "HIGH", _alert(
            "STOCKOUT_RISK", "HIGH", F.concat(F.lit(REORDER_MESSAGE), product), F.col("reorder_reasoning"),
            F.concat(
                F.lit(ORDER_ACTION[0]), fixed_text(quantity, 0) if name == "A" else float_text(quantity),
                F.lit(ORDER_ACTION[1]),
            ),
        )),
        F.when(F.col("revenue_change") > REVENUE_ALERT, _alert(
            "PRICING_OPPORTUNITY", "MEDIUM", F.lit(PRICING_MESSAGE[name]),
            F.concat(F.lit(PRICING_DETAILS[0]), float_text(F.col("revenue_change")), F.lit(PRICING_DETAILS[1])),
            F.concat(F.lit(PRICING_ACTION), float_text(F.col("recommended_price"))),
        )),
        F.when(F.col("demand") > policy.high_demand_alert, _alert(
            "HIGH_DEMAND", "MEDIUM", naming(HIGH_MESSAGE[name]), units, F.lit(HIGH_ACTION),
        )),
        F.when(F.col("demand") < LOW_DEMAND_ALERT, _alert(
            "LOW_PERFORMANCE", "LOW", naming(LOW_MESSAGE[name]), units, F.lit(LOW_ACTION[name]),
        )),
    )
    return df.withColumn("alerts", F.array_compact(raised))


def alert_lines(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per raised alert.

    The outer explode keeps the optimizer from deriving a filter on the array and pushing it, with all the rules it
    depends on written out, below the decision steps.
    """
    lines = df.select(*keep, F.explode_outer("alerts").alias("a"))
    return lines.filter(F.col("a").isNotNull()).select(*keep, "a.*")
