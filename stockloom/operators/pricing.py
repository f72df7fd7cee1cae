"""Discount and price recommendation with its expected effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import fixed_text, round_half_even
from stockloom.functions.values import ELASTICITY, Policy

# --- Fixed values: strategy names and reasons ---
PREMIUM = "PREMIUM_PRICING"
PROMOTIONAL = "PROMOTIONAL_PRICING"
COMPETITIVE = "COMPETITIVE_PRICING"
MAINTAIN = "MAINTAIN_PRICING"
PRICE_MATCH = "_WITH_PRICE_MATCH"
A_PREMIUM = "High demand allows for premium pricing"
A_PROMOTIONAL = "Low demand requires promotional pricing"
A_COMPETITIVE = "Price is higher than competition, consider matching"
A_MAINTAIN = "Current pricing is competitive"
B_LOW = ("Low demand (", " units). Increase discounts to stimulate sales.")
B_HIGH = ("High demand (", " units). Reduce discounts for better margins.")
B_MODERATE = ("Moderate demand (", " units). Maintain competitive positioning.")
B_MATCH = " Consider matching competitor prices."


def recommend_price(df: DataFrame, policy: Policy) -> DataFrame:
    """Add the recommended discount and price, the strategy and its reason."""
    demand, discount = F.col("demand"), F.col("discount")
    dear = F.coalesce(F.try_divide(F.col("price"), F.col("competitor_price")) > 1.1, F.lit(False))
    high, low = demand > policy.high_demand, demand < policy.low_demand
    less, more = F.greatest(F.lit(0.0), discount - 5), F.least(F.lit(30.0), discount + 10)
    if policy.name == "A":
        recommended = (
            F.when(high, less).when(low, more).when(dear, F.least(F.lit(20.0), discount + 5)).otherwise(discount)
        )
        strategy = F.when(high, PREMIUM).when(low, PROMOTIONAL).when(dear, COMPETITIVE).otherwise(MAINTAIN)
        reason = F.when(high, A_PREMIUM).when(low, A_PROMOTIONAL).when(dear, A_COMPETITIVE).otherwise(A_MAINTAIN)
    else:
        by_demand = F.when(low, more).when(high, less).otherwise(discount)
        recommended = F.when(dear, F.greatest(by_demand, F.lit(15.0))).otherwise(by_demand)
        strategy = F.concat(
            F.when(low, PROMOTIONAL).when(high, PREMIUM).otherwise(COMPETITIVE),
            F.when(dear, PRICE_MATCH).otherwise(""),
        )
        units = fixed_text(demand, 0)
        told = [F.concat(F.lit(before), units, F.lit(after)) for before, after in (B_LOW, B_HIGH, B_MODERATE)]
        reason = F.concat(
            F.when(low, told[0]).when(high, told[1]).otherwise(told[2]), F.when(dear, B_MATCH).otherwise("")
        )
    return df.withColumns({
        "recommended_discount": recommended,
        "pricing_strategy": strategy,
        "pricing_reasoning": reason,
    }).withColumn("_new_price", F.col("price") * (1 - F.col("recommended_discount") / 100))


def price_impact(df: DataFrame) -> DataFrame:
    """Expected change of volume and revenue against the undiscounted price."""
    demand, old, new = F.col("demand"), F.col("price"), F.col("_new_price")
    volume = ELASTICITY * F.try_divide(new - old, old)
    old_revenue = demand * old
    out = df.withColumns({"_volume": volume, "_old_revenue": old_revenue})
    out = out.withColumn("_new_revenue", demand * (1 + F.col("_volume")) * new)
    change = F.try_divide(F.col("_new_revenue") - F.col("_old_revenue"), F.col("_old_revenue")) * 100
    return out.withColumn("_change", change).withColumns({
        "recommended_price": round_half_even(F.col("_new_price"), 2),
        "volume_change": round_half_even(F.col("_volume") * 100, 1),
        "revenue_change": round_half_even(F.col("_change"), 1),
        "old_revenue": round_half_even(F.col("_old_revenue"), 2),
        "new_revenue": round_half_even(F.col("_new_revenue"), 2),
    }).drop("_new_price", "_volume", "_old_revenue", "_new_revenue", "_change")


def price(df: DataFrame, policy: Policy) -> DataFrame:
    return price_impact(recommend_price(df, policy))
