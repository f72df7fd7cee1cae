"""Health score, its colour band, and the action plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import fixed_text, float_text, round_half_even
from stockloom.functions.values import Policy

# --- Fixed values: score points, bands and action texts ---
BASE_POINTS = 50.0
CONFIDENCE_POINTS_A = 15.0
BANDS = ((80, "green"), (60, "yellow"))
LAST_BAND = "red"
PLAN_A = (
    "Change price to $", ("Order ", " units"), "High demand period - watch inventory closely",
    "Low demand - consider promotions or discontinuation",
)
PLAN_B = (
    ("Adjust pricing to $", " (", "% discount)"), ("Order ", " units of "),
    "Monitor stock levels closely - high demand period", "Consider promotional activities to boost sales",
    "Maintain current strategy - performance is optimal",
)


def health_score(df: DataFrame, policy: Policy) -> DataFrame:
    """Points for demand, for stock and for confidence, between 0 and 100."""
    demand = F.col("demand")
    points = F.when(demand > 100, 30.0).when(demand > 50, 20.0).when(demand > 20, 10.0).otherwise(0.0)
    stock = F.when(F.col("urgency") == "LOW", 20.0).when(F.col("urgency") == "MEDIUM", 10.0).otherwise(0.0)
    confidence: Column = F.lit(CONFIDENCE_POINTS_A)
    if policy.confidence_points is not None:
        confidence = F.col("confidence") * policy.confidence_points
    score = round_half_even(BASE_POINTS + points + stock + confidence, 0)
    return df.withColumn("health_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).cast("int"))


def health_band(df: DataFrame) -> DataFrame:
    score = F.col("health_score")
    return df.withColumn(
        "health_band",
        F.when(score >= BANDS[0][0], BANDS[0][1]).when(score >= BANDS[1][0], BANDS[1][1]).otherwise(LAST_BAND),
    )


def action_plan(df: DataFrame, policy: Policy) -> DataFrame:
    """Recommended actions, in order, as an array of texts."""
    reprice = F.col("recommended_discount") != F.col("discount")
    order = F.col("urgency").isin("HIGH", "MEDIUM")
    busy, slow = F.col("demand") > 150, F.col("demand") < 30
    quantity = fixed_text(F.col("order_quantity"), 0)
    if policy.name == "A":
        steps = F.array_compact(F.array(
            F.when(reprice, F.concat(F.lit(PLAN_A[0]), fixed_text(F.col("recommended_price"), 2))),
            F.when(order, F.concat(F.lit(PLAN_A[1][0]), quantity, F.lit(PLAN_A[1][1]))),
            F.when(busy, PLAN_A[2]),
            F.when(slow, PLAN_A[3]),
        ))
    else:
        before, between, after = PLAN_B[0]
        steps = F.array_compact(F.array(
            F.when(reprice, F.concat(
                F.lit(before), float_text(F.col("recommended_price")), F.lit(between),
                float_text(F.col("recommended_discount")), F.lit(after),
            )),
            F.when(order, F.concat(F.lit(PLAN_B[1][0]), quantity, F.lit(PLAN_B[1][1]), F.col("product_id"))),
            F.when(busy, PLAN_B[2]).when(slow, PLAN_B[3]),
        ))
        steps = F.when(F.size(steps) == 0, F.array(F.lit(PLAN_B[4]))).otherwise(steps)
    return df.withColumn("actions", steps)
