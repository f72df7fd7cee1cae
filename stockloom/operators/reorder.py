"""Reorder point, order quantity, urgency and stock-out risk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import fixed_text, float_text, round_half_even
from stockloom.functions.values import BUFFER_DAYS, HOLDING_RATE, LEAD_DAYS, ORDERING_COST, Policy
from stockloom.operators.forecast import demand_sum, first_days, stockout_date

# --- Fixed values: service level, actions and reasons ---
SERVICE_Z = 1.65
DEMAND_CV = 0.25
ACTIONS = {"HIGH": "IMMEDIATE_REORDER", "MEDIUM": "SCHEDULE_REORDER", "LOW": "MONITOR"}
A_HIGH = "Inventory below lead-time demand"
A_RISK = ("High risk - stockout in ", " days")
A_RISK_MEDIUM = "Medium risk - monitor closely"
A_RISK_LOW = "Low risk - sufficient inventory"
B_RISK = "High risk - Stockout expected around "
B_RISK_LOW = "Low risk - Sufficient inventory for 30+ days"


def economic_order_quantity(demand: Column, unit_cost: Column, cap_days: float | None = None) -> Column:
    """The order size that balances ordering against holding cost; 30 days of demand without a holding cost."""
    holding = unit_cost * HOLDING_RATE
    size = F.when(holding > 0, F.sqrt(F.try_divide(2 * (demand * 365) * ORDERING_COST, holding))).otherwise(demand * 30)
    return size if cap_days is None else F.least(size, demand * cap_days)


def _by_urgency(high: Column, medium: Column, low: Column) -> Column:
    return F.when(F.col("urgency") == "HIGH", high).when(F.col("urgency") == "MEDIUM", medium).otherwise(low)


def reorder_a(df: DataFrame, policy: Policy) -> DataFrame:
    """Safety stock from a service level; an order up to reorder point plus economic quantity if stock is short."""
    limit = LEAD_DAYS + BUFFER_DAYS
    out = df.withColumns({
        "_stock": F.greatest(F.lit(0.0), F.col("inventory_level")),
        "_need": F.greatest(F.lit(0.1), F.col("demand")),
    })
    out = out.withColumns({
        "_days": F.col("_stock") / F.col("_need"),
        "_safety": SERVICE_Z * (F.col("_need") * DEMAND_CV) * math.sqrt(LEAD_DAYS),
        "_eoq": economic_order_quantity(F.col("_need"), F.col("price")),
    })
    out = out.withColumns({
        "_point": F.col("_need") * LEAD_DAYS + F.col("_safety"),
        "urgency": F.when(F.col("_stock") <= F.col("_need") * LEAD_DAYS, "HIGH")
        .when(F.col("_days") <= limit, "MEDIUM")
        .otherwise("LOW"),
    })
    days = fixed_text(F.col("_days"), 1)
    quantity = F.when(
        F.col("urgency") != "LOW", F.greatest(F.lit(0.0), F.col("_point") + F.col("_eoq") - F.col("_stock"))
    ).otherwise(0.0)
    risk = (
        F.when(F.col("_days") < LEAD_DAYS, F.concat(F.lit(A_RISK[0]), fixed_text(F.col("_days"), 0), F.lit(A_RISK[1])))
        .when(F.col("_days") < limit, A_RISK_MEDIUM)
        .otherwise(A_RISK_LOW)
    )
    return out.withColumns({
        "current_inventory": F.col("_stock"),
        "days_of_supply": round_half_even(F.col("_days"), 1),
        "reorder_point": round_half_even(F.col("_point"), 0),
        "safety_stock": round_half_even(F.col("_safety"), 0),
        "order_quantity": round_half_even(quantity, 0),
        "reorder_action": _by_urgency(*[F.lit(ACTIONS[u]) for u in ("HIGH", "MEDIUM", "LOW")]),
        "reorder_reasoning": _by_urgency(
            F.lit(A_HIGH),
            F.concat(F.lit("Low days of supply ("), days, F.lit(")")),
            F.concat(F.lit("Sufficient inventory ("), days, F.lit(")")),
        ),
        "stockout_risk": risk,
    }).drop("_stock", "_need", "_days", "_safety", "_eoq", "_point")


def reorder_b(df: DataFrame, policy: Policy) -> DataFrame:
    """Reorder point from the first forecast week plus three days; the order is always the economic quantity."""
    out = df.withColumns({
        "_days": F.coalesce(
            F.when(F.col("demand") > 0, F.try_divide(F.col("inventory_level"), F.col("demand"))), F.lit(999.0)
        ),
        "_lead": F.col("lead_time_demand") if "lead_time_demand" in df.columns else demand_sum(first_days(F.col("forecast"))),
        "stockout_date": stockout_date(F.col("forecast"), F.col("inventory_level")),
    })
    out = out.withColumn("_point", F.col("_lead") + BUFFER_DAYS * F.col("demand"))
    out = out.withColumn(
        "urgency",
        F.when(F.col("inventory_level") <= F.col("_point"), "HIGH")
        .when(F.col("_days") <= LEAD_DAYS + BUFFER_DAYS, "MEDIUM")
        .otherwise("LOW"),
    )
    days = fixed_text(F.col("_days"), 1)
    risk = F.when(
        F.col("stockout_date").isNotNull(), F.concat(F.lit(B_RISK), F.date_format("stockout_date", "yyyy-MM-dd"))
    ).otherwise(B_RISK_LOW)
    return out.withColumns({
        "current_inventory": F.col("inventory_level"),
        "days_of_supply": round_half_even(F.col("_days"), 1),
        "reorder_point": round_half_even(F.col("_point"), 0),
        "lead_time_demand": round_half_even(F.col("_lead"), 0),
        "order_quantity": round_half_even(economic_order_quantity(F.col("demand"), F.col("price"), policy.order_cap_days), 0),
        "reorder_action": _by_urgency(*[F.lit(ACTIONS[u]) for u in ("HIGH", "MEDIUM", "LOW")]),
        "reorder_reasoning": _by_urgency(
            F.concat(
                F.lit("Current inventory ("), float_text(F.col("inventory_level")), F.lit(") below reorder point ("),
                fixed_text(F.col("_point"), 0), F.lit(")"),
            ),
            F.concat(F.lit("Low days of supply ("), days, F.lit(" days)")),
            F.concat(F.lit("Sufficient inventory ("), days, F.lit(" days supply)")),
        ),
        "stockout_risk": risk,
    }).drop("_days", "_lead", "_point")


def reorder(df: DataFrame, policy: Policy) -> DataFrame:
    return reorder_a(df, policy) if policy.name == "A" else reorder_b(df, policy)
