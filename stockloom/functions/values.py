"""Domains, defaults, rule constants and texts that results must reproduce exactly."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: spellings read as missing in uploaded files ---
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: spellings read as a set flag ---
FORM_FLAGS = ("1", "on", "true")
SCRIPT_FLAGS = ("1", "yes", "y", "true")
SALES_FLAGS = ("Yes", "1")

# --- Fixed values: allowed classes, the fallback class first ---
DOMAINS = {
    "category": ("Groceries", "Toys", "Electronics", "Clothing", "Furniture"),
    "region": ("North", "South", "East", "West"),
    "weather": ("Sunny", "Rainy", "Cloudy", "Snowy"),
    "season": ("Winter", "Spring", "Summer", "Autumn"),
}

# --- Fixed values: defaults of a single request ---
REQUEST_DEFAULTS = {
    "inventory_level": 100.0,
    "units_ordered": 50.0,
    "units_sold": 40.0,
    "price": 30.0,
    "discount": 10.0,
    "competitor_price": 28.0,
    "demand_forecast": 40.0,
}

# --- Fixed values: defaults of an uploaded row ---
BULK_DEFAULTS = {
    "store_id": "UNKNOWN",
    "product_id": "UNKNOWN",
    "category": "General",
    "price": 50.0,
    "inventory_level": 100,
    "promotion": 0,
    "season": "Normal",
    "units_sold": 0,
    "discount": 0.0,
}

# --- Fixed values: the report of a row that could not be scored ---
ERROR_REPORT = {
    "demand": 50.0,
    "total_30day": 1500.0,
    "confidence": 0.5,
    "price": 30.0,
    "discount": 10.0,
    "strategy": "MAINTAIN",
    "pricing_reasoning": "Using current pricing due to analysis error",
    "revenue": 1500.0,
    "inventory": 100.0,
    "days_of_supply": 2.0,
    "reorder_point": 100.0,
    "order_quantity": 50.0,
    "urgency": "MEDIUM",
    "action": "MONITOR",
    "reorder_reasoning": "Basic recommendation due to analysis error",
    "stockout_risk": "Unknown risk due to analysis error",
    "alert_type": "SYSTEM_ERROR",
    "alert_severity": "HIGH",
    "alert_message": "Analysis encountered an error",
    "alert_action": "Please try again or contact support",
    "health_score": 50,
}

# --- Fixed values: constants shared by both rule sets ---
ELASTICITY = -1.5
LEAD_DAYS = 7
BUFFER_DAYS = 3
ORDERING_COST = 50.0
HOLDING_RATE = 0.25
MAX_DEMAND = 1000
HORIZON = 30


@dataclass(frozen=True)
class Policy:
    """One complete rule set."""

    name: str
    low_demand: float
    high_demand: float
    weekend_factor: float
    weekday_factor: float
    month_factors: tuple[float, ...]
    daily_floor: float
    noise_sd: float
    noise_low: float | None
    noise_high: float | None
    high_demand_alert: float
    confidence: float
    confidence_points: float | None
    order_cap_days: float | None


# --- Fixed values: the serving rules (A) and the offline rules (B) ---
POLICY_A = Policy(
    name="A",
    low_demand=30.0,
    high_demand=100.0,
    weekend_factor=1.2,
    weekday_factor=1.0,
    month_factors=(1.0,) * 12,
    daily_floor=5.0,
    noise_sd=0.15,
    noise_low=None,
    noise_high=None,
    high_demand_alert=150.0,
    confidence=0.85,
    confidence_points=None,
    order_cap_days=None,
)
POLICY_B = Policy(
    name="B",
    low_demand=50.0,
    high_demand=150.0,
    weekend_factor=0.9,
    weekday_factor=1.1,
    month_factors=(0.9, 0.85, 0.95, 1.0, 1.05, 1.1, 1.15, 1.1, 1.0, 1.05, 1.2, 1.3),
    daily_floor=0.0,
    noise_sd=0.1,
    noise_low=0.7,
    noise_high=1.3,
    high_demand_alert=200.0,
    confidence=0.5,
    confidence_points=30.0,
    order_cap_days=90.0,
)
POLICIES = {"A": POLICY_A, "B": POLICY_B}
