"""The offline rules against a saved report, and both rule sets at their thresholds."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from stockloom.functions.values import POLICY_A, POLICY_B
from stockloom.operators import alerts, forecast, health, pricing, report, reorder
from stockloom.plans import scoring

SAVED_DEMANDS = [
    80.92, 87.3, 90.89, 88.29, 91.54, 74.58, 83.46, 78.0, 87.72, 111.11, 105.36, 88.9, 82.75, 71.84, 98.82, 78.17, 99.55,
    96.17, 91.88, 92.39, 85.41, 90.54, 92.84, 95.78, 113.6, 105.7, 88.43, 87.18, 99.29, 104.15,
]


def test_saved_report(spark):
    start = datetime.date(2025, 10, 27)
    days = [(start + datetime.timedelta(days=i), d) for i, d in enumerate(SAVED_DEMANDS)]
    row = spark.createDataFrame(
        [("S001", "P0001", "Groceries", "South", 74.63745732424394, 200.0, 180.0, 20.0, 120.0, days)],
        "store_id string, product_id string, category string, region string, demand double, price double, "
        "competitor_price double, discount double, inventory_level double, forecast array<struct<date:date,demand:double>>",
    ).withColumn("confidence", F.lit(0.9941444982129936))
    out = forecast.forecast_totals(row.withColumn("forecast", forecast.with_trend(F.col("forecast"))))
    out = reorder.reorder(pricing.price(out, POLICY_B), POLICY_B)
    out = health.action_plan(health.health_score(alerts.business_alerts(out, POLICY_B), POLICY_B), POLICY_B)
    got = report.full_report(out, POLICY_B, "2025-10-27 00:47:21").select("report.*", "actions").first()
    assert got.demand_forecast.total_30day_forecast == pytest.approx(2742.56)
    p = got.pricing_strategy
    assert (p.recommended_price, p.recommended_discount, p.pricing_strategy) == (160.0, 20.0, "COMPETITIVE_PRICING_WITH_PRICE_MATCH")
    assert p.reasoning == "Moderate demand (75 units). Maintain competitive positioning. Consider matching competitor prices."
    assert p.expected_impact.asDict() == {
        "expected_volume_change": 30.0, "expected_revenue_change": 4.0, "old_revenue": 14927.49, "new_revenue": 15524.59,
    }
    m = got.inventory_management
    assert m.asDict() == {
        "current_inventory": 120.0, "days_of_supply": 1.6, "reorder_point": 821.0, "lead_time_demand": 597.0,
        "recommended_order_quantity": 233.0, "reorder_urgency": "HIGH", "reorder_action": "IMMEDIATE_REORDER",
        "reasoning": "Current inventory (120.0) below reorder point (821)",
        "stockout_risk": "High risk - Stockout expected around 2025-10-28",
    }
    assert [a.asDict() for a in got.business_alerts] == [{
        "type": "STOCKOUT_RISK", "severity": "HIGH", "message": "🚨 IMMEDIATE REORDER NEEDED for P0001",
        "details": "Current inventory (120.0) below reorder point (821)", "action": "Order 233.0 units immediately",
    }]
    assert got.overall_health_score == 100
    assert got.actions == ["Order 233 units of P0001"]


def decided(spark, policy, rows):
    df = spark.createDataFrame(rows, "product_id string, demand double, inventory_level double, price double, competitor_price double, discount double")
    return {r.product_id: r for r in scoring.decide(df, policy, "2024-01-01").collect()}


def test_thresholds_a(spark):
    rows = [("100", 100.0, 5000.0, 50.0, 50.0, 10.0), ("100+", 100.01, 5000.0, 50.0, 50.0, 10.0), ("30", 30.0, 5000.0, 50.0, 50.0, 10.0),
            ("30-", 29.99, 5000.0, 50.0, 50.0, 10.0), ("150", 150.0, 5000.0, 50.0, 50.0, 10.0), ("150+", 150.5, 5000.0, 50.0, 50.0, 10.0),
            ("20", 20.0, 5000.0, 50.0, 50.0, 10.0), ("20-", 19.9, 5000.0, 50.0, 50.0, 10.0), ("7d", 10.0, 70.0, 50.0, 50.0, 10.0),
            ("10d", 10.0, 100.0, 50.0, 50.0, 10.0), ("10d+", 10.0, 100.1, 50.0, 50.0, 10.0), ("dear", 60.0, 5000.0, 56.0, 50.0, 18.0),
            ("even", 60.0, 5000.0, 55.0, 50.0, 18.0), ("free", 60.0, 100.0, 0.0, 50.0, 10.0), ("c0", 60.0, 100.0, 50.0, 0.0, 10.0)]
    out = decided(spark, POLICY_A, rows)
    strategy = {k: r.pricing_strategy for k, r in out.items()}
    assert strategy["100"] == "MAINTAIN_PRICING" and strategy["100+"] == "PREMIUM_PRICING"
    assert strategy["30"] == "MAINTAIN_PRICING" and strategy["30-"] == "PROMOTIONAL_PRICING"
    assert strategy["dear"] == "COMPETITIVE_PRICING" and out["dear"].recommended_discount == 20.0
    assert strategy["c0"] == "MAINTAIN_PRICING"
    kinds = {k: {a.type for a in r.alerts} for k, r in out.items()}
    assert "HIGH_DEMAND" not in kinds["150"] and "HIGH_DEMAND" in kinds["150+"]
    assert "LOW_PERFORMANCE" not in kinds["20"] and "LOW_PERFORMANCE" in kinds["20-"]
    assert [out[k].urgency for k in ("7d", "10d", "10d+")] == ["HIGH", "MEDIUM", "LOW"]
    assert out["free"].order_quantity == round(60 * 7 + 1.65 * 15 * math.sqrt(7) + 60 * 30 - 100)
    assert out["free"].revenue_change is None
    for r in out.values():
        assert (r.order_quantity == 0) == (r.urgency == "LOW")
        assert 0 <= r.health_score <= 100 and len(r.forecast) == 30 and r.forecast[0].trend == "Stable"


def test_thresholds_b(spark):
    rows = [("50", 50.0, 9000.0, 50.0, 50.0, 10.0), ("50-", 49.9, 9000.0, 50.0, 50.0, 10.0), ("150", 150.0, 9000.0, 50.0, 50.0, 10.0),
            ("150+", 150.1, 9000.0, 50.0, 50.0, 10.0), ("200", 200.0, 90000.0, 50.0, 50.0, 10.0), ("200+", 200.1, 90000.0, 50.0, 50.0, 10.0),
            ("zero", 0.0, 100.0, 50.0, 50.0, 10.0), ("c0", 60.0, 100.0, 50.0, 0.0, 10.0), ("dear", 60.0, 100.0, 60.0, 50.0, 5.0)]
    out = decided(spark, POLICY_B, rows)
    assert [out[k].pricing_strategy for k in ("50", "50-", "150", "150+")] == [
        "COMPETITIVE_PRICING", "PROMOTIONAL_PRICING", "COMPETITIVE_PRICING", "PREMIUM_PRICING"]
    assert {a.type for a in out["200"].alerts} == set() and {a.type for a in out["200+"].alerts} == {"HIGH_DEMAND"}
    assert out["zero"].days_of_supply == 999.0 and out["zero"].stockout_date is None
    assert out["c0"].pricing_strategy == "COMPETITIVE_PRICING"
    assert out["dear"].recommended_discount == 15.0 and out["dear"].pricing_strategy.endswith("_WITH_PRICE_MATCH")


def test_partitioning_does_not_matter(spark):
    rows = [(f"P{i}", float(i), float(i * 7 % 900), 20.0 + i % 60, 30.0, float(i % 25)) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "product_id string, demand double, inventory_level double, price double, competitor_price double, discount double")
    df = df.withColumns({"store_id": F.lit("S1"), "sale_date": F.lit("2024-01-01")})
    one, many = (
        sorted(map(str, scoring.decide(df.repartition(n), POLICY_B, "2024-01-01", noise="keyed").collect())) for n in (1, 200)
    )
    assert one == many
