"""Exports of reports and of the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.forecast import first_days

# --- Fixed values: sections, labels and headers of the exports ---
TITLE = "RETAIL ANALYSIS EXPORT"
SECTION_INFO = "PRODUCT INFORMATION"
SECTION_DEMAND = "DEMAND FORECAST"
SECTION_DAILY = "DAILY FORECAST (Next 7 Days)"
SECTION_PRICING = "PRICING STRATEGY"
SECTION_INVENTORY = "INVENTORY MANAGEMENT"
SECTION_ALERTS = "BUSINESS ALERTS"
NO_ALERTS = "No active alerts"
DAILY_HEADS = ("Date", "Forecasted Demand")
ALERT_HEADS = ("Type", "Severity", "Message", "Action")
HISTORY_TITLE = "COMPLETE PREDICTION HISTORY EXPORT"
HISTORY_HEADER = {
    "prediction_id": "Prediction ID", "date": "Date", "store_id": "Store ID", "product_id": "Product ID",
    "category": "Category", "demand_forecast": "Demand Forecast", "recommended_price": "Recommended Price",
    "reorder_quantity": "Reorder Quantity", "health_score": "Health Score",
}


def report_json(df: DataFrame, exported_at: str) -> DataFrame:
    """Each report as JSON text with an export header."""
    header = F.struct(
        F.lit(exported_at).alias("exported_at"), "prediction_id", "product_id", "store_id"
    ).alias("export_info")
    return df.select("prediction_id", F.to_json(F.struct(header, "report.*")).alias("export"))


LINE = ("section", "key", "value", "extra", "more")


def _line(section: str, *cells: Column | str) -> Column:
    """A section's name and up to four cells."""
    texts = [F.lit(c) if isinstance(c, str) else c for c in (section, *cells)]
    texts += [F.lit(None)] * (len(LINE) - len(texts))
    return F.struct(*[t.cast("string").alias(name) for t, name in zip(texts, LINE, strict=True)])


def _report_line_array(exported_at: str) -> Column:
    """The ordered lines of a report, the forecast cut to seven days; tables begin with their column heads."""
    info, demand = F.col("report.product_info"), F.col("report.demand_forecast")
    pricing, stock = F.col("report.pricing_strategy"), F.col("report.inventory_management")
    fixed = F.array(
        _line(TITLE, "Exported at", F.lit(exported_at)),
        _line(TITLE, "Prediction ID", F.col("prediction_id")),
        _line(TITLE, "Product ID", F.col("product_id")),
        _line(TITLE, "Store ID", F.col("store_id")),
        _line(SECTION_INFO, "Store", info["store_id"]),
        _line(SECTION_INFO, "Product", info["product_id"]),
        _line(SECTION_INFO, "Category", info["category"]),
        _line(SECTION_INFO, "Region", info["region"]),
        _line(SECTION_INFO, "Analysis Timestamp", info["analysis_timestamp"]),
        _line(SECTION_INFO, "Health Score", F.col("report.overall_health_score")),
        _line(SECTION_DEMAND, "Immediate Demand", demand["immediate_demand"]),
        _line(SECTION_DEMAND, "30-Day Forecast", demand["total_30day_forecast"]),
        _line(SECTION_DEMAND, "Confidence Score", demand["confidence_score"]),
    )
    daily = F.transform(
        first_days(demand["daily_forecasts"]), lambda d: _line(SECTION_DAILY, d["date"].cast("string"), d["demand"])
    )
    decisions = F.array(
        _line(SECTION_PRICING, "Current Price", pricing["current_price"]),
        _line(SECTION_PRICING, "Recommended Price", pricing["recommended_price"]),
        _line(SECTION_PRICING, "Current Discount", pricing["current_discount"]),
        _line(SECTION_PRICING, "Recommended Discount", pricing["recommended_discount"]),
        _line(SECTION_PRICING, "Strategy", pricing["pricing_strategy"]),
        _line(SECTION_PRICING, "Expected Revenue Change", pricing["expected_impact"]["expected_revenue_change"]),
        _line(SECTION_INVENTORY, "Current Inventory", stock["current_inventory"]),
        _line(SECTION_INVENTORY, "Days of Supply", stock["days_of_supply"]),
        _line(SECTION_INVENTORY, "Reorder Point", stock["reorder_point"]),
        _line(SECTION_INVENTORY, "Recommended Order Quantity", stock["recommended_order_quantity"]),
        _line(SECTION_INVENTORY, "Reorder Urgency", stock["reorder_urgency"]),
        _line(SECTION_INVENTORY, "Stockout Risk", stock["stockout_risk"]),
    )
    raised = F.transform(
        "report.business_alerts",
        lambda a: _line(SECTION_ALERTS, a["type"], a["severity"], a["message"], a["action"]),
    )
    alerts = F.when(
        F.size("report.business_alerts") > 0, F.concat(F.array(_line(SECTION_ALERTS, *ALERT_HEADS)), raised)
    ).otherwise(F.array(_line(SECTION_ALERTS, NO_ALERTS)))
    return F.concat(fixed, F.array(_line(SECTION_DAILY, *DAILY_HEADS)), daily, decisions, alerts)


def report_lines(df: DataFrame, exported_at: str) -> DataFrame:
    """Each report as ordered lines, for a quoting CSV writer.

    The lines of a report come from one array, so no sort is needed. The array is never empty; the outer explode only
    keeps the optimizer from pushing a filter on it below the decision steps.
    """
    lines = df.select("prediction_id", F.posexplode_outer(_report_line_array(exported_at)).alias("line", "l"))
    return lines.select("prediction_id", "line", "l.*")


def _quoted(value: Column) -> Column:
    escaped = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\\r\\n]'), escaped).otherwise(value)


def report_csv(df: DataFrame, exported_at: str) -> DataFrame:
    """Each report as one CSV text of five columns; a missing cell is empty."""
    rows = F.transform(
        "lines", lambda l: F.concat_ws(",", *[F.coalesce(_quoted(l[part]), F.lit("")) for part in LINE])
    )
    lined = df.select("prediction_id", _report_line_array(exported_at).alias("lines"))
    return lined.select("prediction_id", F.array_join(rows, "\n").alias("export"))


def history_json(history: DataFrame) -> DataFrame:
    """A user's history, ready for a JSON writer; the health score comes from the stored report, 0 if it has none."""
    score = F.coalesce(F.get_json_object("prediction_result", "$.overall_health_score").try_cast("int"), F.lit(0))
    return history.select(
        "prediction_id", "user_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "store_id",
        "product_id", "category", "demand_forecast", "recommended_price", "reorder_quantity",
        (F.coalesce("health_score", score) if "health_score" in history.columns else score).alias("health_score"),
    )


def history_csv(history: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The nine columns of the history's CSV export."""
    return history.select(
        *keep, "prediction_id", F.date_format("created_at", "yyyy-MM-dd").alias("date"), "store_id", "product_id", "category",
        "demand_forecast", "recommended_price", "reorder_quantity", F.coalesce("health_score", F.lit(0)).alias("health_score"),
    )


def history_heads(history: DataFrame, exported_at: str) -> DataFrame:
    """What stands above each user's export: title, time, user, number of predictions and the nine column titles."""
    totals = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_predictions"))
    return totals.select(
        "user_id", F.lit(HISTORY_TITLE).alias("title"), F.lit(exported_at).alias("exported_at"), "total_predictions",
        F.lit(",".join(HISTORY_HEADER.values())).alias("column_titles"),
    )


def history_csv_lines(history: DataFrame, exported_at: str) -> DataFrame:
    """Each user's export as CSV lines: the numbered lines of the head, then the rows, whose number is null.

    Rows are not ordered, so a user's history of any length is written by as many tasks as hold it.
    """
    heads = history_heads(history, exported_at).select("user_id", F.posexplode(F.array(
        _quoted(F.col("title")), F.concat_ws(",", F.lit("Exported at"), "exported_at"),
        F.concat_ws(",", F.lit("User"), F.col("user_id").cast("string")),
        F.concat_ws(",", F.lit("Total Predictions"), F.col("total_predictions").cast("string")), F.lit(""), F.col("column_titles"),
    )).alias("line", "text"))
    rows = history_csv(history.withColumn("_user", F.col("user_id")), keep=("_user",))
    cells = [F.coalesce(_quoted(F.col(c).cast("string")), F.lit("")) for c in HISTORY_HEADER]
    rows = rows.select(F.col("_user").alias("user_id"), F.lit(None).cast("int").alias("line"), F.concat_ws(",", *cells).alias("text"))
    return heads.unionByName(rows)


def report_metrics_long(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Five headline figures of each report as (metric, value) rows."""
    figures = [
        ("Product ID", F.col("report.product_info.product_id")),
        ("Store ID", F.col("report.product_info.store_id")),
        ("Demand Forecast", F.col("report.demand_forecast.immediate_demand")),
        ("Recommended Price", F.col("report.pricing_strategy.recommended_price")),
        ("Reorder Quantity", F.col("report.inventory_management.recommended_order_quantity")),
    ]
    wide = df.select(*keep, *[value.cast("string").alias(name) for name, value in figures])
    return wide.unpivot(list(keep), [name for name, _ in figures], "metric", "value")
