"""Explicit schemas of every file and table the jobs read or write."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

# Title-case header of a sales file -> engine column.
SALES_HEADER = {
    "Date": "sale_date",
    "Store ID": "store_id",
    "Product ID": "product_id",
    "Category": "category",
    "Region": "region",
    "Inventory Level": "inventory_level",
    "Units Ordered": "units_ordered",
    "Demand Forecast": "demand_forecast",
    "Price": "price",
    "Discount": "discount",
    "Weather Condition": "weather",
    "Holiday/Promotion": "promotion",
    "Competitor Pricing": "competitor_price",
    "Seasonality": "season",
    "Units Sold": "units_sold",
}

SALES = _struct(
    sale_date=T.DateType(), store_id=_S, product_id=_S, category=_S, region=_S, inventory_level=_D,
    units_ordered=_D, demand_forecast=_D, price=_D, discount=_D, weather=_S, promotion=_S,
    competitor_price=_D, season=_S, units_sold=_D,
)
SALES_FILE = T.StructType([T.StructField(title, SALES[name].dataType) for title, name in SALES_HEADER.items()])

BULK_COLUMNS = (
    "store_id", "product_id", "category", "price", "inventory_level", "units_sold", "units_ordered", "discount",
    "competitor_price", "promotion", "season", "weather", "region",
)

REQUEST = _struct(
    sale_date=_S, store_id=_S, product_id=_S, category=_S, region=_S, inventory_level=_S, units_ordered=_S,
    units_sold=_S, price=_S, discount=_S, competitor_price=_S, weather=_S, promotion=_S, season=_S,
    demand_forecast=_S, user_id=_L, created_at=T.TimestampType(), request_id=_S,
)

FORECAST = T.ArrayType(_struct(date=T.DateType(), demand=_D, trend=_S))
LEGACY_FORECAST = T.MapType(_S, _D)

ALERT = _struct(type=_S, severity=_S, message=_S, details=_S, action=_S)

HISTORY = _struct(
    prediction_id=_S, user_id=_L, store_id=_S, product_id=_S, category=_S, input_data=_S, prediction_result=_S,
    demand_forecast=_D, recommended_price=_D, reorder_quantity=_D, health_score=_I, created_at=T.TimestampType(),
)

ALERT_EVENTS = _struct(
    alert_id=_S, user_id=_L, prediction_id=_S, store_id=_S, product_id=_S, alert_type=_S, severity=_S, message=_S,
    details=_S, event=_S, event_at=T.TimestampType(),
)

METRICS = _struct(
    model=_S, r2=_D, rmse=_D, mae=_D, mape=_D, wape=_D, smape=_D,
)

METRICS_FILE = T.MapType(_S, _struct(r2=_D, rmse=_D, mae=_D, weights=T.MapType(_S, _D)))

LEARN_LOG = _struct(iter=_I, rmse=_D)
TIME_LOG = _struct(iter=_I, passed=_L, remaining=_L)
