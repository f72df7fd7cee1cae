"""Calendar, ratio and target columns, and the one feature list shared by training and scoring."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.values import MAX_DEMAND
from stockloom.operators.series import lag_columns, rolling_columns

CATEGORICAL = ("store_id", "product_id", "category", "region", "weather", "season")
CALENDAR = ("day_of_week", "day_of_month", "month", "quarter", "year", "is_weekend")
FEATURES = (
    "store_id", "product_id", "category", "region", "inventory_level", "units_ordered", "price", "discount",
    "weather", "promotion", "competitor_price", "season",
    *CALENDAR, *lag_columns(), *rolling_columns(),
)


def calendar_features(df: DataFrame) -> DataFrame:
    """Day of week (Monday 0), day, month, quarter, year and the weekend flag of ``sale_date``."""
    weekday = F.weekday("sale_date")
    return df.withColumns({
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth("sale_date"),
        "month": F.month("sale_date"),
        "quarter": F.quarter("sale_date"),
        "year": F.year("sale_date"),
        "is_weekend": (weekday >= 5).cast("int"),
    })


def ratio_features(df: DataFrame, guard: float = 0.001) -> DataFrame:
    """Price ratio, turnover, discount effect and season flags. ``guard=0`` is the older ratio without a guard."""
    month = F.month("sale_date")
    return df.withColumns({
        "price_ratio": F.try_divide(F.col("price"), F.col("competitor_price") + guard),
        "inventory_turnover": F.try_divide(F.col("units_sold"), F.col("inventory_level") + 1),
        "discount_effectiveness": F.col("discount") * F.col("units_sold"),
        "is_holiday_season": month.isin(11, 12).cast("int"),
        "is_summer": month.isin(6, 7, 8).cast("int"),
        "sales_velocity": F.col("units_sold"),
    })


def target_log1p(units: Column) -> Column:
    """The training target: units clipped to the demand range, on the log scale."""
    return F.log1p(F.least(F.greatest(units, F.lit(0.0)), F.lit(float(MAX_DEMAND))))


def from_log1p(prediction: Column) -> Column:
    """Units from a prediction on the log scale."""
    return F.expm1(prediction)


def select_features(df: DataFrame, features: Sequence[str] = FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """The feature columns in their fixed order; an absent one is 0."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])


def clean_column_names(df: DataFrame) -> DataFrame:
    """Spaces and dashes in column names become underscores."""
    return df.toDF(*[re.sub(r"[ -]", "_", c) for c in df.columns])


def scoring_fill(df: DataFrame, lags: Sequence[int] = (1, 3, 7, 14, 30), spans: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Batch means and deviation in place of lags and rolling statistics, for requests without a past.

    The aggregate is one row.
    """
    stats = df.agg(
        F.round(F.avg("units_sold"), 9).alias("_units"), F.round(F.avg("inventory_level"), 9).alias("_inventory"),
        F.round(F.stddev_samp("units_sold"), 9).alias("_sd"),
    )
    out = df.crossJoin(F.broadcast(stats))
    names = {f"units_sold_lag_{k}": "_units" for k in lags} | {f"inventory_lag_{k}": "_inventory" for k in lags}
    names |= {f"units_sold_rolling_mean_{k}": "_units" for k in spans}
    names |= {f"units_sold_rolling_std_{k}": "_sd" for k in spans}
    return out.withColumns({name: F.col(source) for name, source in names.items()}).drop("_units", "_inventory", "_sd")
