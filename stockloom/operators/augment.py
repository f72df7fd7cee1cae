"""Synthetic sales and controlled noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import flag, normal, round_half_even, uniform
from stockloom.functions.values import SALES_FLAGS
from stockloom.operators.lookup import lookup_join

PRICE_SENSITIVITY = -0.08
PROMOTION_LIFT = 1.4
LATE_MONTHS = (10, 11, 12)
LATE_LIFT, EARLY_LIFT = 1.2, 0.95
NOISE_KEY = ("store_id", "product_id", "sale_date")


def product_mean_demand(df: DataFrame) -> DataFrame:
    """Mean units sold by product. Rounded, so that it does not depend on the order of summation."""
    return df.groupBy("product_id").agg(F.round(F.avg("units_sold"), 9).alias("mean_units_sold"))


def synthetic_sales(df: DataFrame, noise: str = "off", flags: Sequence[str] = SALES_FLAGS, seed: int = 42) -> DataFrame:
    """A rule-based copy of the sales table: units from the product's mean, price, promotion and month.

    The mean price is one row; the product means are joined as their size allows.
    """
    mean_price = df.agg(F.round(F.avg("price"), 9).alias("_mean_price"))
    out = lookup_join(df, product_mean_demand(df), ["product_id"], spread=["sale_date", "store_id"])
    out = out.crossJoin(F.broadcast(mean_price))
    units = (
        F.col("mean_units_sold")
        * F.exp(PRICE_SENSITIVITY * (F.col("price") - F.col("_mean_price")))
        * F.when(flag(F.col("promotion"), flags) == 1, PROMOTION_LIFT).otherwise(1.0)
        * F.when(F.month("sale_date").isin(*LATE_MONTHS), LATE_LIFT).otherwise(EARLY_LIFT)
        * normal([F.col(c) for c in NOISE_KEY], "synthetic", 0.15, noise, seed)
    )
    return out.withColumn("units_sold", F.greatest(F.lit(1.0), F.floor(units).cast("double"))).select(*df.columns)


def augment_sales(df: DataFrame, noise: str = "off", **options) -> DataFrame:
    """Real and synthetic rows, told apart by ``source`` (0 real, 1 synthetic), which also orders equal dates."""
    real = df.withColumn("source", F.lit(0))
    return real.unionByName(synthetic_sales(df, noise, **options).withColumn("source", F.lit(1)))


def noisy_sales(df: DataFrame, noise: str = "keyed", seed: int = 42) -> DataFrame:
    """Units with day-to-day noise, weaker or stronger discounts, and rare demand shocks.

    The shock rows are drawn by a hash of their key: the sample is the same under any partitioning.
    """
    keys = [F.col(c) for c in NOISE_KEY]
    shocked = uniform(keys, "shock", 0.0, 1.0, "keyed", seed) < 0.02
    units = (
        F.col("units_sold")
        * normal(keys, "daily", 0.15, noise, seed)
        * F.when(F.col("discount") > 0, uniform(keys, "discount", 0.7, 1.2, noise, seed)).otherwise(1.0)
        * F.when(shocked, uniform(keys, "size", 1.3, 2.0, noise, seed)).otherwise(1.0)
    )
    return df.withColumn("units_sold", round_half_even(F.greatest(F.lit(0.0), units), 0).cast("int"))
