"""Demand estimates that need no trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import no_nan, uniform

NOISE_KEY = ("store_id", "product_id", "sale_date")
FLOOR = 10.0


def _keys(df: DataFrame) -> list:
    return [F.col(c) for c in NOISE_KEY if c in df.columns]


def heuristic_demand(df: DataFrame, noise: str = "off", seed: int = 42) -> DataFrame:
    """Recent sales adjusted for price, discount and promotion; never below the floor."""
    estimate = (
        F.col("units_sold")
        * (1.0 - (F.col("price") / 100) * 0.1)
        * (1.0 + (F.col("discount") / 100) * 0.5)
        * F.when(F.col("promotion").cast("int") != 0, 1.3).otherwise(1.0)
        * uniform(_keys(df), "heuristic", 0.9, 1.1, noise, seed)
    )
    return df.withColumn("demand", F.greatest(F.lit(FLOOR), no_nan(estimate)))


def naive_demand(df: DataFrame, noise: str = "off", seed: int = 42) -> DataFrame:
    """Recent sales times a factor around 1; never below the floor."""
    estimate = F.col("units_sold") * uniform(_keys(df), "naive", 0.8, 1.2, noise, seed)
    return df.withColumn("demand", F.greatest(F.lit(FLOOR), no_nan(estimate)))
