"""Training and validation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators import levels
from stockloom.operators.ordering import SEGMENT, row_position
from stockloom.operators.series import KEYS


def position_split(df: DataFrame, share: float, tie: tuple[str, ...] = (), name: str = "part") -> DataFrame:
    """``head`` for the first ``share`` of the rows in (store, product, date) order, else ``tail``; with ``position``.

    A table in segments is numbered by them, any other by series, whose sizes give the total too.
    """
    if SEGMENT in df.columns:
        placed = row_position(df, [*KEYS, "sale_date", *tie])
        # one row
        placed = placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("_total"))))
    else:
        placed = levels.positions(df, tie)
    part = F.when(F.col("position") < F.floor(F.col("_total") * share), "head").otherwise("tail")
    return placed.withColumn(name, part).drop("_total")


def date_split(df: DataFrame, share: float, name: str = "part") -> DataFrame:
    """``head`` for the earliest dates that hold ``share`` of the rows, else ``tail``. No date is on both sides."""
    # one row per calendar day
    days = df.groupBy("sale_date").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("sale_date").rowsBetween(Window.unboundedPreceding, -1)
    ranked = days.select("sale_date", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    total = days.agg(F.floor(F.sum("n") * share).alias("cut"))
    cut = ranked.crossJoin(F.broadcast(total)).filter(F.col("before") < F.col("cut")).agg(F.max("sale_date").alias("_last"))
    out = df.crossJoin(F.broadcast(cut))
    return out.withColumn(name, F.when(F.col("sale_date") <= F.col("_last"), "head").otherwise("tail")).drop("_last")
