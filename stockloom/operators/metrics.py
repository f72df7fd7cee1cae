"""Model metrics, residual tables, ensemble weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.ordering import exact_quantile


def prediction_rows(df: DataFrame, models: Sequence[str], actual: str = "actual") -> DataFrame:
    """Predictions side by side -> one row per model."""
    return df.select(actual, *models).unpivot([actual], list(models), "model", "predicted")


def model_metrics(df: DataFrame, models: Sequence[str], actual: str = "actual") -> DataFrame:
    """R2, RMSE, MAE, MAPE, WAPE and SMAPE of each prediction column, in one pass over the rows.

    Nothing is unpivoted before the aggregation: a single wide row is aggregated and then turned into one row per model.
    """
    y = F.col(actual)
    aggregates = []
    for m in models:
        e = y - F.col(m)
        aggregates += [
            F.sum(e * e).alias(f"{m}__sse"), F.sum(F.abs(e)).alias(f"{m}__sae"),
            F.avg(F.abs(e / F.greatest(y, F.lit(1e-6)))).alias(f"{m}__ape"),
            F.avg(2 * F.abs(e) / (F.abs(y) + F.abs(F.col(m)) + 1e-8)).alias(f"{m}__sape"),
        ]
    total = df.agg(F.count(y).alias("n"), F.sum(y).alias("sum_y"), F.var_pop(y).alias("var_y"), *aggregates)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("model"),
            (1 - F.try_divide(F.col(f"{m}__sse"), F.col("var_y") * F.col("n"))).alias("r2"),
            F.sqrt(F.try_divide(F.col(f"{m}__sse"), F.col("n"))).alias("rmse"),
            F.try_divide(F.col(f"{m}__sae"), F.col("n")).alias("mae"),
            (F.col(f"{m}__ape") * 100).alias("mape"),
            (F.try_divide(F.col(f"{m}__sae"), F.col("sum_y")) * 100).alias("wape"),
            (F.col(f"{m}__sape") * 100).alias("smape"),
        )
        for m in models
    ]))
    return total.select(rows.alias("m")).select("m.*")


def wape_ratio(df: DataFrame, predicted: str, actual: str = "actual") -> DataFrame:
    """WAPE as a ratio, with a guarded denominator."""
    y = F.col(actual)
    return df.agg((F.sum(F.abs(y - F.col(predicted))) / (F.sum(F.abs(y)) + 1e-8)).alias("wape_ratio"))


def ensemble_weights(metrics: DataFrame) -> DataFrame:
    """Weights proportional to the non-negative part of R2. One row per model."""
    positive = F.greatest(F.lit(0.0), F.col("r2"))
    return metrics.select(
        "model", F.try_divide(positive, F.sum(positive).over(Window.partitionBy())).alias("weight")
    )


def clipped(df: DataFrame, predicted: str, actual: str = "actual", q: float = 0.99) -> DataFrame:
    """Both values clipped to [0, p99 of the actual values]."""
    upper = exact_quantile(df, actual, q, "upper")
    zero = F.lit(0.0)
    # one row
    return df.crossJoin(F.broadcast(upper)).withColumns({
        "actual_clipped": F.least(F.greatest(F.col(actual), zero), F.col("upper")),
        "predicted_clipped": F.least(F.greatest(F.col(predicted), zero), F.col("upper")),
    })


def residuals(df: DataFrame, predicted: str, actual: str = "actual", q: float = 0.99) -> DataFrame:
    out = clipped(df, predicted, actual, q)
    return out.withColumn("residual", F.col("actual_clipped") - F.col("predicted_clipped"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bins of each column between its smallest and largest value; the largest falls into the last bin."""
    cells = df.unpivot([], list(columns), "series", "value").filter(F.col("value").isNotNull())
    # one row per series
    bounds = cells.groupBy("series").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    placed = cells.join(F.broadcast(bounds), "series").withColumn(
        "bin",
        F.when(F.col("high") > F.col("low"), F.least(
            F.floor((F.col("value") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)).cast("int"), F.lit(bins - 1)
        )).otherwise(0),
    )
    return placed.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("rows"))


def dataset_profile(df: DataFrame, target: str = "units_sold") -> DataFrame:
    """Rows, columns, date range, and mean and deviation of the target."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min("sale_date").alias("first_date"),
        F.max("sale_date").alias("last_date"),
        F.round(F.avg(target), 6).alias("target_mean"),
        F.round(F.stddev_samp(target), 6).alias("target_std"),
    )
