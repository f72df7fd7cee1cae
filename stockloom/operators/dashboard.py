"""Read path: per-user counts, latest rows and pages, for all users in one job.

Latest-row queries rank within a user and keep the first k. Spark applies that limit before the shuffle, so a user with
a very long history sends k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.ordering import group_position

PAGE = 10


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("prediction_id")]


def latest_per_user(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def recent_predictions(history: DataFrame, n: int = 5) -> DataFrame:
    return latest_per_user(
        history.select("user_id", "prediction_id", "store_id", "product_id", "demand_forecast", "recommended_price",
                       "reorder_quantity", "created_at"),
        n, _newest_first(),
    )


def open_alerts(state: DataFrame) -> DataFrame:
    return state.filter(~F.col("resolved"))


def recent_alerts(state: DataFrame, n: int = 5) -> DataFrame:
    """The latest open alerts of each user, details cut to a preview."""
    rows = open_alerts(state).select(
        "user_id", "alert_id", "alert_type", "severity", "product_id", "message",
        F.concat(F.left("details", F.lit(60)), F.lit("...")).alias("preview"), "created_at",
    )
    return latest_per_user(rows, n, [F.col("created_at").desc(), F.col("alert_id")])


def newest_open_alerts(state: DataFrame, n: int = 10) -> DataFrame:
    """The latest open alerts of each user, as the alert service lists them."""
    rows = open_alerts(state).select(
        "user_id", F.col("alert_id").alias("id"), F.col("alert_type").alias("type"), "severity", "message", "details",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "store_id", "product_id",
    )
    return latest_per_user(rows, n, [F.col("created_at").desc(), F.col("id")])


def history_page(history: DataFrame, page: int, per_page: int = PAGE, ranged: bool = False) -> DataFrame:
    """Page ``page`` of each user's history, newest first, with its bounds and the number of pages.

    A top-k by default, whose state is all rows up to the page. ``ranged`` finds the page by range positions instead: for pages so
    deep that the rows before them are too many for one task.
    """
    first, last = (page - 1) * per_page + 1, page * per_page
    rows = history.select("user_id", "prediction_id", "store_id", "product_id", "demand_forecast", "reorder_quantity", "created_at")
    if not ranged:
        page_rows = latest_per_user(rows, last, _newest_first()).filter(F.col("rank") >= first)
    else:
        aged = rows.withColumn("_age", -F.unix_micros(F.col("created_at").cast("timestamp")))
        placed = group_position(aged, ["user_id"], ["_age", "prediction_id"], "rank").drop("_age")
        page_rows = placed.withColumn("rank", (F.col("rank") + 1).cast("int")).filter(F.col("rank").between(first, last))
    totals = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return page_rows.join(totals, "user_id").withColumns({
        "from_row": F.lit(first),
        "to_row": F.least(F.lit(last).cast("long"), F.col("total")),
        "pages": F.ceil(F.col("total") / per_page),
    })


def history_summary(page_rows: DataFrame) -> DataFrame:
    """High-demand rows, rows to reorder and the latest date, by user."""
    return page_rows.groupBy("user_id").agg(
        F.count_if(F.col("demand_forecast") > 100).alias("high_demand_items"),
        F.count_if(F.col("reorder_quantity") > 0).alias("reorder_recommendations"),
        F.date_format(F.max("created_at"), "MM/dd").alias("last_analysis"),
    )


def dashboard_counts(history: DataFrame, state: DataFrame) -> DataFrame:
    """Predictions, open alerts, high-demand and reorder counts by user. Both sides are reduced before the join."""
    predictions = history.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("demand_forecast") > 100).alias("high_demand_products"),
        F.count_if(F.col("reorder_quantity") > 0).alias("reorder_recommendations"),
    )
    alerts = open_alerts(state).groupBy("user_id").agg(F.count(F.lit(1)).alias("active_alerts"))
    return predictions.join(alerts, "user_id", "left").fillna(0, ["active_alerts"])


def report_by_id(history: DataFrame, prediction_id: str, user_id: int) -> DataFrame:
    """One user's record, or no row."""
    return history.filter((F.col("prediction_id") == prediction_id) & (F.col("user_id") == user_id))
