"""Rows of the prediction history and of the alert tables, and the current state of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import round_half_even
from stockloom.operators.alerts import alert_lines

REORDER_MESSAGE = "Reorder needed for "
KEPT_SEVERITIES = ("HIGH", "MEDIUM")


def row_id(run_id: str, *parts: Column) -> Column:
    """A repeatable key: a rerun of the same job gives the same ids."""
    return F.sha2(F.concat_ws("_", F.lit(run_id), *[p.cast("string") for p in parts]), 256)


def prediction_id(scored: DataFrame, run_id: str) -> Column:
    """The key of a scored request: of its ``request_id``, if it has one, else of its store, product and date.

    Requests that may be equal, of a stream or an upload, need ``request_id``; see :func:`with_request_id`.
    """
    parts = ("request_id",) if "request_id" in scored.columns else ("store_id", "product_id", "sale_date")
    return row_id(run_id, *map(F.col, parts))


def with_request_id(requests: DataFrame, source: str) -> DataFrame:
    """Number the rows of one source (a file, a micro-batch), so that equal requests stay apart.

    The number is the row's place in its input split: a repeated task gives the same. Ids that the requests bring along stay.
    """
    number = F.concat(F.lit(f"{source}#"), F.monotonically_increasing_id().cast("string"))
    given = [F.col("request_id")] if "request_id" in requests.columns else []
    return requests.withColumn("request_id", F.coalesce(*given, number))


def history_rows(
    scored: DataFrame, run_id: str, request: str = "request", created_at: Column | None = None
) -> DataFrame:
    """One history row per scored row: request and report as JSON text, the figures asked for later as columns.

    ``scored`` carries ``user_id``, ``sale_date``, ``report``, the decision columns and ``request``, a struct of the fields as they
    came in, before any cleansing. The health score is stored as a
    column, so that reading it never parses a report.
    """
    return scored.select(
        prediction_id(scored, run_id).alias("prediction_id"),
        "user_id", "store_id", "product_id", "category",
        F.to_json(request, {"ignoreNullFields": "false"}).alias("input_data"),
        F.to_json("report").alias("prediction_result"),
        round_half_even(F.col("demand"), 2).alias("demand_forecast"),
        "recommended_price",
        F.col("order_quantity").alias("reorder_quantity"),
        "health_score",
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def alert_rows(scored: DataFrame, run_id: str, created_at: Column | None = None) -> DataFrame:
    """A REORDER alert where urgency is high or medium, and each business alert of high or medium severity.

    The result holds ``raise`` events; alerts are never updated in place.
    """
    reorder = F.when(F.col("urgency").isin(*KEPT_SEVERITIES), F.struct(
        F.lit("REORDER").alias("type"), F.col("urgency").alias("severity"),
        F.concat(F.lit(REORDER_MESSAGE), F.col("product_id")).alias("message"),
        F.col("reorder_reasoning").alias("details"), F.col("reorder_action").alias("action"),
    ))
    kept = F.filter("alerts", lambda a: a["severity"].isin(*KEPT_SEVERITIES))
    keep = ("user_id", "prediction_id", "store_id", "product_id", "event_at")
    rows = scored.select(
        "user_id", "store_id", "product_id",
        prediction_id(scored, run_id).alias("prediction_id"),
        F.concat(F.array_compact(F.array(reorder)), kept).alias("alerts"),
        (F.current_timestamp() if created_at is None else created_at).alias("event_at"),
    )
    return alert_lines(rows, keep).select(
        F.sha2(F.concat_ws("_", "prediction_id", "type"), 256).alias("alert_id"),
        "user_id", "prediction_id", "store_id", "product_id",
        F.col("type").alias("alert_type"), "severity", "message", "details",
        F.lit("raise").alias("event"), "event_at",
    )


def resolve_events(alerts: DataFrame, resolved_at: Column) -> DataFrame:
    """The events that resolve the given alerts."""
    return alerts.select(
        *[c for c in alerts.columns if c not in ("event", "event_at")],
        F.lit("resolve").alias("event"), resolved_at.alias("event_at"),
    )


def alert_state(events: DataFrame) -> DataFrame:
    """Current alerts from their events: the latest event decides, of equal times the resolving one.

    An alert that is raised again is open again, with the text and time of its latest raise. An aggregate, so the events of one
    alert are combined before the shuffle.
    """
    fields = ("user_id", "prediction_id", "store_id", "product_id", "alert_type", "severity", "message", "details")
    state = events.groupBy("alert_id").agg(
        F.max(F.when(F.col("event") == "raise", F.struct(F.col("event_at").alias("at"), *fields))).alias("r"),
        F.max(F.when(F.col("event") == "resolve", F.col("event_at"))).alias("done_at"),
    )
    closed = F.coalesce(F.col("done_at") >= F.col("r.at"), F.col("done_at").isNotNull())
    return state.select(
        "alert_id", *[F.col(f"r.{c}") for c in fields], closed.alias("resolved"), F.col("r.at").alias("created_at"),
        F.when(closed, F.col("done_at")).alias("resolved_at"),
    )


def state_events(state: DataFrame) -> DataFrame:
    """The events that lead to the given states: a raise, and a resolving event for each alert that is resolved."""
    fields = ("alert_id", "user_id", "prediction_id", "store_id", "product_id", "alert_type", "severity", "message", "details")
    raised = state.filter("created_at is not null").select(*fields, F.lit("raise").alias("event"), F.col("created_at").alias("event_at"))
    done = state.filter("resolved_at is not null").select(*fields, F.lit("resolve").alias("event"), F.col("resolved_at").alias("event_at"))
    return raised.unionByName(done)


def history_with_alerts(history: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each prediction with its alerts; predictions without alerts stay."""
    columns = ["prediction_id", "alert_id", "alert_type", "severity", "message", "resolved"]
    return history.join(alerts.select(*[c for c in columns if c in alerts.columns]), "prediction_id", "left")
