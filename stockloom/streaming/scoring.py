"""Requests as a stream: the batch scoring plan on each micro-batch, appended to history and alert tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockloom import schemas
from stockloom.functions.scalar import flag
from stockloom.functions.values import FORM_FLAGS, POLICY_A
from stockloom.operators.cleanse import request_date
from stockloom.operators.history import alert_rows, history_rows, with_request_id
from stockloom.plans.scoring import analyse_with_report
from stockloom.sources.sinks import write_batch

INPUT_COLUMNS = tuple(c for c in schemas.REQUEST.names if c not in ("user_id", "created_at", "request_id"))


def read_requests(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON request files as a stream."""
    reader = spark.readStream.schema(schemas.REQUEST)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def score_requests(requests: DataFrame, as_of: str, analysed_at: str, noise: str = "off") -> DataFrame:
    """The stateless part: request text to decisions. The same plan for a batch and for a stream."""
    rows = requests.withColumn("request", F.struct(*INPUT_COLUMNS)).withColumns({
        "discount": F.replace("discount", F.lit("%"), F.lit("")),
        "promotion": flag(F.col("promotion"), FORM_FLAGS),
    })
    return analyse_with_report(request_date(rows, as_of), POLICY_A, as_of, analysed_at, noise=noise)


def start_scoring(
    requests: DataFrame, out: str, run_id: str, as_of: str, analysed_at: str, noise: str = "off", available_now: bool = True
) -> StreamingQuery:
    """Write history and alert rows of each micro-batch.

    Each batch goes into folders named by its number, so a batch that runs again after a failure replaces what it wrote. Rows are
    numbered within their batch: equal requests, of one batch or of several, are predictions of their own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = with_request_id(batch, f"batch-{batch_id}")
        scored = score_requests(numbered, as_of, analysed_at, noise).persist()
        created = F.coalesce(F.col("created_at"), F.current_timestamp())
        write_batch(history_rows(scored, run_id, created_at=created), f"{out}/history", batch_id)
        write_batch(alert_rows(scored, run_id, created), f"{out}/alerts", batch_id)
        scored.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
