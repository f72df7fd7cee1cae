"""Alert life cycle as a stream: events in, the current state of the touched alerts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockloom import schemas
from stockloom.operators.history import alert_state, state_events
from stockloom.sources import files
from stockloom.sources.sinks import write_batch


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Alert event files as a stream; folders of single batches below ``path`` are included."""
    reader = spark.readStream.schema(schemas.ALERT_EVENTS).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def start_alert_state(
    events: DataFrame, out: str, available_now: bool = True, keep_days: float = 30.0, compact_every: int = 50
) -> StreamingQuery:
    """Write the changed alerts of each micro-batch: its events on top of what the state table holds of the alerts they touch.

    The table is the only state, so nothing is held in memory between batches, and a replayed batch writes the same rows again. Each
    batch is a folder of its own. Every ``compact_every`` batches they are merged: live alerts (open, or resolved less than ``keep_days``
    before the newest event) into one table, those that have ceased to be live into a table that is never rewritten. A batch reads the
    live table and the batches since. An event of an alert that is no longer live starts anew: a raise opens it, a resolving event
    changes nothing. ``files.read_alert_state`` reads all alerts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        live = files.live_alerts(spark, f"{out}/state", batch_id)
        if live is not None:
            known = state_events(live.join(batch.select("alert_id").distinct(), "alert_id", "left_semi"))
            batch = batch.unionByName(known.select(*batch.columns))
        write_batch(alert_state(batch), f"{out}/state", batch_id)
        if (batch_id + 1) % compact_every == 0:
            files.merge_alert_batches(spark, f"{out}/state", batch_id, keep_days)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
