"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.schemas import SALES_HEADER


def append_table(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch into its own partition folder, so that a replayed batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_sales_csv(df: DataFrame, path: str) -> None:
    """A sales table as CSV under the title-case header."""
    names = {name: title for title, name in SALES_HEADER.items() if name in df.columns}
    df.select(*names).withColumnsRenamed(names).write.csv(path, header=True, quote='"', escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header."""
    df.write.csv(path, header=True, quoteAll=True, quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def metrics_object(metrics: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The metrics of all models as one JSON object. One row: its size is the number of models."""
    rows = metrics.agg(F.sort_array(F.collect_list(F.struct("model", "r2", "rmse", "mae"))).alias("rows"))
    if weights is None:
        stored: Column = F.lit(None).cast("map<string,double>")
    else:
        by_model = F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "weight"))))
        rows, stored = rows.crossJoin(weights.agg(by_model.alias("stored"))), F.col("stored")
    entries = F.transform("rows", lambda m: F.struct(m["model"], F.struct(
        m["r2"].alias("r2"), m["rmse"].alias("rmse"), m["mae"].alias("mae"),
        F.when(m["model"] == "hybrid", stored).alias("weights"),
    )))
    return rows.select(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_metrics_json(metrics: DataFrame, path: str, weights: DataFrame | None = None) -> None:
    metrics_object(metrics, weights).coalesce(1).write.mode("overwrite").text(path)


def write_training_log(curve: DataFrame, passed: list[int], folder: str) -> None:
    """The log of a boosted learner: its error, and the milliseconds passed and presumably left, after each round.

    ``passed`` holds one number a round. The time left is that of the remaining rounds at the mean speed so far.
    """
    rounds = len(passed)
    times = [(i, int(t), int(t * (rounds - i - 1) / (i + 1))) for i, t in enumerate(passed)]
    curve.select("iter", F.col("rmse").alias("RMSE")).orderBy("iter").coalesce(1).write.csv(f"{folder}/learn_error.tsv", sep="\t", header=True)
    table = curve.sparkSession.createDataFrame(times, "iter int, Passed long, Remaining long")
    table.coalesce(1).write.csv(f"{folder}/time_left.tsv", sep="\t", header=True)
