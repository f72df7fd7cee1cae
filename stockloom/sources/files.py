"""File readers. Sales files, logs and tables have explicit schemas; uploads are read as text and cast later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom import schemas
from stockloom.session import pin
from stockloom.functions.scalar import blank_to_null
from stockloom.operators.cleanse import MALFORMED


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """A title-case sales file under the engine's column names."""
    df = spark.read.schema(schemas.SALES_FILE).csv(path, header=True, enforceSchema=False, quote='"', escape='"')
    return df.withColumnsRenamed(schemas.SALES_HEADER)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their file, the start of their split in it, and their place in the split. Quotes don't matter here."""
    lines = spark.read.text(paths, lineSep="\n")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.withColumn("place", F.monotonically_increasing_id())
    return lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, bool], list[str]]:
    """Files of an upload by their first line, and by whether any line has an odd number of quotes.

    Where none has, no field holds a line break. One line a file reaches the driver.
    """
    found: dict[tuple[str, bool], list[str]] = {}
    by_file = _lines(spark, path).groupBy("file").agg(
        F.min_by("value", F.struct("block", "place")).alias("header"), F.max(F.col("quotes") % 2 == 1).alias("odd")
    )
    for row in by_file.orderBy("file").collect():
        found.setdefault((row["header"].removesuffix("\r"), row["odd"]), []).append(row["file"])
    return found


def csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, block, seq, record``: the records of CSV files whose quoted fields may hold line breaks, headers included.

    Files are cut at their splits, and lines are put together again: a line begins a record if the quotes before it in its file are
    even. Quotes are summed by split first, so a split knows on which side of a quote it begins; what it holds of a record that began
    earlier goes to the split where that began. A task handles a split at a time, however large the file is; only a record itself must
    fit into memory. After a quote that is never closed the rest of the file is one record.
    """
    lines = _lines(spark, paths)
    in_order = Window.partitionBy("file").orderBy("block")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # one row a split
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) % 2).alias("inside"))
    in_split = Window.partitionBy("file", "block").orderBy("place")
    before = F.coalesce(F.sum("quotes").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(splits, ["file", "block"]).withColumn("begins", ((F.col("inside") + before) % 2 == 0).cast("long"))
    placed = placed.withColumn("seq", F.sum("begins").over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pieces = placed.groupBy("file", "block", "seq").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n").alias("record")
    )
    # of each split the last record that begins there, and the piece before its first one
    ends = placed.groupBy("file", "block").agg(F.max("seq").alias("last"))
    heads = ends.join(pieces.filter("seq = 0").select("file", "block", F.col("record").alias("head")), ["file", "block"], "left")
    owner = F.last(F.when(F.col("last") > 0, F.struct("block", "last")), ignorenulls=True).over(earlier)
    tails = heads.withColumn("owner", owner).filter("head is not null").groupBy("file", "owner.block", F.col("owner.last").alias("seq")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("block").alias("at"), "head"))), lambda x: x["head"]), "\n").alias("tail")
    )
    whole = pieces.filter("seq > 0").join(tails, ["file", "block", "seq"], "left")
    record = F.concat("record", F.coalesce(F.concat(F.lit("\n"), F.col("tail")), F.lit("")))
    whole = whole.select("file", "block", "seq", F.regexp_replace(record, "\r$", "").alias("record"))
    return whole.sortWithinPartitions("file", "block", "seq")


def read_bulk_csv(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files: every column text, missing-value spellings nulled.

    Columns may be absent or reordered, in each file on its own: files are read by their header and put together by name. Quotes
    inside quoted fields are doubled, and such fields may hold line breaks. The line of a row with too many or too few fields is
    kept in ``_malformed``, for the reject reason. Large files are read by many tasks, those with line breaks in fields too. A folder
    without lines gives no rows and no other column.
    """
    tables = []
    for (header, odd), paths in _headers(spark, path).items():
        if odd:
            records = csv_records(spark, paths)
            if header.count('"') % 2:  # the header goes on in the next line
                header = records.filter("block = 0 and seq = 1").agg(F.min_by("record", "file")).first()[0]
        names = spark.read.csv(spark.sparkContext.parallelize([header], 1), header=True, quote='"', escape='"', multiLine=odd).columns
        schema = ", ".join(f"`{c}` string" for c in [*names, MALFORMED])
        options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
        if odd:
            rows = records.filter("not (block = 0 and seq = 1)").filter(F.trim("record") != "")
            raw = rows.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
        else:
            raw = spark.read.schema(schema).csv(paths, header=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED)
        tables.append(raw.select(*[blank_to_null(F.trim(F.col(f"`{c}`"))).alias(c) for c in names], MALFORMED))
    if not tables:
        return spark.createDataFrame([], f"{MALFORMED} string")
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out.select(*[c for c in out.columns if c != MALFORMED], MALFORMED)


def read_requests_json(spark: SparkSession, path: str) -> DataFrame:
    """Single-record requests, one JSON object per line."""
    return spark.read.schema(schemas.REQUEST).json(path)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Model metrics stored as one JSON object keyed by model name, as rows."""
    parsed = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", schemas.METRICS_FILE)).alias("model", "m")
    )
    return parsed.select("model", "m.r2", "m.rmse", "m.mae", "m.weights")


def ensemble_weights_or_equal(metrics: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """The weights stored with the hybrid's metrics; where none are stored every model gets the same weight."""
    stored = metrics.filter(F.col("model") == "hybrid").agg(F.first("weights", ignorenulls=True).alias("stored"))
    even: Column = F.map_from_arrays(
        F.array(*map(F.lit, models)), F.array(*[F.lit(1.0 / len(models)) for _ in models])
    )
    return stored.select(F.explode(F.coalesce("stored", even)).alias("model", "weight"))


def read_training_log(spark: SparkSession, folder: str) -> DataFrame:
    """Learner log: error and elapsed/remaining time by iteration."""
    error = spark.read.schema(schemas.LEARN_LOG).csv(f"{folder}/learn_error.tsv", sep="\t", header=True)
    time = spark.read.schema(schemas.TIME_LOG).csv(f"{folder}/time_left.tsv", sep="\t", header=True)
    return error.join(time, "iter")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HISTORY).parquet(path).select(*schemas.HISTORY.names)


def read_alert_state(spark: SparkSession, path: str) -> DataFrame:
    """The current alerts of a state stream: of each alert the row of the last batch that changed it, live or not.

    A resolving event whose alert is unknown when it comes leaves a row without a raise, which any row with one replaces.
    """
    rows = _live_rows(spark, path)
    upto = _merged(spark, path)
    if upto:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*[f"{path}-merged/upto={n}/live=false" for n in upto]))
    return _latest(rows)


def live_alerts(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The state of live alerts before batch ``before``; none before the first."""
    return None if before == 0 else _latest(_live_rows(spark, path, before))


def merge_alert_batches(spark: SparkSession, path: str, upto: int, keep_days: float) -> None:
    """Merge the batches up to ``upto`` with the live table; a repeated merge writes the same tables again."""
    rows = _with_batch(_latest(_live_rows(spark, path, upto + 1), keep_batch=True), None)
    newest = rows.agg(F.max(F.greatest("created_at", "resolved_at")).alias("newest"))
    # one row
    rows = rows.crossJoin(F.broadcast(newest))
    live = ~F.col("resolved") | (F.col("resolved_at") >= F.col("newest") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(keep_days * 86400)))
    rows = pin(rows.withColumn("live", live).drop("newest"))
    for kept in (True, False):
        part = rows.filter(F.col("live") == kept).drop("live")
        part.write.mode("overwrite").parquet(f"{path}-merged/upto={upto}/live={str(kept).lower()}")
    spark.range(1).write.mode("overwrite").parquet(f"{path}-merged/upto={upto}/done")


def _live_rows(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Rows of the newest live table and of the batches after it, each with the batch that wrote it."""
    upto = max(_merged(spark, path, before), default=-1)
    rows = spark.read.parquet(path).filter(F.col("batch_id") > upto)
    rows = _with_batch(rows if before is None else rows.filter(F.col("batch_id") < before), "batch_id")
    if upto >= 0:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}-merged/upto={upto}/live=true"))
    return rows


def _with_batch(rows: DataFrame, name: str | None) -> DataFrame:
    return rows.withColumn("batch", F.col(name).cast("long")).drop(name) if name else rows


def _latest(rows: DataFrame, keep_batch: bool = False) -> DataFrame:
    fields = [c for c in rows.columns if c not in ("alert_id", "batch")]
    order = F.struct(F.col("created_at").isNotNull(), F.col("batch"))
    latest = rows.groupBy("alert_id").agg(F.max_by(F.struct(*fields), order).alias("s"), F.max("batch").alias("batch"))
    return latest.select("alert_id", "s.*", *["batch"] * keep_batch)


def _merged(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """The last batches of the complete merges (before batch ``before``), by the names of their folders."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}-merged")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("upto=")]
    done = sorted(int(p.getName()[5:]) for p in names if fs.exists(hadoop.Path(p, "done/_SUCCESS")))
    return [n for n in done if before is None or n < before]


def read_alert_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ALERT_EVENTS).parquet(path).select(*schemas.ALERT_EVENTS.names)
