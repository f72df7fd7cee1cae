"""Tables stored by key."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockloom.operators import dashboard, history
from stockloom.sources import layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def records(spark, start, stop):
    ids = spark.range(start, stop).withColumn("prediction_id", F.sha2(F.col("id").cast("string"), 256))
    return ids.select("prediction_id", (F.col("id") % 3).alias("user_id"), F.col("id").alias("demand_forecast"))


def files_of(path):
    return len(list(Path(path).glob("part-*")))


def test_point_read_opens_one_bucket(spark, tmp_path):
    stored = layout.write_by_key(records(spark, 0, 5000), str(tmp_path / "h"), "prediction_id", 16)
    assert files_of(tmp_path / "h") == 16
    wanted = records(spark, 77, 78).first()
    found = dashboard.report_by_id(stored, wanted.prediction_id, wanted.user_id)
    assert [tuple(r) for r in found.collect()] == [tuple(wanted)]
    assert dashboard.report_by_id(stored, "none", 1).collect() == []
    with pytest.raises(FileExistsError):
        layout.write_by_key(stored, str(tmp_path / "h"), "prediction_id", 16)
    own = found.select(F.input_file_name()).first()[0]
    for part in (tmp_path / "h").glob("part-*"):
        if not own.endswith(part.name):
            part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
            part.write_bytes(b"not read")
    assert [tuple(r) for r in dashboard.report_by_id(stored, wanted.prediction_id, wanted.user_id).collect()] == [tuple(wanted)]


def test_append_and_compact_keep_all_rows(spark, tmp_path):
    path = str(tmp_path / "h")
    layout.write_by_key(records(spark, 0, 1000), path, "prediction_id", 4)
    for run in (1, 2):
        both = layout.append_by_key(records(spark, 1000 * run, 1000 * run + 1000), path, "prediction_id", 4)
    assert both.count() == 3000 and files_of(path) == 12
    small = layout.compact_by_key(spark, path, str(tmp_path / "c"), "prediction_id", 4)
    assert files_of(tmp_path / "c") == 4 and files_of(path) == 12
    assert small.exceptAll(both).count() == 0 and small.count() == 3000
    again = layout.open_by_key(spark, str(tmp_path / "c"), "prediction_id", 4)
    one = again.filter(F.col("prediction_id") == records(spark, 2500, 2501).first().prediction_id)
    assert one.count() == 1


def test_join_by_key_without_shuffle_null_and_empty(spark, tmp_path):
    rows = records(spark, 0, 100).unionByName(records(spark, 0, 2).withColumn("prediction_id", F.lit(None).cast("string")))
    left = layout.write_by_key(rows, str(tmp_path / "l"), "prediction_id", 4)
    alerts = records(spark, 50, 150).selectExpr("prediction_id", "'a' alert_id", "'t' alert_type", "'s' severity", "'m' message", "false resolved")
    right = layout.write_by_key(alerts, str(tmp_path / "r"), "prediction_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = history.history_with_alerts(left, right)
        assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
        assert both.count() == 102 and both.filter("alert_id is not null").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    none = layout.write_by_key(rows.limit(0), str(tmp_path / "n"), "prediction_id", 4)
    assert none.collect() == []
