"""Rules that a test table's own values cannot show: zeros, equal requests, reserved names, dialects, repeated alerts."""

import datetime

import pytest
from pyspark.sql import functions as F

from stockloom.functions.values import POLICY_A, POLICY_B
from stockloom.operators import features, history, ordering, series, stacking
from stockloom.plans import scoring, training
from stockloom.sources import files, sinks
from stockloom.streaming import alerts as alert_stream
from stockloom.streaming import scoring as stream

REQUEST = {
    "sale_date": "2024-01-05", "store_id": "S001", "product_id": "P1", "category": "Footwear", "region": "North",
    "inventory_level": "0", "units_ordered": "5", "units_sold": "40", "price": "20", "discount": "0", "competitor_price": "25",
    "weather": "Hot", "promotion": "0", "season": "Winter",
}


def test_offline_rules_keep_zeros_and_check_classes(spark):
    df = spark.createDataFrame([{**REQUEST, "units_sold": "many"}]).withColumn("price", F.lit(None).cast("string"))
    b = scoring.cleansed(df, POLICY_B).first()
    assert (b.inventory_level, b.discount, b.units_sold, b.price) == (0.0, 0.0, 0.0, 0.0)
    assert (b.category, b.weather, b.season) == ("Groceries", "Sunny", "Winter")
    a = scoring.cleansed(df, POLICY_A).first()
    assert (a.inventory_level, a.discount, a.category) == (100.0, 10.0, "Footwear")
    scored = scoring.analyse(spark.createDataFrame([REQUEST]), POLICY_B, "2024-01-01").first()
    assert (scored.current_inventory, scored.urgency, scored.discount) == (0.0, "HIGH", 0.0)


def test_equal_requests_are_records_of_their_own(spark, tmp_path):
    rows = [{**REQUEST, "user_id": 1}] * 3
    for n, part in enumerate((rows[:2], rows[2:])):
        sinks.write_json(spark.createDataFrame(part).coalesce(1), str(tmp_path / "in" / str(n)))
    requests = stream.read_requests(spark, str(tmp_path / "in" / "*"), 1)
    stream.start_scoring(requests, str(tmp_path / "out"), "run", "2024-01-01", "2024-01-01 00:00:00").awaitTermination()
    records = files.read_history(spark, str(tmp_path / "out" / "history"))
    assert records.count() == records.select("prediction_id").distinct().count() == 3
    assert '"inventory_level":"0"' in records.first().input_data and '"discount":"0"' in records.first().input_data
    events = files.read_alert_events(spark, str(tmp_path / "out" / "alerts"))
    state = history.alert_state(events)
    assert state.count() == events.count()
    one = history.resolve_events(events.limit(1), F.lit(datetime.datetime(2030, 1, 1)))
    assert history.alert_state(events.unionByName(one)).filter("resolved").count() == 1


def test_upload_without_dates_keeps_all_rows(spark):
    upload = spark.createDataFrame([{k: v for k, v in REQUEST.items() if k != "sale_date"}] * 4)
    rows = scoring.bulk_history(upload, "run", 3, "2024-01-01", "2024-01-01 00:00:00")
    assert rows.select("prediction_id").distinct().count() == 4 and rows.first().user_id == 3


def test_user_columns_named_like_a_segment(sales):
    mine = sales.withColumn("segment", F.lit("gold"))
    plain, ranged = series.series_features(mine), series.series_features(mine, ranged=True)
    assert plain.columns == ranged.columns and "segment" in plain.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, ranged.collect()))
    segmented = ordering.range_segments(sales, ["price"])
    with pytest.raises(ValueError):
        ordering.row_position(segmented, [*series.KEYS, "sale_date"])


def test_scoring_features_are_those_of_training(sales):
    daily = sales.dropDuplicates([*series.KEYS, "sale_date"])
    last = daily.groupBy(*series.KEYS).agg(F.max("sale_date").alias("last"))
    cut = daily.join(last, list(series.KEYS)).filter(F.col("sale_date") < F.col("last")).drop("last")
    columns = [*series.KEYS, "sale_date", *series.lag_columns(), *series.rolling_columns()]
    trained = series.series_features(daily, include_current=False).select(columns)
    scored = series.next_features(cut).select(columns)
    both = scored.join(trained, [*series.KEYS, "sale_date"], "left_semi")
    assert both.count() == scored.count() > 5
    want = trained.join(scored.select(*series.KEYS, "sale_date"), [*series.KEYS, "sale_date"], "left_semi")
    assert sorted(map(str, both.collect())) == sorted(map(str, want.select(columns).collect()))


def test_models_without_weight_are_averaged(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 6.0)], list(stacking.MODELS))
    assert stacking.weighted_demand(df, dict.fromkeys(stacking.MODELS)).first().hybrid == 3.0


def test_csv_dialect_headers_and_malformed_rows(spark, tmp_path):
    texts = ['P "x", y', "a,b", "two\nlines", 'q"']
    sinks.write_csv(spark.createDataFrame([(t, "3") for t in texts], "product_id string, price string").coalesce(1), str(tmp_path / "a"))
    assert sorted(r.product_id for r in files.read_bulk_csv(spark, str(tmp_path / "a")).collect()) == sorted(texts)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.csv").write_text('store_id,product_id,price\nS1,"P ""x"", y",5\nS1,P2,6,7\nS1,P3\n')
    (tmp_path / "b" / "2.csv").write_text("price,product_id\n9,P4\n")
    raw = files.read_bulk_csv(spark, str(tmp_path / "b"))
    got = {r.product_id: r for r in raw.collect()}
    assert (got['P "x", y'].price, got["P4"].price, got["P4"].store_id) == ("5", "9", None)
    requests = scoring.bulk_requests(raw)
    assert {r.product_id for r in scoring.accepted(requests).collect()} == {'P "x", y', "P4"}
    assert all(r["_reject_reason"].startswith("malformed row") for r in scoring.rejected(requests).collect())


def event(kind, second, severity="HIGH"):
    at = datetime.datetime(2024, 1, 1, 0, 0, second)
    return ("a1", 1, "p1", "S", "P", "REORDER", severity, "m", f"d{second}", kind, at)


def test_alert_raised_again_is_open(spark, tmp_path):
    from stockloom.schemas import ALERT_EVENTS

    batches = [[event("raise", 1)], [event("resolve", 2)], [event("raise", 3)]]
    for n, part in enumerate(batches):
        frame = spark.createDataFrame(part, ALERT_EVENTS)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        alert_stream.start_alert_state(alert_stream.read_events(spark, str(tmp_path / "events"), 1), str(tmp_path / "out")).awaitTermination()
        state = files.read_alert_state(spark, str(tmp_path / "out" / "state")).collect()
        assert [(r.resolved, r.details) for r in state] == [(n == 1, ("d1", "d1", "d3")[n])]


def test_train_save_load_score(spark, sales, tmp_path):
    table = sales.dropDuplicates([*series.KEYS, "sale_date"]).withColumns({
        "category": F.lit("Toys"), "region": F.lit("North"), "weather": F.lit("Sunny"), "season": F.lit("Winter"),
        "units_ordered": F.lit(10.0), "demand_forecast": F.lit(0.0), "discount": F.lit(5.0), "competitor_price": F.col("price") + 1,
        "promotion": F.lit("0"),
    })
    sinks.write_sales_csv(table, str(tmp_path / "sales"))
    config = stacking.TrainConfig(
        forest_trees=2, forest_depth=3, deep_rounds=2, deep_depth=2, wide_rounds=2, wide_leaves=4, encoded_rounds=2, encoded_depth=2, bins=16,
        split="position", fill=True,
    )
    trained = training.train_job(spark, str(tmp_path / "sales"), str(tmp_path / "model"), config)
    loaded = training.load(spark, str(tmp_path / "model"))
    assert loaded.config == config
    assert sorted(map(str, training.nodes(loaded, spark).collect())) == sorted(map(str, training.nodes(trained, spark).collect()))
    training.score_job(spark, str(tmp_path / "sales"), str(tmp_path / "model"), str(tmp_path / "scores"), "2024-01-01")
    got = spark.read.parquet(str(tmp_path / "scores"))
    assert got.count() == table.select(*series.KEYS).distinct().count() and got.filter("demand is null").count() == 0
    rows = features.calendar_features(series.next_features(table)).withColumn("promotion", F.lit(0))
    a = training.predict(rows, trained, combine="weights").select("demand").collect()
    assert len(a) == got.count() and all(r.demand is not None for r in a)
