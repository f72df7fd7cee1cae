"""Stacking, streaming, files, and the registered queries against their SQL."""

import csv
import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import rows_of
from checks.models import ORACLES
from stockloom.functions.values import POLICY_A
from stockloom.operators import dashboard, export, history, report, stacking
from stockloom.plans import scoring
from stockloom.plans.catalog import QUERIES
from stockloom.sources import files, sinks
from stockloom.streaming import alerts as alert_stream
from stockloom.streaming import scoring as stream

DATA = "/root/testdata/sf0.001"


def test_weighted_demand_without_weights_is_the_mean(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 6.0)], list(stacking.MODELS))
    assert stacking.weighted_demand(df, {}).first().hybrid == 3.0
    assert stacking.weighted_demand(df, {"random_forest": 0.5, "boosted_deep": 0.5}).first().hybrid == 1.5


def test_metrics_file(spark, tmp_path):
    metrics = spark.createDataFrame([("a", 0.5, 1.0, 2.0), ("hybrid", 0.6, 1.0, 2.0)], "model string, r2 double, rmse double, mae double")
    sinks.write_metrics_json(metrics, str(tmp_path / "plain"))
    stored = files.read_metrics_json(spark, str(tmp_path / "plain"))
    assert stored.filter("model = 'a'").first().r2 == 0.5
    even = files.ensemble_weights_or_equal(stored, ("a", "b", "c", "d")).collect()
    assert {r.model: r.weight for r in even} == dict.fromkeys("abcd", 0.25)
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "model string, weight double")
    sinks.write_metrics_json(metrics, str(tmp_path / "weighted"), weights)
    read = files.ensemble_weights_or_equal(files.read_metrics_json(spark, str(tmp_path / "weighted")), ("a", "b"))
    assert {r.model: r.weight for r in read.collect()} == {"a": 0.7, "b": 0.3}


def test_training_log(spark, tmp_path):
    (tmp_path / "learn_error.tsv").write_text("iter\tRMSE\n0\t1.5\n1\t1.25\n")
    (tmp_path / "time_left.tsv").write_text("iter\tPassed\tRemaining\n0\t10\t20\n1\t20\t10\n")
    rows = files.read_training_log(spark, str(tmp_path)).orderBy("iter").collect()
    assert [tuple(r) for r in rows] == [(0, 1.5, 10, 20), (1, 1.25, 20, 10)]


def test_stream_equals_batch_and_replays(spark, tmp_path):
    for day in (1, 2, 3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{day}.json").write_text(
            f'{{"sale_date":"2024-01-0{day}","store_id":"S1","product_id":"P{day}","category":"Toys","units_sold":"{day * 60}",'
            f'"price":"20","discount":"5%","promotion":"on","inventory_level":"50","user_id":1,"created_at":"2024-01-0{day}T00:00:00"}}\n')
    out = str(tmp_path / "out")

    def run():
        requests = stream.read_requests(spark, str(tmp_path / "in"), files_per_batch=1)
        stream.start_scoring(requests, out, "r", "2024-01-01", "2024-01-01 00:00:00").awaitTermination()
        return files.read_history(spark, f"{out}/history")

    first = run()
    batch = stream.score_requests(files.read_requests_json(spark, str(tmp_path / "in")), "2024-01-01", "2024-01-01 00:00:00")
    want = history.history_rows(batch, "r", created_at=F.col("created_at")).drop("prediction_id")
    assert sorted(map(str, first.drop("prediction_id").collect())) == sorted(map(str, want.collect())) and first.count() == 3
    assert run().count() == 3
    raised = files.read_alert_events(spark, f"{out}/alerts")
    assert raised.filter("alert_type = 'REORDER'").count() == 3
    events = history.resolve_events(raised.filter("product_id = 'P1'"), F.lit(datetime.datetime(2024, 2, 1)))
    sinks.append_table(raised.unionByName(events), str(tmp_path / "events"))
    alert_stream.start_alert_state(alert_stream.read_events(spark, str(tmp_path / "events")), str(tmp_path / "s")).awaitTermination()
    state = files.read_alert_state(spark, str(tmp_path / "s" / "state"))
    assert state.count() == raised.count()
    assert state.filter("resolved").select("product_id").distinct().collect()[0][0] == "P1"


def test_deep_page_equals_top_k(spark):
    rows = spark.range(500).selectExpr(
        "if(id < 400, 1, 2) user_id", "cast(id as string) prediction_id", "'S' store_id", "'P' product_id", "1.0 demand_forecast", "2.0 reorder_quantity",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 50 as int)) created_at")
    for page in (1, 7, 11):
        a = dashboard.history_page(rows, page)
        b = dashboard.history_page(rows, page, ranged=True)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_report_lines_hold_seven_days(spark):
    rows = spark.createDataFrame(
        [("S1", 'P "1", large', 60.0, 100.0, 20.0, 18.0, 10.0)],
        "store_id string, product_id string, demand double, inventory_level double, price double, competitor_price double, discount double",
    )
    scored = report.full_report(scoring.decide(rows, POLICY_A, "2024-01-01"), POLICY_A, "2024-01-01 00:00:00")
    scored = scored.withColumn("prediction_id", F.lit("x"))
    lines = export.report_lines(scored, "2024-01-02 00:00:00").orderBy("line").collect()
    daily = [(r.key, float(r.value)) for r in lines if r.section == export.SECTION_DAILY and r.key != "Date"]
    assert [d for d, _ in daily] == [f"2024-01-0{i}" for i in range(1, 8)] and daily[5][1] == 72.0
    text = export.report_csv(scored, "2024-01-02 00:00:00").first().export
    parsed = list(csv.reader(text.split("\n")))
    assert [r[2] for r in parsed if r[1] == "Product"] == ['P "1", large'] and len(parsed) == len(lines)
    assert {len(r) for r in parsed} == {5}


def test_stored_reports_of_all_forms(spark):
    texts = {
        "list": '{"demand_forecast":{"immediate_demand":5.0,"daily_forecasts":[{"date":"2024-01-01","demand":2.0,"trend":"Up"}]}}',
        "map": '{"demand_forecast":{"immediate_demand":NaN,"daily_forecasts":{"2024-01-02":3.0,"2024-01-01":2.0}},"overall_health_score":7}',
        "none": '{"demand_forecast":{"daily_forecasts":null}}', "broken": "{", "null": None,
    }
    rows = spark.createDataFrame(list(texts.items()), "prediction_id string, prediction_result string")
    got = {r.prediction_id: r for r in report.read_report(rows).collect()}
    assert [(d.demand, d.trend) for d in got["list"].forecast] == [(2.0, "Up")]
    assert [(d.demand, d.trend) for d in got["map"].forecast] == [(2.0, "Stable"), (3.0, "Up")]
    assert got["map"].report.demand_forecast.immediate_demand is None and got["map"].report.overall_health_score == 7
    assert got["none"].forecast == got["broken"].forecast == got["null"].forecast == []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", [
    "bulk_normalized", "validated", "augmented_sales", "filled_features", "past_rolling_features", "train_split", "alerts_a",
    "full_report_b", "error_report", "dashboard_counts", "residuals", "encoded_scoring", "top_products", "ordered_means", "bin_edges",
    "ridge_coefficients", "hybrid_weighted",
])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
