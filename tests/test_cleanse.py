"""Rounding, parsing, defaults and quarantine."""

import random

from pyspark.sql import functions as F

from stockloom.functions import scalar
from stockloom.operators import cleanse, demand
from stockloom.plans import scoring
from stockloom.sources import files


def test_round_matches_python(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1e5, 1e5) for _ in range(2000)]
    values += [round(rng.uniform(0, 1000), 3) for _ in range(3000)] + [i + 0.5 for i in range(-20, 20)]
    values += [2.675, 0.125, 74.05, 75.115, 73.305, 1.005, 0.0, -0.0, 1e15 + 0.5, 123456789.125]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        got = df.select("v", scalar.round_half_even(F.col("v"), digits).alias("r")).collect()
        assert [repr(r.r) for r in got] == [repr(float(round(r.v, digits))) for r in got]
    small = [v for v in values if 0 < v < 1e9]
    df = spark.createDataFrame([(v,) for v in small], "v double")
    got = df.select("v", scalar.fixed_text(F.col("v"), 1).alias("t"), scalar.float_text(F.col("v")).alias("f")).collect()
    assert [r.t for r in got] == [f"{r.v:.1f}" for r in got]
    assert [r.f for r in got] == [repr(r.v) for r in got]


def test_number_and_flags(spark):
    texts = ["12", " 12.5 ", "1e3", "abc", "", None, "1.0d", "12%", ".5", "-3.", "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalar.number(F.col("t"))).collect()] == [
        12.0, 12.5, 1000.0, None, None, None, None, None, 0.5, -3.0, None]
    assert df.select(scalar.percent(F.col("t"), F.lit(10.0))).collect()[7][0] == 12.0
    flags = spark.createDataFrame([("Yes",), ("yes",), ("1",), (None,)], "t string")
    assert [r[0] for r in flags.select(scalar.flag(F.col("t"), ("1", "yes"))).collect()] == [0, 1, 1, 0]


def test_upload_defaults_and_quarantine(spark, tmp_path):
    (tmp_path / "up.csv").write_text(
        "store_id,product_id,price,inventory_level,units_sold,discount,competitor_price,promotion,weather\n"
        ",,,,,,,,\n"
        "S1,P1,abc,10,5,0,20,1,Hot\n"
        "S1,P2,1500,12.9,40,12,,0,Hot\n"
    )
    raw = files.read_bulk_csv(spark, str(tmp_path / "up.csv"))
    requests = scoring.bulk_requests(raw)
    blank = requests.filter("store_id = 'UNKNOWN'").first()
    assert (blank.product_id, blank.category, blank.season, blank.price, blank.inventory_level) == ("UNKNOWN", "General", "Normal", 50.0, 100)
    assert (blank.competitor_price, blank.units_sold, blank.discount, blank.promotion) == (50.0, 0, 0.0, 0)
    assert [r._reject_reason for r in scoring.rejected(requests).collect()] == ["price: abc"]
    good = demand.heuristic_demand(cleanse.validate(scoring.accepted(requests)))
    rows = {r.product_id: r for r in good.collect()}
    assert rows["UNKNOWN"].units_sold == 40.0 and rows["UNKNOWN"].discount == 10.0
    assert rows["P2"].inventory_level == 12.0 and rows["P2"].competitor_price == 1500.0
    assert rows["P2"].demand == 10.0
    errors = scoring.rejected_reports(requests, "2024-01-01", "2024-01-01 00:00:00").first().report
    assert errors.business_alerts[0].details == "price: abc" and len(errors.demand_forecast.daily_forecasts) == 30


def test_zero_inventory(spark):
    df = spark.createDataFrame([(0.0, float("nan"), "abc")], "inventory_level double, units_sold double, price string")
    strict = cleanse.validate(df).first()
    assert (strict.inventory_level, strict.units_sold, strict.price) == (100.0, 40.0, 30.0)
    assert cleanse.validate(df, zero_is_missing=False).first().inventory_level == 0.0


def test_domains(spark):
    df = spark.createDataFrame([("Footwear", "North"), ("Toys", None)], "category string, region string")
    assert [tuple(r) for r in cleanse.check_domains(df).collect()] == [("Groceries", "North"), ("Toys", "North")]
