"""A training job that dies and is started again."""

import pytest
from pyspark.sql import functions as F

from stockloom.operators import encode, series, stacking, trees
from stockloom.plans import training
from stockloom.plans.stages import Stages, input_mark
from stockloom.sources import sinks

CONFIG = stacking.TrainConfig(
    forest_trees=2, forest_depth=3, deep_rounds=3, deep_depth=2, wide_rounds=3, wide_leaves=4, encoded_rounds=3, encoded_depth=2, bins=16
)


@pytest.fixture
def sales_file(spark, sales, tmp_path):
    table = sales.dropDuplicates([*series.KEYS, "sale_date"]).withColumns({
        "category": F.lit("Toys"), "region": F.lit("North"), "weather": F.lit("Sunny"), "season": F.lit("Winter"),
        "units_ordered": F.lit(10.0), "demand_forecast": F.lit(0.0), "discount": F.lit(5.0), "competitor_price": F.col("price") + 1,
        "promotion": F.lit("0"),
    })
    sinks.write_sales_csv(table, str(tmp_path / "sales"))
    return str(tmp_path / "sales")


def test_job_goes_on_where_it_died(spark, sales_file, tmp_path, monkeypatch):
    whole = training.train_job(spark, sales_file, str(tmp_path / "whole"), CONFIG)
    monkeypatch.setattr(trees, "KEEP_ROUNDS", 1)
    monkeypatch.setattr(trees.fit, "__defaults__", (trees.CELLS, 1, (), None))
    table, written = Stages.table, []

    def dying(self, name, make):
        if name.startswith("trees-") and not self.finished(name):
            if len(written) == 2:
                raise RuntimeError("lost")
            written.append(name)
        return table(self, name, make)

    out = str(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(Stages, "table", dying)
        with pytest.raises(RuntimeError, match="lost"):
            training.train_job(spark, sales_file, out, CONFIG)
    assert len(written) == 2

    calls = []
    fit = trees.fit
    monkeypatch.setattr(trees, "fit", lambda *a, **k: (calls.append(sum(len(e.trees) for e in k["known"])), fit(*a, **k))[1])
    monkeypatch.setattr(encode, "ordered_means", None)
    monkeypatch.setattr(training, "feature_table", None)
    resumed = training.train_job(spark, sales_file, out, CONFIG)
    assert calls == [int(written[-1].removeprefix("trees-"))] and calls[0] > 0
    assert sorted(map(str, training.nodes(resumed, spark).collect())) == sorted(map(str, training.nodes(whole, spark).collect()))
    assert sorted(map(str, resumed.ridge.collect())) == sorted(map(str, whole.ridge.collect()))

    # a third start finds everything
    monkeypatch.setattr(stacking, "ridge", None)
    training.train_job(spark, sales_file, out, CONFIG)


def test_stage_without_marker_is_made_again(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "s"))
    spark.range(3).write.parquet(str(tmp_path / "s" / "tables" / "t"))  # died before the marker
    assert stages.table("t", lambda: spark.range(5)).count() == 5
    assert stages.table("t", lambda: spark.range(9)).count() == 5
    assert stages.value("v", lambda: {"a": [1.5, None]}) == stages.value("v", lambda: 0) == {"a": [1.5, None]}


def test_mark_follows_input_and_settings(spark, tmp_path):
    spark.range(5).coalesce(1).write.csv(str(tmp_path / "in"))
    first = input_mark(spark, str(tmp_path / "in"), {"a": 1})
    assert first == input_mark(spark, str(tmp_path / "in"), {"a": 1}) != input_mark(spark, str(tmp_path / "in"), {"a": 2})
    spark.range(5).coalesce(1).write.mode("append").csv(str(tmp_path / "in"))
    assert first != input_mark(spark, str(tmp_path / "in"), {"a": 1})
