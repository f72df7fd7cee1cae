"""The registered queries: one per operator, each over the whole tables of a test data folder.

Dates and times are shown as ISO text and inexact aggregates are rounded, so that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions import scalar
from stockloom.functions.values import FORM_FLAGS, POLICIES, POLICY_A, POLICY_B, SALES_FLAGS, SCRIPT_FLAGS, Policy
from stockloom.operators import (
    alerts, augment, cleanse, dashboard, demand, encode, export, features, fill, forecast, history, metrics, ordering,
    pricing, reorder, report, series, split, stacking, trees,
)
from stockloom.plans import scoring, training
from stockloom.schemas import SALES_HEADER
from stockloom.session import pin, scratch_path
from stockloom.sources import files, layout, sinks
from stockloom.sources.tables import raw_requests, retail_fact
from stockloom.streaming import alerts as alert_stream
from stockloom.streaming import scoring as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-01"
ANALYSED_AT = "2024-01-01 00:00:00"
EXPORTED_AT = "2024-01-02 00:00:00"
RUN_ID = "run1"
ROW = ("sale_date", "store_id", "product_id")
INPUTS = (
    "sale_date", "store_id", "product_id", "category", "region", "inventory_level", "units_ordered", "units_sold",
    "price", "discount", "competitor_price", "weather", "promotion", "season",
)
NAIVE_MODELS = {
    "last_day": "units_sold_lag_1", "last_week": "units_sold_lag_7",
    "mean_week": "units_sold_rolling_mean_7", "mean_month": "units_sold_rolling_mean_30",
}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = lambda spark, sf_dir: shown(run(spark, sf_dir))
    return run


def shown(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text."""
    formats = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss"}
    return df.select([F.date_format(c, formats[k]).alias(c) if k in formats else F.col(c) for c, k in df.dtypes])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def joined(values: Column) -> Column:
    return F.concat_ws(",", F.transform(values, lambda v: v.cast("string")))


# --- inputs shared by several queries ---


def _decided(spark: SparkSession, sf_dir: str, policy: Policy, **options) -> DataFrame:
    return scoring.analyse(retail_fact(spark, sf_dir), policy, AS_OF, **options)


def _reported(spark: SparkSession, sf_dir: str, policy: Policy = POLICY_A, sales: DataFrame | None = None) -> DataFrame:
    """Scored sales with report, user and prediction id: one user per store, created on the sale date."""
    requests = (retail_fact(spark, sf_dir) if sales is None else sales).withColumn("request", F.struct(*INPUTS))
    scored = scoring.analyse_with_report(requests, policy, AS_OF, ANALYSED_AT)
    return scored.withColumns({
        "user_id": F.substr("store_id", F.lit(2)).cast("bigint") - 1,
        "prediction_id": history.row_id(RUN_ID, *[F.col(c) for c in ("store_id", "product_id", "sale_date")]),
    })


def _history(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    return history.history_rows(_reported(spark, sf_dir, sales=sales), RUN_ID, created_at=F.col("sale_date").cast("timestamp"))


def _alert_events(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    """Raised alerts, those of medium severity resolved a day later. The raised ones are pinned: every event is read from them."""
    raised = pin(history.alert_rows(_reported(spark, sf_dir, sales=sales), RUN_ID, F.col("sale_date").cast("timestamp")))
    medium = raised.filter(F.col("severity") == "MEDIUM")
    return raised.unionByName(history.resolve_events(medium, F.col("event_at") + F.expr("INTERVAL 1 DAY")))


def _alert_state(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    return history.alert_state(_alert_events(spark, sf_dir, sales))


def _naive_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units sold next to four fixed predictions made of earlier sales and rolling means."""
    table = series.series_features(retail_fact(spark, sf_dir), lags=(1, 7), spans=(7, 30), stats=("mean",))
    return table.dropna(subset=list(NAIVE_MODELS.values())).select(
        *ROW, F.col("units_sold").alias("actual"), *[F.col(c).alias(m) for m, c in NAIVE_MODELS.items()]
    )


_SALES: dict[tuple[str, str], DataFrame] = {}
_TRAINED: dict[tuple[str, str], training.Trained] = {}


def _training_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales fact that models are trained on and score, derived once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SALES:
        _SALES[key] = pin(retail_fact(spark, sf_dir))
    return _SALES[key]


def _trained(spark: SparkSession, sf_dir: str) -> training.Trained:
    """Small models of the sales fact, trained once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = training.train(_training_sales(spark, sf_dir), stacking.QUICK)
    return _TRAINED[key]


# --- sources ---


@query
def scan_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sales-csv")
    sinks.write_sales_csv(retail_fact(spark, sf_dir).withColumn("demand_forecast", F.col("units_sold")).select(
        *SALES_HEADER.values()), path)
    return files.read_sales_csv(spark, path).orderBy(*ROW)


@query
def scan_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bulk-csv")
    sinks.write_csv(raw_requests(spark, sf_dir), path)
    return files.read_bulk_csv(spark, path).drop(cleanse.MALFORMED)


@query
def scan_bulk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload whose rows have a quoted field of two lines."""
    path = scratch_path(spark, "bulk-csv")
    note = F.concat("region", F.lit('\nordered "'), "units_ordered", F.lit('"'))
    sinks.write_csv(raw_requests(spark, sf_dir).withColumn("note", note), path)
    return files.read_bulk_csv(spark, path).select(*ROW, "units_ordered", "note", cleanse.MALFORMED).withColumnRenamed(cleanse.MALFORMED, "malformed")


@query
def model_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.model_metrics(_naive_predictions(spark, sf_dir), list(NAIVE_MODELS))
    table = pin(table)
    weights = metrics.ensemble_weights(table)
    hybrid = table.orderBy("model").limit(1).withColumn("model", F.lit("hybrid"))
    path = scratch_path(spark, "metrics-json")
    sinks.write_metrics_json(table.unionByName(hybrid), path, weights)
    return rounded(files.ensemble_weights_or_equal(files.read_metrics_json(spark, path), tuple(NAIVE_MODELS)))


@query
def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "history")
    sinks.append_table(_history(spark, sf_dir), path)
    return files.read_history(spark, path).drop("input_data", "prediction_result")


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "stream")
    requests = retail_fact(spark, sf_dir).withColumns({
        "user_id": F.substr("store_id", F.lit(2)).cast("bigint") - 1,
        "created_at": F.col("sale_date").cast("timestamp"), "request_id": F.concat_ws("|", *ROW),
    })
    sinks.write_json(requests, f"{folder}/requests")
    running = stream.start_scoring(
        stream.read_requests(spark, f"{folder}/requests"), f"{folder}/out", RUN_ID, AS_OF, ANALYSED_AT
    )
    running.awaitTermination()
    return files.read_history(spark, f"{folder}/out/history").drop("input_data", "prediction_result")


@query
def training_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the boosted learner with both penalties on the log target after each round, on the validation rows."""
    trained = _trained(spark, sf_dir)
    curve = trees.learning_curve(
        trained.validation, trained.models["boosted_deep"], "bins", training.GRID_TARGET, len(stacking.COLUMNS)
    )
    return rounded(curve)


@query
def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same errors out of the learner's log file, and whether its times pass and run out as they should."""
    trained, folder = _trained(spark, sf_dir), scratch_path(spark, "training-log")
    deep = trained.models["boosted_deep"]
    curve = trees.learning_curve(trained.validation, deep, "bins", training.GRID_TARGET, len(stacking.COLUMNS))
    sinks.write_training_log(curve, deep.passed, folder)
    log = files.read_training_log(spark, folder)
    # one row a round
    earlier = F.coalesce(F.lag("passed").over(Window.orderBy("iter")), F.lit(0))
    left = F.floor(F.col("passed") * (len(deep.passed) - F.col("iter") - 1) / (F.col("iter") + 1)).cast("long")
    return rounded(log.select(
        "iter", "rmse", (F.col("passed") >= earlier).alias("time_passes"), (F.col("remaining") == left).alias("time_runs_out")
    ))


# --- sinks and exports ---


@query
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@query
def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.alert_rows(_reported(spark, sf_dir), RUN_ID, F.col("sale_date").cast("timestamp"))


@query
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pin(metrics.model_metrics(_naive_predictions(spark, sf_dir), list(NAIVE_MODELS)))
    path = scratch_path(spark, "metrics-json")
    sinks.write_metrics_json(table, path, metrics.ensemble_weights(table))
    return rounded(files.read_metrics_json(spark, path).drop("weights"))


@query
def export_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.report_json(_reported(spark, sf_dir), EXPORTED_AT)


@query
def export_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.report_csv(_reported(spark, sf_dir), EXPORTED_AT)


@query
def export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.history_json(_history(spark, sf_dir).drop("health_score"))


@query
def export_history_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.history_csv(_history(spark, sf_dir))


@query
def export_history_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.history_heads(_history(spark, sf_dir), EXPORTED_AT)


@query
def export_history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.history_csv_lines(_history(spark, sf_dir), EXPORTED_AT)


@query
def report_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reports read back from their JSON text, every second one with its forecasts as a date -> value map."""
    rows = _history(spark, sf_dir).select("prediction_id", "prediction_result", F.dayofmonth("created_at").alias("day"))
    parsed = report.read_report(rows)
    legacy = F.map_from_entries(F.transform("forecast", lambda d: F.struct(d["date"].cast("string"), d["demand"])))
    older = F.struct(
        "report.product_info", F.struct(
            "report.demand_forecast.immediate_demand", "report.demand_forecast.total_30day_forecast",
            "report.demand_forecast.confidence_score", legacy.alias("daily_forecasts"),
        ).alias("demand_forecast"), "report.overall_health_score", "report.business_alerts",
    )
    stored = parsed.select("prediction_id", F.when(F.col("day") % 2 == 0, F.to_json(older)).otherwise(F.col("prediction_result"))
                           .alias("prediction_result"))
    return report.read_report(stored).select(
        "prediction_id", "report.product_info.store_id", "report.demand_forecast.immediate_demand",
        "report.demand_forecast.total_30day_forecast", "report.overall_health_score",
        joined(F.col("forecast.date")).alias("dates"), joined(F.col("forecast.demand")).alias("demands"),
        F.concat_ws(",", "forecast.trend").alias("trends"), F.concat_ws(",", "report.business_alerts.type").alias("alert_types"),
    )


@query
def report_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.report_metrics_long(_reported(spark, sf_dir), ("prediction_id",))


@query
def bulk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = scoring.bulk_requests(_upload(spark, sf_dir, numbered=True), keep=("sale_date", "request_id"))
    scored = scoring.analyse(scoring.accepted(requests), POLICY_A, AS_OF)
    return scoring.bulk_results(scored, RUN_ID, ("sale_date",))


@query
def bulk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows of an upload: every accepted row a record of its own, with the text it came as."""
    rows = scoring.bulk_history(_upload(spark, sf_dir, numbered=True), RUN_ID, 1, AS_OF, ANALYSED_AT, ("sale_date",))
    return rows.drop("prediction_result", "created_at")


# --- cleansing and projections ---


def _upload(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """The raw requests as the bulk reader returns them."""
    raw = raw_requests(spark, sf_dir, numbered)
    return raw.select([scalar.blank_to_null(F.trim(c)).alias(c) for c in raw.columns])


@query
def bulk_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.map_bulk_columns(_upload(spark, sf_dir).drop("weather"))


@query
def bulk_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bulk_requests(_upload(spark, sf_dir), keep=("sale_date",)).withColumnRenamed(cleanse.REJECT, "reject_reason")


@query
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_requests(spark, sf_dir)
    late = F.substr("sale_date", F.lit(9), F.lit(2)) == "13"
    dated = raw.withColumn("sale_date", F.when(~late, F.col("sale_date")).otherwise("someday"))
    return cleanse.request_date(cleanse.validate(dated), AS_OF).drop("promotion")


@query
def parse_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_requests(spark, sf_dir)
    return raw.select(*ROW, "discount", scalar.percent(F.col("discount"), F.lit(10.0)).alias("discount_percent"))


@query
def parse_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_requests(spark, sf_dir)
    spellings = {"form_flag": FORM_FLAGS, "script_flag": SCRIPT_FLAGS, "sales_flag": SALES_FLAGS}
    return raw.select(*ROW, "promotion", *[scalar.flag(F.col("promotion"), s).alias(n) for n, s in spellings.items()])


@query
def domain_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse.check_domains(raw_requests(spark, sf_dir)).select("sale_date", "category", "region", "weather", "season")


@query
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.calendar_features(retail_fact(spark, sf_dir)).select(*ROW, *features.CALENDAR)


@query
def ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.ratio_features(retail_fact(spark, sf_dir))
    older = features.ratio_features(out.withColumnRenamed("price_ratio", "guarded_ratio"), guard=0)
    return older.select(
        *ROW, "guarded_ratio", "price_ratio", "inventory_turnover", "discount_effectiveness", "is_holiday_season",
        "is_summer", "sales_velocity",
    )


@query
def target_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retail_fact(spark, sf_dir).select(*ROW, features.target_log1p(F.col("units_sold")).alias("target"))
    return rounded(out.withColumn("units", features.from_log1p(F.col("target"))))


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = series.series_features(features.calendar_features(retail_fact(spark, sf_dir)))
    table = table.dropna(subset=list(features.FEATURES))
    encoded = encode.encode(table, encode.label_dictionary(retail_fact(spark, sf_dir)))
    target = features.target_log1p(F.col("units_sold")).alias("target")
    return rounded(features.select_features(encoded.withColumn("target", target), keep=("sale_date", "target")))


@query
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = {name: title for title, name in SALES_HEADER.items()}
    return features.clean_column_names(retail_fact(spark, sf_dir).withColumnsRenamed(titles))


@query
def forecast_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forecasts in their three forms: list, date -> value map, neither."""
    stored = _decided(spark, sf_dir, POLICY_B).withColumn("form", F.dayofmonth("sale_date") % 3)
    as_map = F.map_from_entries(F.transform("forecast", lambda d: F.struct(d["date"].cast("string"), d["demand"])))
    stored = stored.withColumns({
        "as_list": F.when(F.col("form") == 0, F.col("forecast")), "as_map": F.when(F.col("form") == 1, as_map),
    })
    return _days(forecast.normalize_forecast(stored, "as_list", "as_map"))


def _days(df: DataFrame) -> DataFrame:
    return df.select(
        *ROW, joined(F.col("forecast.date")).alias("dates"), joined(F.col("forecast.demand")).alias("demands"),
        F.concat_ws(",", "forecast.trend").alias("trends"),
    )


# --- joins and augmentation ---


@query
def augmented_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.augment_sales(retail_fact(spark, sf_dir), noise="keyed").select(*ROW, "price", "source", "units_sold")


@query
def noisy_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.noisy_sales(retail_fact(spark, sf_dir)).select(*ROW, "units_sold")


@query
def keyed_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col(c) for c in ("store_id", "product_id", "sale_date")]
    return rounded(retail_fact(spark, sf_dir).select(
        *ROW, scalar.uniform(keys, "u", 0.0, 1.0, "keyed").alias("uniform"),
        scalar.normal(keys, "n", 1.0, "keyed").alias("normal"),
    ), 9)


@query
def product_mean_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(augment.product_mean_demand(retail_fact(spark, sf_dir)))


@query
def label_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.label_dictionary(retail_fact(spark, sf_dir))


@query
def encoded_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = retail_fact(spark, sf_dir)
    return encode.encode(fact, encode.label_dictionary(fact)).select("sale_date", *features.CATEGORICAL, "units_sold")


@query
def encoded_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = encode.label_dictionary(retail_fact(spark, sf_dir))
    requests = raw_requests(spark, sf_dir).select("sale_date", *features.CATEGORICAL)
    return encode.encode(requests, dictionary, suffix="_index")


@query
def unseen_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = encode.label_dictionary(retail_fact(spark, sf_dir))
    return encode.unseen_categories(raw_requests(spark, sf_dir), dictionary)


@query
def history_with_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined_rows = history.history_with_alerts(_history(spark, sf_dir), _alert_state(spark, sf_dir))
    return joined_rows.drop("input_data", "prediction_result")


# --- aggregates ---


@query
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dataset_profile(retail_fact(spark, sf_dir))


@query
def forecast_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = forecast.daily_forecast(
        demand.heuristic_demand(scoring.cleansed(retail_fact(spark, sf_dir), POLICY_B)), POLICY_B, AS_OF
    )
    return rounded(forecast.forecast_totals(scored).select(*ROW, "total_30day", "lead_time_demand"))


@query
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.model_metrics(_naive_predictions(spark, sf_dir), list(NAIVE_MODELS)))


@query
def wape_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.wape_ratio(_naive_predictions(spark, sf_dir), "mean_week"))


@query
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ensemble_weights(metrics.model_metrics(_naive_predictions(spark, sf_dir), list(NAIVE_MODELS))))


@query
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.residuals(_naive_predictions(spark, sf_dir), "mean_week")
    return rounded(out.select(*ROW, "actual_clipped", "predicted_clipped", "residual"))


@query
def demand_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = metrics.clipped(_naive_predictions(spark, sf_dir), "last_day")
    return metrics.histogram(clipped, ("actual_clipped", "predicted_clipped"))


@query
def scoring_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.scoring_fill(retail_fact(spark, sf_dir))
    return rounded(out.select(*ROW, "units_sold_lag_30", "inventory_lag_1", "units_sold_rolling_mean_7", "units_sold_rolling_std_14"))


# --- windows ---


@query
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_features(retail_fact(spark, sf_dir), spans=()).select(*ROW, *series.lag_columns())


@query
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.series_features(retail_fact(spark, sf_dir), lags=()).select(*ROW, *series.rolling_columns()))


@query
def past_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling statistics that leave the row's own value out, by ranges as for a series too long for one task."""
    out = series.series_features(retail_fact(spark, sf_dir), include_current=False, ranged=True)
    return rounded(out.select(*ROW, *series.lag_columns(), *series.rolling_columns()))


@query
def filled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*series.lag_columns(), *series.rolling_columns()]
    return rounded(fill.fill_nulls(series.series_features(retail_fact(spark, sf_dir)), columns).select(*ROW, *columns))


@query
def series_filled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = series.lag_columns()
    return fill.fill_nulls(series.series_features(retail_fact(spark, sf_dir), spans=()), columns, scope="series").select(*ROW, *columns)


@query
def sales_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.sales_velocity(retail_fact(spark, sf_dir))
    return rounded(out.select(*ROW, "sales_velocity_7d", "sales_velocity_30d"))


@query
def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.latest_features(retail_fact(spark, sf_dir))
    return rounded(out.select(*ROW, *series.lag_columns(), *series.rolling_columns()))


@query
def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = split.position_split(pin(retail_fact(spark, sf_dir)), 0.8)
    out = split.date_split(out, 0.8, "date_part")
    return out.select(*ROW, "position", "part", "date_part")


@query
def augmented_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags over the augmented table, whose rows come in pairs of equal date: the source breaks the tie."""
    table = augment.augment_sales(retail_fact(spark, sf_dir))
    out = series.series_features(table, lags=(1, 2, 7), spans=(7,), stats=("mean",), tie=("source",))
    return rounded(out.select(
        *ROW, "source", "units_sold_lag_1", "units_sold_lag_2", "inventory_lag_7", "units_sold_rolling_mean_7"
    ))


# --- decisions ---


@query
def demand_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = demand.heuristic_demand(cleanse.validate(retail_fact(spark, sf_dir)), noise="keyed")
    return out.select(*ROW, "demand")


@query
def demand_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.naive_demand(cleanse.validate(retail_fact(spark, sf_dir)), noise="keyed").select(*ROW, "demand")


def _forecast_query(policy: Policy) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = demand.heuristic_demand(scoring.cleansed(retail_fact(spark, sf_dir), policy))
        return _days(forecast.daily_forecast(rows, policy, AS_OF, noise="keyed"))

    run.__name__ = f"forecast_{policy.name.lower()}"
    return run


@query
def forecast_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(_decided(spark, sf_dir, POLICY_A)).drop("demands")


@query
def forecast_first7(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _decided(spark, sf_dir, POLICY_A).withColumn("forecast", forecast.first_days(F.col("forecast")))
    return first.select(*ROW, F.posexplode_outer("forecast").alias("day", "d")).select(
        *ROW, "day", F.col("d.date").alias("forecast_date"), F.col("d.demand").alias("forecast_demand")
    )


def _columns_query(name: str, policy: Policy, columns: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _decided(spark, sf_dir, policy).select(*ROW, *columns)

    run.__name__ = name
    return run


_PRICING = ("recommended_discount", "pricing_strategy", "pricing_reasoning", "recommended_price")
_IMPACT = ("volume_change", "revenue_change", "old_revenue", "new_revenue")
_REORDER = (
    "current_inventory", "days_of_supply", "reorder_point", "order_quantity", "urgency", "reorder_action",
    "reorder_reasoning",
)

for _policy in POLICIES.values():
    _suffix = _policy.name.lower()
    _own = "safety_stock" if _policy is POLICY_A else "lead_time_demand"
    query(_forecast_query(_policy))
    query(_columns_query(f"pricing_{_suffix}", _policy, _PRICING))
    query(_columns_query(f"reorder_{_suffix}", _policy, (*_REORDER, _own)))
    query(_columns_query(f"health_{_suffix}", _policy, ("health_score",)))
query(_columns_query("price_impact", POLICY_A, _IMPACT))
query(_columns_query("price_impact_b", POLICY_B, _IMPACT))
query(_columns_query("stockout_date", POLICY_B, ("stockout_date",)))
query(_columns_query("health_band", POLICY_A, ("health_score", "health_band")))


@query
def eoq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand.heuristic_demand(cleanse.validate(retail_fact(spark, sf_dir)))
    return rows.select(
        *ROW, reorder.economic_order_quantity(F.col("demand"), F.col("price")).alias("eoq_a"),
        reorder.economic_order_quantity(F.col("demand"), F.col("price"), POLICY_B.order_cap_days).alias("eoq_b"),
        reorder.economic_order_quantity(F.col("demand"), F.lit(0.0)).alias("eoq_free"),
    )


def _second_opinion(spark: SparkSession, sf_dir: str, of_a: Column) -> DataFrame:
    """Decisions of policy B on the requests as they came in, next to a column of policy A's."""
    requests = retail_fact(spark, sf_dir).withColumn("request", F.struct(*INPUTS))
    return scoring.analyse(scoring.analyse(requests, POLICY_A, AS_OF).select("request.*", of_a), POLICY_B, AS_OF)


@query
def stockout_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules_b = _second_opinion(spark, sf_dir, F.col("stockout_risk").alias("risk_a"))
    return rules_b.select(*ROW, "risk_a", F.col("stockout_risk").alias("risk_b"))


@query
def alerts_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_lines(_decided(spark, sf_dir, POLICY_A), ROW)


@query
def alerts_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_lines(_decided(spark, sf_dir, POLICY_B), ROW)


@query
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules_b = _second_opinion(spark, sf_dir, F.concat_ws("; ", "actions").alias("plan_a"))
    return rules_b.select(*ROW, "plan_a", F.concat_ws("; ", "actions").alias("plan_b"))


def _flat_report(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    r = "report."
    return df.select(
        *keep, r + "product_info.*", r + "demand_forecast.immediate_demand", r + "demand_forecast.total_30day_forecast",
        r + "demand_forecast.confidence_score", r + "pricing_strategy.current_price", r + "pricing_strategy.current_discount",
        r + "pricing_strategy.recommended_price", r + "pricing_strategy.recommended_discount",
        F.col(r + "pricing_strategy.pricing_strategy").alias("strategy"),
        r + "pricing_strategy.expected_impact.*", r + "inventory_management.current_inventory",
        r + "inventory_management.days_of_supply", r + "inventory_management.reorder_point",
        r + "inventory_management.recommended_order_quantity", r + "inventory_management.reorder_urgency",
        r + "inventory_management.reorder_action", r + "inventory_management.stockout_risk",
        F.concat_ws(",", r + "business_alerts.type").alias("alert_types"),
        F.concat_ws(",", r + "business_alerts.details").alias("alert_details"),
        r + "overall_health_score",
    )


@query
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_report(_reported(spark, sf_dir), ("sale_date",))


@query
def full_report_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_report(_reported(spark, sf_dir, POLICY_B), ("sale_date",))


@query
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = scoring.bulk_requests(_upload(spark, sf_dir), keep=("sale_date",))
    return _flat_report(scoring.rejected_reports(requests, AS_OF, ANALYSED_AT), ("sale_date",))


# --- read path ---


@query
def recent_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.recent_predictions(_history(spark, sf_dir))


@query
def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.recent_alerts(_alert_state(spark, sf_dir))


@query
def open_alerts_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.newest_open_alerts(_alert_state(spark, sf_dir))


@query
def alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_state(spark, sf_dir)


@query
def alert_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert state kept by a stream of several batches: all raises first, the resolving events after them."""
    folder = scratch_path(spark, "alert-stream")
    events = _alert_events(spark, sf_dir)
    for event in ("raise", "resolve"):
        sinks.append_table(events.filter(F.col("event") == event).repartition("alert_id"), f"{folder}/events")
        stream_of = alert_stream.read_events(spark, f"{folder}/events")
        alert_stream.start_alert_state(stream_of, f"{folder}/out", compact_every=2).awaitTermination()
    return files.read_alert_state(spark, f"{folder}/out/state")


@query
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.history_page(_history(spark, sf_dir), page=2)


@query
def history_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.history_page(_history(spark, sf_dir), page=60, ranged=True)


@query
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the second page of each user's history, as the page shows it."""
    return dashboard.history_summary(dashboard.history_page(_history(spark, sf_dir), page=2))


@query
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = pin(retail_fact(spark, sf_dir))
    return dashboard.dashboard_counts(_history(spark, sf_dir, sales), _alert_state(spark, sf_dir, sales))


@query
def report_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record with the smallest id, found by its id and user in a stored history bucketed by id."""
    stored = layout.write_by_key(_history(spark, sf_dir), scratch_path(spark, "history-by-id"), "prediction_id")
    key = stored.agg(F.min(F.struct("prediction_id", "user_id")).alias("k")).first()["k"]
    return dashboard.report_by_id(stored, key["prediction_id"], key["user_id"]).drop("input_data", "prediction_result")


@query
def stored_history_with_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored prediction with its stored alerts: both tables are bucketed by prediction, so that no row is shuffled."""
    sales = pin(retail_fact(spark, sf_dir))
    predictions = layout.write_by_key(_history(spark, sf_dir, sales), scratch_path(spark, "history-by-id"), "prediction_id")
    raised = layout.write_by_key(_alert_state(spark, sf_dir, sales), scratch_path(spark, "alerts-by-id"), "prediction_id")
    return history.history_with_alerts(predictions, raised).drop("input_data", "prediction_result")


@query
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_products(_decided(spark, sf_dir, POLICY_A))


# --- trained models ---


@query
def ordered_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class means of rows that come earlier in a shuffled order, for the log target on its grid."""
    rows = retail_fact(spark, sf_dir)
    rows = rows.withColumn("grid_target", trees.on_grid(features.target_log1p(F.col("units_sold"))))
    out = encode.ordered_means(rows, "grid_target", float(trees.GRID))
    return rounded(out.select(*ROW, *[(F.col(f"{c}_mean") / trees.GRID).alias(f"{c}_mean") for c in features.CATEGORICAL]))


@query
def bin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the bins that learners would cut some columns of the fact into."""
    columns = ("inventory_level", "price", "competitor_price", "units_sold")
    edges = training.bin_edges(retail_fact(spark, sf_dir), columns, 64)
    rows = [(c, i, v) for c, found in edges.items() for i, v in enumerate(found)]
    return rounded(spark.createDataFrame(rows, "feature string, bin int, edge double"), 9)


@query
def model_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trained trees."""
    return rounded(training.nodes(_trained(spark, sf_dir), spark).drop("gain"))


@query
def stacked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation rows with the estimate of every trained model and of the hybrid."""
    return rounded(_trained(spark, sf_dir).validation.select(*ROW, "actual", *stacking.MODELS, "hybrid"), 4)


@query
def stacking_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridge over the four trained models."""
    return rounded(stacking.ridge_coefficients(_trained(spark, sf_dir).ridge, stacking.MODELS), 5)


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed predictions and their mean, weighted by R2."""
    rows = pin(_naive_predictions(spark, sf_dir))
    weights = metrics.ensemble_weights(metrics.model_metrics(rows, list(NAIVE_MODELS)))
    return stacking.weighted_by(rows, weights, NAIVE_MODELS)


@query
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_weighted(spark, sf_dir).select(*ROW, "actual", "hybrid"), 4)


@query
def ridge_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge over the four fixed predictions."""
    return rounded(stacking.ridge_coefficients(stacking.ridge(_naive_predictions(spark, sf_dir), tuple(NAIVE_MODELS), "actual", 1.0), tuple(NAIVE_MODELS)), 5)


@query
def trained_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the fixed predictions and of their weighted mean."""
    return rounded(metrics.model_metrics(_weighted(spark, sf_dir), [*NAIVE_MODELS, "hybrid"]), 5)


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 features of the forest that gain most."""
    shares = trees.importance(training.nodes(_trained(spark, sf_dir), spark).filter("model = 'random_forest'")).drop("model")
    return rounded(shares.orderBy(F.col("importance").desc(), "feature").limit(15))


@query
def sample_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows in date order, actual next to predicted."""
    rows = _naive_predictions(spark, sf_dir).select(*ROW, "actual", F.col("mean_week").alias("predicted"))
    return rounded(rows.orderBy(*ROW).limit(200))


@query
def demand_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = training.score_latest(_training_sales(spark, sf_dir), _trained(spark, sf_dir), AS_OF)
    return rounded(scored.select(*ROW, "demand", "total_30day", "order_quantity", "urgency", "health_score"), 3)


@query
def saved_model_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from models that were saved and loaded again."""
    folder = scratch_path(spark, "models")
    training.save(_trained(spark, sf_dir), folder, spark)
    scored = training.score_latest(_training_sales(spark, sf_dir), training.load(spark, folder), AS_OF)
    return rounded(scored.select(*ROW, "demand", "total_30day", "order_quantity", "urgency", "health_score"), 3)


@query
def meta_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out rows: the first half of their dates fits the ridge, the rest measures it."""
    return _trained(spark, sf_dir).validation.select(*ROW, "meta_part")
