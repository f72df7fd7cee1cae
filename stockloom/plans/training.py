"""The training job and scoring with its result."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions.values import POLICY_B
from stockloom.operators import encode, features, metrics, series, split, stacking, trees
from stockloom.operators.fill import fill_nulls
from stockloom.operators.ordering import SEGMENT, order_statistics, range_segments
from stockloom.operators.series import KEYS
from stockloom.operators.stacking import COLUMNS, MODELS, TARGET, TrainConfig
from stockloom.plans.scoring import analyse
from stockloom.plans.stages import Stages, Unkept, input_mark
from stockloom.session import pin
from stockloom.sources import sinks
from stockloom.sources.files import read_sales_csv


GRID_TARGET = "grid_target"


@dataclass
class Trained:
    models: dict[str, trees.Ensemble]
    edges: dict[str, list[float]]
    ridge: DataFrame
    dictionary: DataFrame
    means: DataFrame
    prior: int
    validation: DataFrame | None
    metrics: DataFrame
    config: TrainConfig


def feature_table(sales: DataFrame, config: TrainConfig, tie: tuple[str, ...] = ()) -> DataFrame:
    """Sales rows with calendar, lag and rolling features and the target.

    With ``config.fill`` nulls are filled as the reference rules do; without it, rows that lack a feature are dropped,
    and no later value reaches an earlier row. Fill and split by position need the table in segments; it is put into
    segments once, and windows, fill and positions all use the same ones.
    """
    base = features.calendar_features(sales).withColumn("promotion", F.col("promotion").cast("int"))
    base = base.withColumn(TARGET, features.target_log1p(F.col("units_sold")))
    if config.fill or config.split == "position":
        base = range_segments(base, [*KEYS, "sale_date", *tie])
    out = series.series_features(base, include_current=config.include_current, tie=tie)
    if config.fill:
        kinds = dict(out.dtypes)
        numeric = [c for c in out.columns if kinds[c] in ("double", "int", "bigint") and c not in (SEGMENT, *tie)]
        out = pin(fill_nulls(pin(out), numeric, tie))
    return out.dropna(subset=list(features.FEATURES))


def _split(df: DataFrame, share: float, config: TrainConfig, tie: tuple[str, ...], name: str) -> DataFrame:
    if config.split == "position":
        return split.position_split(df, share, tie, name).drop("position")
    return split.date_split(df, share, name)


def _steady(df: DataFrame) -> DataFrame:
    """Deviations in four digits: their last bits depend on the order in which they are summed up."""
    return df.withColumns({c: F.round(c, 4) for c in df.columns if "_std_" in c})


def bin_edges(df: DataFrame, columns: tuple[str, ...], bins: int) -> dict[str, list[float]]:
    """For each column its different values at ``bins - 1`` evenly spaced ranks."""
    n = df.count()
    ranks = sorted({n * i // bins for i in range(1, bins)}) if n else []
    return {c: sorted(set(found.values())) for c, found in order_statistics(df, dict.fromkeys(columns, ranks)).items()}


def train(sales: DataFrame, config: TrainConfig, tie: tuple[str, ...] = (), stages: Stages | Unkept | None = None) -> Trained:
    """Features, split, four base models, their metrics, and the ridge on top.

    The encoded training rows are pinned once and binned once; all models grow on them side by side. Class means of a training row
    come from rows before it in a shuffled order. Class indexes and class means are tables, not lists held by the driver. With
    ``stages`` finished stages are taken from there, the trees grown so far included.
    """
    stages = stages or Unkept()
    table = stages.table(
        "rows", lambda: _steady(_split(pin(feature_table(sales, config, tie)), config.train_share, config, tie, "part"))
    )
    dictionary = stages.table("dictionary", lambda: encode.label_dictionary(table))
    table = table.withColumn(GRID_TARGET, trees.on_grid(F.col(TARGET)))
    head = table.filter(F.col("part") == "head")
    prior = stages.value("prior", lambda: _prior(head))
    sums = encode.target_sums(head, GRID_TARGET)
    mean = encode.smoothed_mean(F.col("s"), F.col("n"), F.lit(float(prior)))
    means = stages.table("means", lambda: sums.select("column", "label", mean.alias("target_mean")))
    fit_rows = stages.table("fit_rows", lambda: _fit_rows(head, dictionary, prior, (*encode.ROW_KEY, *tie)))
    edges = stages.value("edges", lambda: bin_edges(fit_rows, COLUMNS, config.bins))
    binned = fit_rows.select("hash", "target", trees.binned(COLUMNS, edges).alias("bins"))
    models = {e.learner.name: e for e in _fitted(binned, config, edges, stages)}

    validation_rows = stages.table("validation", lambda: _validation(table, means, prior, dictionary, models, edges, config, tie))
    meta = validation_rows.filter(F.col("meta_part") == "head")
    ridge = stages.table("ridge", lambda: stacking.ridge(meta, MODELS, "actual", config.ridge_alpha))
    validation = stacking.with_ridge(validation_rows, ridge, MODELS).drop(SEGMENT)
    table_of_metrics = stages.table("metrics", lambda: metrics.model_metrics(validation, (*MODELS, "hybrid")))
    return Trained(models, edges, ridge, dictionary, means, prior, validation, table_of_metrics, config)


def _prior(head: DataFrame) -> int:
    first = head.agg(F.sum(GRID_TARGET), F.count(GRID_TARGET)).first()
    return math.floor(first[0] / first[1] + 0.5) if first[1] else 0


def _fit_rows(head: DataFrame, dictionary: DataFrame, prior: int, keys: tuple[str, ...]) -> DataFrame:
    rows = encode.ordered_means(head.withColumn("hash", trees.row_hash(keys)), GRID_TARGET, float(prior), keys=keys)
    return encode.encode(rows, dictionary).select("hash", F.col(GRID_TARGET).alias("target"), *COLUMNS)


def _fitted(binned: DataFrame, config: TrainConfig, edges: dict[str, list[float]], stages: Stages | Unkept) -> list[trees.Ensemble]:
    """The base learners; with kept stages the trees so far are written from time to time, and a new start goes on from them."""
    learners = stacking.base_learners(config)
    if isinstance(stages, Unkept):
        return trees.fit(binned, learners, COLUMNS, config.bins)
    spark = binned.sparkSession
    sizes = sorted((s for s in range(1, sum(lr.trees for lr in learners) + 1) if stages.finished(f"trees-{s}")), reverse=True)
    known: list[trees.Ensemble] = []
    if sizes:
        base = stages.value("bases", dict)
        known = trees.from_nodes(stages.table(f"trees-{sizes[0]}", lambda: binned), learners, COLUMNS, base, edges)

    def write(so_far: list[trees.Ensemble]) -> None:
        stages.value("bases", lambda: {e.learner.name: e.base for e in so_far})
        stages.table(f"trees-{sum(len(e.trees) for e in so_far)}", lambda: trees.node_table(spark, so_far, edges))

    return trees.fit(binned, learners, COLUMNS, config.bins, known=known, each=write)


def _validation(
    table: DataFrame, means: DataFrame, prior: int, dictionary: DataFrame, models: dict[str, trees.Ensemble], edges: dict[str, list[float]],
    config: TrainConfig, tie: tuple[str, ...],
) -> DataFrame:
    """Held-out rows with the models' estimates, split for the ridge."""
    tail = encode.with_target_means(table.filter(F.col("part") == "tail"), means, float(prior))
    tail = tail.withColumns({f"_{c}": F.col(c) for c in features.CATEGORICAL})
    tail = _restored(_estimates(encode.encode(tail, dictionary), models, edges))
    tail = tail.withColumn("actual", features.from_log1p(F.col(TARGET)))
    return _split(pin(tail), config.meta_share, config, tie, "meta_part")


def _estimates(df: DataFrame, models: dict[str, trees.Ensemble], edges: dict[str, list[float]]) -> DataFrame:
    """Each model's prediction in units, beside the ``bins`` it is made from."""
    out = df.withColumn("bins", trees.binned(COLUMNS, edges))
    out = trees.with_predictions(out, list(models.values()), "bins", len(COLUMNS))
    return out.withColumns({name: features.from_log1p(F.col(name)) for name in models})


def nodes(trained: Trained, spark: SparkSession) -> DataFrame:
    """All trees as a table of nodes."""
    return trees.node_table(spark, list(trained.models.values()), trained.edges)


def save(trained: Trained, path: str, spark: SparkSession) -> None:
    """Models, class tables and metrics under one folder."""
    nodes(trained, spark).write.mode("overwrite").parquet(f"{path}/nodes")
    trained.ridge.write.mode("overwrite").parquet(f"{path}/ridge")
    trained.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    trained.means.write.mode("overwrite").parquet(f"{path}/means")
    trained.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    weights = metrics.ensemble_weights(trained.metrics.filter(F.col("model") != "hybrid"))
    sinks.write_metrics_json(trained.metrics, f"{path}/metrics_json", weights)
    settings = json.dumps({
        "features": list(features.FEATURES), "models": list(MODELS), "config": asdict(trained.config), "edges": trained.edges,
        "prior": trained.prior, "base": {name: e.base for name, e in trained.models.items()},
    })
    spark.createDataFrame([(settings,)], "value string").write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Trained:
    settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
    config = TrainConfig(**settings["config"])
    models = trees.from_nodes(spark.read.parquet(f"{path}/nodes"), stacking.base_learners(config), COLUMNS, settings["base"], settings["edges"])
    return Trained(
        {e.learner.name: e for e in models}, settings["edges"], spark.read.parquet(f"{path}/ridge"), spark.read.parquet(f"{path}/dictionary"),
        spark.read.parquet(f"{path}/means"), settings["prior"], None, spark.read.parquet(f"{path}/metrics"), config,
    )


def predict(requests: DataFrame, trained: Trained, combine: str = "ridge") -> DataFrame:
    """Model demand for rows that carry the features; an absent feature is 0, an unseen class the first one."""
    rows = features.select_features(
        requests.withColumns({f"_{c}": F.col(c) for c in features.CATEGORICAL}),
        keep=("sale_date", "units_sold", *[f"_{c}" for c in features.CATEGORICAL]),
    ).fillna(0.0)
    rows = encode.with_target_means(_steady(rows), trained.means, float(trained.prior))
    scored = _estimates(encode.encode(rows, trained.dictionary), trained.models, trained.edges).drop("bins")
    if combine == "ridge":
        scored = stacking.with_ridge(scored, trained.ridge, MODELS)
    else:
        scored = stacking.weighted_by(scored, metrics.ensemble_weights(trained.metrics.filter(F.col("model") != "hybrid")), MODELS)
    return _restored(scored).withColumn("demand", F.col("hybrid"))


def _restored(df: DataFrame) -> DataFrame:
    """Classes in place of their indexes."""
    return df.withColumns({c: F.col(f"_{c}") for c in features.CATEGORICAL}).drop(*[f"_{c}" for c in features.CATEGORICAL])


def score_latest(sales: DataFrame, trained: Trained, as_of: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Decisions of the offline rules from model demand, for each store and product.

    Models trained without a row's own sales in its features estimate the day after the latest one; models trained with them
    (``include_current``) can only be given the latest day itself.
    """
    if trained.config.include_current:
        latest = series.latest_features(sales, tie)
    else:
        latest = series.next_features(sales, tie)
    latest = features.calendar_features(latest)
    latest = latest.withColumn("promotion", F.col("promotion").cast("int"))
    confidence = trained.metrics.filter(F.col("model") == "hybrid").first()["r2"]
    return analyse(predict(latest, trained), POLICY_B, as_of, demand_model="given", confidence=confidence)


def train_job(spark: SparkSession, sales_path: str, out: str, config: TrainConfig) -> Trained:
    """Train on a sales file and save everything that scoring needs.

    Stages are kept under ``out``, in a folder named after the settings and the state of the input files: a job that is started
    again with the same ones goes on where the last one ended.
    """
    stages = Stages(spark, f"{out}/stages/{input_mark(spark, sales_path, asdict(config))}")
    trained = train(read_sales_csv(spark, sales_path), config, stages=stages)
    save(trained, out, spark)
    return trained


def score_job(spark: SparkSession, sales_path: str, model_path: str, out: str, as_of: str) -> None:
    """Score a sales file with saved models and write the decisions."""
    scored = score_latest(read_sales_csv(spark, sales_path), load(spark, model_path), as_of)
    scored.drop("forecast").write.mode("overwrite").parquet(out)
