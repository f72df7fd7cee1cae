"""The four base learners, and the ridge that stacks their predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.operators.features import CATEGORICAL, FEATURES
from stockloom.operators.trees import Learner

TARGET = "target"
MODELS = ("random_forest", "boosted_deep", "boosted_wide", "boosted_encoded")
ENCODED_FEATURES = tuple(f"{c}_mean" if c in CATEGORICAL else c for c in FEATURES)
#: Every column that a learner reads, in the order of the binned row.
COLUMNS = (*FEATURES, *(f"{c}_mean" for c in CATEGORICAL))


@dataclass(frozen=True)
class TrainConfig:
    """Sizes of the learners. The defaults are those of the surveyed rules; ``QUICK`` suits a test."""

    forest_trees: int = 200
    forest_depth: int = 15
    deep_rounds: int = 800
    deep_depth: int = 12
    wide_rounds: int = 1000
    wide_leaves: int = 128
    encoded_rounds: int = 800
    encoded_depth: int = 10
    bins: int = 64
    seed: int = 42
    split: str = "date"
    train_share: float = 0.8
    meta_share: float = 0.5
    include_current: bool = False
    fill: bool = False
    ridge_alpha: float = 1.0


QUICK = TrainConfig(
    forest_trees=8, forest_depth=5, deep_rounds=5, deep_depth=4, wide_rounds=5, wide_leaves=8, encoded_rounds=5, encoded_depth=4, bins=32
)


def base_learners(config: TrainConfig) -> list[Learner]:
    """A forest; boosting by levels with both penalties; boosting best leaf first; boosting by symmetric levels on class means."""
    seed = config.seed
    return [
        Learner("random_forest", FEATURES, config.forest_trees, config.forest_depth, boosted=False, least_leaf=2, least_split=5, seed=seed),
        Learner(
            "boosted_deep", FEATURES, config.deep_rounds, config.deep_depth, rate=0.03, l1=0.1, l2=1.5, row_share=0.9, feature_share=0.9,
            seed=seed,
        ),
        Learner(
            "boosted_wide", FEATURES, config.wide_rounds, 32, "leaf", config.wide_leaves, rate=0.03, l2=1.0, row_share=0.9, feature_share=0.9,
            least_leaf=20, seed=seed,
        ),
        Learner("boosted_encoded", ENCODED_FEATURES, config.encoded_rounds, config.encoded_depth, "symmetric", rate=0.05, l2=3.0, seed=seed),
    ]


def weighted_demand(df: DataFrame, weights: dict[str, float], name: str = "hybrid") -> DataFrame:
    """Weighted sum of the models' predictions; the plain mean if no model has a weight."""
    weights = {m: w for m, w in weights.items() if w is not None}
    if not weights:
        return df.withColumn(name, sum((F.col(m) for m in MODELS), F.lit(0.0)) / len(MODELS))
    return df.withColumn(name, sum((F.col(m) * w for m, w in weights.items() if m in df.columns), F.lit(0.0)))


def weighted_by(df: DataFrame, weights: DataFrame, models: Sequence[str], name: str = "hybrid") -> DataFrame:
    """The same with weights from a table ``model, weight``: a row for each model."""
    wide = weights.agg(*[F.max(F.when(F.col("model") == m, F.col("weight"))).alias(f"_w_{m}") for m in models])
    # one row
    out = df.crossJoin(F.broadcast(wide))
    none = F.coalesce(*[F.col(f"_w_{m}") for m in models]).isNull()
    total = sum((F.col(m) * F.coalesce(F.col(f"_w_{m}"), F.lit(0.0)) for m in models), F.lit(0.0))
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    return out.withColumn(name, F.when(none, mean).otherwise(total)).drop(*[f"_w_{m}" for m in models])


def ridge(df: DataFrame, inputs: Sequence[str], label: str, alpha: float) -> DataFrame:
    """Ridge regression with an unpenalised intercept: one row, ``intercept`` and a column ``k_<input>`` for each input.

    The centred products of all inputs come from one aggregate; the system is solved by a Cholesky factor, an entry a column.
    """
    k = range(len(inputs))
    n = F.count(F.lit(1))
    named = {f"_a{i}_{j}": F.covar_pop(inputs[i], inputs[j]) * n + (alpha if i == j else 0.0) for i in k for j in range(i + 1)}
    named |= {f"_b{i}": F.covar_pop(inputs[i], label) * n for i in k} | {f"_m{i}": F.avg(inputs[i]) for i in k} | {"_y": F.avg(label)}
    out = df.agg(*[c.alias(name) for name, c in named.items()])

    def taken(start: Column, terms: Sequence[Column]) -> Column:
        for t in terms:
            start = start - t
        return start

    for i in k:  # one projection an entry, so that no expression holds another's text
        for j in range(i + 1):
            rest = taken(F.col(f"_a{i}_{j}"), [F.col(f"_l{i}_{p}") * F.col(f"_l{j}_{p}") for p in range(j)])
            out = out.withColumn(f"_l{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"_l{j}_{j}"))
        out = out.withColumn(f"_z{i}", taken(F.col(f"_b{i}"), [F.col(f"_l{i}_{p}") * F.col(f"_z{p}") for p in range(i)]) / F.col(f"_l{i}_{i}"))
    for i in reversed(k):
        above = [F.col(f"_l{p}_{i}") * F.col(f"k_{inputs[p]}") for p in range(i + 1, len(inputs))]
        out = out.withColumn(f"k_{inputs[i]}", taken(F.col(f"_z{i}"), above) / F.col(f"_l{i}_{i}"))
    intercept = taken(F.col("_y"), [F.col(f"_m{i}") * F.col(f"k_{inputs[i]}") for i in k])
    return out.select(intercept.alias("intercept"), *[f"k_{c}" for c in inputs])


def with_ridge(df: DataFrame, solution: DataFrame, inputs: Sequence[str], name: str = "hybrid") -> DataFrame:
    """The ridge's estimate for each row."""
    # one row
    out = df.crossJoin(F.broadcast(solution))
    estimate = F.col("intercept")
    for c in inputs:
        estimate = estimate + F.col(c) * F.col(f"k_{c}")
    return out.withColumn(name, estimate).drop("intercept", *[f"k_{c}" for c in inputs])


def ridge_coefficients(solution: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """One row per base model and one for the intercept."""
    rows = [F.struct(F.lit(c).alias("term"), F.col(f"k_{c}").alias("coefficient")) for c in inputs]
    return solution.select(F.inline(F.array(*rows, F.struct(F.lit("intercept").alias("term"), F.col("intercept").alias("coefficient")))))
