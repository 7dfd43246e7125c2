"""The five tree regressors behind one interface, with training, scoring, cross-validation and search."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml import Pipeline, PipelineModel  # noqa: F401
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.hashing import poisson_matrix
from panelkit.models.boosting import BoostedModels, BoostParams, fit_boosted
from panelkit.operators.importance import name_vector
from panelkit.operators.splits import SEED, bootstrap_salt, fold_column, with_segment_split
from panelkit.session import materialise, settled, side_by_side
from panelkit.sources.fixed_values import DEFAULTS
from panelkit.sources.tables import feature_list

MLLIB = {
    "decision_tree": DecisionTreeRegressor,
    "random_forest": RandomForestRegressor,
    "gradient_boosting": GBTRegressor,
}
BOOSTED = ("gradient_boosting", "xgboost", "lightgbm")
KEYS = ("decision_tree", "random_forest", *BOOSTED)
# fixed values: settings that the boosting flavours imply when they are not given
FLAVOURS = {
    "decision_tree": {"n_estimators": 1, "forest": True},
    "random_forest": {"forest": True, "bootstrap": True},
    "gradient_boosting": {"reg_lambda": 0.0, "importance": "total_gain"},
    "xgboost": {"reg_lambda": 1.0, "min_child_weight": 1.0, "importance": "gain"},
    "lightgbm": {"reg_lambda": 0.0, "num_leaves": 31, "min_child_samples": 20, "min_child_weight": 1e-3, "importance": "split"},
}
MAX_DEPTH = 30  # the deepest tree MLlib accepts


def mllib_params(key: str, params: dict[str, Any]) -> dict[str, Any]:
    """MLlib settings for the usual names. ``min_samples_split`` has no counterpart and is left out."""
    out: dict[str, Any] = {}
    for name, value in params.items():
        if name == "max_depth":
            depth = MAX_DEPTH if value is None or value < 0 else value
            if depth > MAX_DEPTH:
                raise ValueError(f"MLlib trees have at most {MAX_DEPTH} levels, not {depth}")
            out["maxDepth"] = depth
        elif name == "min_samples_leaf":
            out["minInstancesPerNode"] = value
        elif name == "n_estimators":
            out["maxIter" if key == "gradient_boosting" else "numTrees"] = value
        elif name == "learning_rate":
            out["stepSize"] = value
        elif name == "subsample":
            out["subsamplingRate"] = value
        elif name == "max_features":
            # a single tree has no feature sampling in MLlib
            if key != "decision_tree":
                out["featureSubsetStrategy"] = "all" if value is None else str(value)
    return out


def boost_params(key: str, params: dict[str, Any]) -> BoostParams:
    names = {} if key in ("xgboost", "lightgbm") else {"min_samples_leaf": "min_child_samples"}
    known = {names.get(k, k): v for k, v in {**FLAVOURS[key], **params}.items() if names.get(k, k) in BoostParams.__dataclass_fields__}
    if known.get("max_depth") is None and "max_depth" in known:
        known["max_depth"] = -1
    if "max_features" in known:
        known["max_features"] = "all" if known["max_features"] is None else str(known["max_features"])
    for name in ("min_child_weight", "gamma", "reg_alpha", "reg_lambda", "learning_rate", "subsample", "colsample_bytree"):
        if name in known:
            known[name] = float(known[name])
    return BoostParams(**known)


def estimator(key: str, params: dict[str, Any] | None = None, label: str = "label", weight: str | None = None, seed: int = SEED):
    """An MLlib estimator on the ``features`` vector."""
    made = MLLIB[key](featuresCol="features", labelCol=label, predictionCol="prediction", seed=seed,
                      **mllib_params(key, DEFAULTS[key] if params is None else params))
    if weight is not None:
        made.setWeightCol(weight)
    return made


@dataclass(frozen=True)
class Template:
    """The kind and settings of a model, to be fitted again."""

    key: str
    params: dict[str, Any]

    def fit(self, df: DataFrame, features: Sequence[str], label: str, row_id: str, weight: Column | None = None, seed: int = SEED) -> TreeModel:
        return train(self.key, df, features, label, row_id, self.params, weight, seed)


def from_template(fitted, extra: dict[str, Any] | None = None):
    """The settings of a fitted model, changed by ``extra``: a ``Template`` of a ``TreeModel``, an estimator of an MLlib model."""
    if isinstance(fitted, TreeModel):
        return Template(fitted.key, {**fitted.params, **(extra or {})})
    by_model = {c.__name__.replace("Regressor", "RegressionModel"): c for c in MLLIB.values()}
    made = by_model[type(fitted).__name__]()
    for param in fitted.extractParamMap():
        if made.hasParam(param.name):
            made._set(**{param.name: fitted.getOrDefault(param)})
    changes: dict[Param, Any] = {made.getParam(k): v for k, v in (extra or {}).items()}
    return made.copy(changes)


class TreeModel:
    """A fitted model: ``transform`` adds a prediction, ``importances`` is ``feature, importance``."""

    def __init__(self, key: str, features: Sequence[str], params: dict[str, Any], pipeline: PipelineModel | None = None,
                 boosted: BoostedModels | None = None):
        self.key, self.features, self.params = key, list(features), params
        self.pipeline, self.boosted = pipeline, boosted

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if self.boosted is not None:
            return self.boosted.transform(df, 0, name)
        # a label column of the caller must not clash with the model's own columns
        scored = self.pipeline.transform(df)
        return scored.withColumnRenamed("prediction", name).select(*[F.col(f"`{c}`") for c in df.columns], F.col(name))

    def importances(self, spark: SparkSession) -> DataFrame:
        if self.boosted is not None:
            return self.boosted.importances(spark).select("feature", "importance")
        values = self.pipeline.stages[-1].featureImportances
        vector = spark.createDataFrame([(values,)], ["vector"]).select(vector_to_array("vector").alias("importances"))
        return name_vector(vector, feature_list(spark, self.features))


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def train(
    key: str, df: DataFrame, features: Sequence[str], label: str, row_id: str, params: dict[str, Any] | None = None,
    weight: Column | None = None, seed: int = SEED,
) -> TreeModel:
    """Fit one model; ``weight`` is a whole-number row weight."""
    params = DEFAULTS[key] if params is None else params
    weights = None if weight is None else F.array(weight)
    return TreeModel(key, features, params, boosted=fit_boosted(
        df, row_id, features, label, boost_params(key, {**params, "seed": seed}), weights))


def train_together(keys: Sequence[str], df: DataFrame, features: Sequence[str], label: str, row_id: str) -> dict[str, TreeModel]:
    """Models at their default settings, each as ``train`` gives it: boosted ones in the same jobs, beside them the others."""
    boosted, others = [k for k in keys if k in BOOSTED], [k for k in keys if k not in BOOSTED]
    rows = settled(df.select(row_id, label, *features), "train-rows")

    def same_jobs():
        settings = [boost_params(k, {**DEFAULTS[k], "seed": SEED}) for k in boosted]
        fitted = fit_boosted(rows, row_id, features, label, settings, columns=[0] * len(boosted))
        return {k: TreeModel(k, features, DEFAULTS[k], boosted=fitted.part(m)) for m, k in enumerate(boosted)}

    found = side_by_side([*([same_jobs] if boosted else []), *[lambda k=k: {k: train(k, rows, features, label, row_id)} for k in others]])
    made = {k: model for part in found for k, model in part.items()}
    return {k: made[k] for k in keys}


def train_all(
    df: DataFrame, features: Sequence[str], label: str, row_id: str, keys: Sequence[str] = KEYS,
    params: dict[str, dict[str, Any]] | None = None,
) -> dict[str, TreeModel]:
    """All listed models on one train split, which is settled once."""
    rows = settled(df.select(row_id, label, *features), "train-rows")
    return {k: train(k, rows, features, label, row_id, (params or {}).get(k)) for k in keys}


def predict_long(models: dict[str, TreeModel], df: DataFrame, row_id: str, label: str, split: str = "split") -> DataFrame:
    """``row_id, model, split, label, prediction`` of all models in one pass over the rows."""
    scored = df
    for i, model in enumerate(models.values()):
        scored = model.transform(scored, f"score{i}")
    pairs = F.array(*[F.struct(F.lit(k).alias("model"), F.col(f"score{i}").alias("prediction")) for i, k in enumerate(models)])
    return scored.select(F.col(row_id).alias("row_id"), F.col(split).alias("split"), F.col(label).alias("label"), F.inline(pairs))


def importances_long(models: dict[str, TreeModel], spark: SparkSession) -> DataFrame:
    parts = [m.importances(spark).select(F.lit(k).alias("model"), "feature", "importance") for k, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(
    key: str, df: DataFrame, features: Sequence[str], label: str, row_id: str, params: dict[str, Any] | None = None,
    folds: int = 5, seed: int = SEED,
) -> DataFrame:
    """Out-of-fold predictions ``row_id, model, fold, label, prediction``; see ``cross_validation_summary``. All folds train in the same jobs."""
    params = DEFAULTS[key] if params is None else params
    rows = settled(df.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"), *features,
                             fold_column(row_id, folds, seed).alias("fold")), "cv-rows")
    weights = F.array(*[F.when(F.col("fold") != k, 1).otherwise(0) for k in range(folds)])
    fitted = fit_boosted(rows, "row_id", features, "label", [boost_params(key, params)] * folds, weights)
    scored = fitted.transform(rows, F.col("fold"))
    return scored.select("row_id", F.lit(key).alias("model"), "fold", "label", "prediction")


def cross_validate_all(keys: Sequence[str], df: DataFrame, features: Sequence[str], label: str, row_id: str) -> list[DataFrame]:
    """``cross_validate`` of several models at default settings, side by side."""
    rows = settled(df.select(row_id, label, *features), "cv-rows")
    made = dict(zip(order := _longest_first(keys), side_by_side([lambda k=k: cross_validate(k, rows, features, label, row_id) for k in order])))
    return [made[k] for k in keys]


def grid_points(grid: dict[str, Sequence[Any]]) -> list[dict[str, Any]]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def grid_search(
    key: str, df: DataFrame, features: Sequence[str], label: str, row_id: str, grid: dict[str, Sequence[Any]],
    folds: int = 5, batch: int = 64,
) -> tuple[TreeModel, DataFrame]:
    """Best model on the whole frame by mean fold MSE, and ``point, params, cv_mse`` of every grid point."""
    spark = df.sparkSession
    points = grid_points(grid)
    rows = settled(df.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"), *features,
                             fold_column(row_id, folds).alias("fold")), "grid-rows")
    scores: list[float] = []
    per_job = max(1, (batch if key in BOOSTED else 4 * batch) // folds)
    weights = F.array(*[F.when(F.col("fold") != k, 1).otherwise(0) for k in range(folds)])
    for start in range(0, len(points), per_job):
        part = points[start : start + per_job]
        settings = [boost_params(key, {**DEFAULTS[key], **p}) for p in part for _ in range(folds)]
        fitted = fit_boosted(rows, "row_id", features, "label", settings, weights, columns=list(range(folds)) * len(part))
        for errors in fitted.held_out_errors(rows, "label", "fold", folds):
            known = [e for e in errors if e is not None]
            scores.append(sum(known) / len(known))
    best = min(range(len(points)), key=lambda i: (scores[i], i))
    table = spark.createDataFrame(
        [(i, str(p), float(s)) for i, (p, s) in enumerate(zip(points, scores))], "point int, params string, cv_mse double")
    return train(key, rows, features, "label", "row_id", {**DEFAULTS[key], **points[best]}), table


SEGMENT_DEFAULTS = {
    "random_forest": {"n_estimators": 100, "max_depth": 10},
    "xgboost": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5},
    "lightgbm": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 5},
}


def _longest_first(keys: Sequence[str]) -> list[str]:
    return sorted(keys, key=lambda k: k not in BOOSTED)


def train_segments(
    df: DataFrame, segment: str, features: Sequence[str], label: str, row_id: str,
    keys: Sequence[str] = tuple(SEGMENT_DEFAULTS), params: dict[str, dict[str, Any]] | None = None,
    minimum: int = 30,
) -> tuple[DataFrame, DataFrame]:
    """Models per segment: test predictions ``segment, row_id, model, label, prediction`` and importances.

    Each segment is split with its own adaptive test share. Models of all segments train in the same jobs.
    """
    spark = df.sparkSession
    sizes = df.where(F.col(segment).isNotNull()).groupBy(segment).count().where(F.col("count") >= minimum)
    names = sorted(r[segment] for r in sizes.collect())
    rows = with_segment_split(
        df.where(F.col(segment).isin(names)).select(F.col(row_id).alias("row_id"), F.col(label).alias("label"),
                                                    F.col(segment).alias("segment"), *features), "row_id", "segment")
    rows = materialise(rows, "segment-rows")
    train_rows, test_rows = (rows.where(F.col("split") == s) for s in ("train", "test"))
    settings = {k: {**SEGMENT_DEFAULTS[k], **(params or {}).get(k, {})} for k in keys}
    weights = F.array(*[F.when(F.col("segment") == n, 1).otherwise(0) for n in names])
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("segment")) - 1

    def fit(key):
        fitted = fit_boosted(train_rows, "row_id", features, "label", [boost_params(key, settings[key])] * len(names), weights)
        part = fitted.transform(test_rows, place).select("segment", "row_id", F.lit(key).alias("model"), "label", "prediction")
        return part, [(names[m], key, f, v) for m, f, v in fitted.importance_rows()]

    # tasks of boosted models are the longest: they start first
    made = dict(zip(order := _longest_first(keys), side_by_side([lambda k=k: fit(k) for k in order])))
    scored, found = [made[k][0] for k in keys], [row for k in keys for row in made[k][1]]
    importances = spark.createDataFrame(found, "segment string, model string, feature string, importance double")
    return reduce(DataFrame.unionByName, scored), importances


def bootstrap_importances(
    key: str, df: DataFrame, features: Sequence[str], label: str, row_id: str, replicates: int = 100,
    params: dict[str, Any] | None = None, seed: int = SEED, numbers: Sequence[int] | None = None,
) -> DataFrame:
    """``model, replicate, feature, importance``: refits on bootstrap weights; replicate i has seed ``seed + i``.

    ``numbers`` fits these replicates alone; a replicate is the same whichever others are fitted with it.

    Replicates share every job.
    """
    spark = df.sparkSession
    params = DEFAULTS[key] if params is None else params
    schema = "model string, replicate int, feature string, importance double"
    rows = settled(df.select(row_id, label, *features), "bootstrap-rows")
    chosen = list(range(replicates) if numbers is None else numbers)
    if not chosen:
        return spark.createDataFrame([], schema)
    settings = [boost_params(key, {**params, "seed": seed + i}) for i in chosen]
    salts = [bootstrap_salt(r, seed) for r in chosen]
    fitted = fit_boosted(rows, row_id, features, label, settings, F.col(row_id), make=lambda keys: poisson_matrix(keys, salts))
    return spark.createDataFrame([(key, chosen[m], f, v) for m, f, v in fitted.importance_rows()], schema)


def predictor(model: TreeModel) -> Callable[[DataFrame], DataFrame]:
    """The model as a function for permutation tests."""
    return lambda df: model.transform(df)
