"""Regression metrics as grouped aggregates over ``row_id, model, split, label, prediction``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import band
from panelkit.operators.quantiles import exact_quantiles, quantile_relation
from panelkit.session import sized


def error() -> Column:
    return F.col("label") - F.col("prediction")


def rmse() -> Column:
    return F.sqrt(F.avg(error() * error()))


def mae() -> Column:
    return F.avg(F.abs(error()))


def r2() -> Column:
    """1 - SSE / SST; NULL for a constant label."""
    spread = F.var_pop("label") * F.count("label")
    return F.lit(1.0) - F.try_divide(F.sum(error() * error()), spread)


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = ("model", "split")) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), rmse().alias("rmse"), mae().alias("mae"), r2().alias("r2")
    )


def extended_metrics(predictions: DataFrame, keys: Sequence[str] = ("model", "split")) -> DataFrame:
    """Adds MAPE (zero labels skipped), explained variance, maximum and median error, residual moments."""
    keys = list(keys)
    base = predictions.withColumn("residual", error()).withColumn("abs_error", F.abs(error()))
    moments = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), rmse().alias("rmse"), mae().alias("mae"), r2().alias("r2"),
        (F.avg(F.try_divide(F.col("abs_error"), F.abs(F.col("label")))) * 100).alias("mape"),
        (F.lit(1.0) - F.try_divide(F.var_pop("residual"), F.var_pop("label"))).alias("explained_variance"),
        F.max("abs_error").alias("max_error"),
        F.avg("residual").alias("residual_mean"), F.stddev_pop("residual").alias("residual_std"),
        F.skewness("residual").alias("residual_skewness"), F.kurtosis("residual").alias("residual_kurtosis"),
    )
    medians = quantile_relation(base, ["abs_error"], [0.5], keys).select(*keys, F.col("q0").alias("median_abs_error"))
    return moments.join(sized(medians, "medians"), keys)  # one row a group: the planner goes by the written size


def band_metrics(predictions: DataFrame, bands: Sequence[tuple[float | None, float | None, str]]) -> DataFrame:
    """Metrics per target band and model; rows outside every band are left out."""
    labelled = predictions.withColumn("segment", band(F.col("label"), bands)).where(F.col("segment").isNotNull())
    return regression_metrics(labelled, ("segment", "model"))


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """MSE, MAE and R2 per model and fold of an out-of-fold prediction relation."""
    return predictions.groupBy("model", "fold").agg(
        F.avg(error() * error()).alias("mse"), F.sqrt(F.avg(error() * error())).alias("rmse"),
        mae().alias("mae"), r2().alias("r2"),
    )


def cross_validation_summary(predictions: DataFrame) -> DataFrame:
    """CV RMSE is the root of the mean fold MSE; deviations are over fold values."""
    return fold_metrics(predictions).groupBy("model").agg(
        F.sqrt(F.avg("mse")).alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std"),
        F.avg("mae").alias("cv_mae_mean"), F.stddev_pop("mae").alias("cv_mae_std"),
        F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
    )


def best_per_metric(metrics: DataFrame, lower: Sequence[str] = ("rmse", "mae", "mape"), higher: Sequence[str] = ("r2",)) -> DataFrame:
    """``metric, best_model, best_value``; model name breaks ties."""
    picks = [
        F.struct(F.lit(m).alias("metric"), F.min_by("model", F.struct(F.col(m), F.col("model"))).alias("best_model"),
                 F.min(m).alias("best_value"))
        for m in lower
    ] + [
        F.struct(F.lit(m).alias("metric"), F.min_by("model", F.struct(-F.col(m), F.col("model"))).alias("best_model"),
                 F.max(m).alias("best_value"))
        for m in higher
    ]
    return metrics.agg(F.array(*picks).alias("picks")).select(F.inline("picks"))


def residual_histogram(predictions: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width residual counts per model between the model's own extremes; the last bin is closed."""
    base = predictions.withColumn("residual", error())
    ends = {r["model"]: (r["lo"], r["hi"]) for r in base.groupBy("model").agg(
        F.min("residual").alias("lo"), F.max("residual").alias("hi")).collect()}

    def per_model(position: int) -> Column:
        expr = None
        for model, pair in ends.items():
            match = F.col("model") == F.lit(model)
            expr = F.when(match, F.lit(pair[position])) if expr is None else expr.when(match, F.lit(pair[position]))
        return expr if expr is not None else F.lit(None).cast("double")

    low, high = per_model(0), per_model(1)
    place = F.floor(F.try_divide((F.col("residual") - low) * F.lit(bins), high - low)).cast("int") + F.lit(1)
    number = F.least(F.coalesce(place, F.lit(1)), F.lit(bins))
    return base.withColumn("bin", number).groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"))


def error_boxes(predictions: DataFrame) -> DataFrame:
    """Quartiles of the absolute error per model, 1.5 IQR whiskers and the number of outliers."""
    base = predictions.withColumn("abs_error", F.abs(error()))
    found = exact_quantiles(base, ["abs_error"], [0.25, 0.5, 0.75], ["model"])
    rows = [(g[0], *v["abs_error"]) for g, v in found.items()]
    boxes = base.sparkSession.createDataFrame(rows, "model string, q1 double, median double, q3 double")
    fenced = base.join(boxes, "model")
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col("abs_error").between(F.col("q1") - reach, F.col("q3") + reach)
    return fenced.groupBy("model", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("abs_error"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("abs_error"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def error_trend(predictions: DataFrame) -> DataFrame:
    """Straight-line fit of the absolute error on the label, per model."""
    return predictions.groupBy("model").agg(
        F.regr_slope(F.abs(error()), F.col("label")).alias("slope"),
        F.regr_intercept(F.abs(error()), F.col("label")).alias("intercept"),
    )


def pivot_metric(metrics: DataFrame, index: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    return metrics.groupBy(index).agg(*[F.max(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values])


def wide_metrics(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """``train_<m>`` and ``test_<m>`` side by side, one row per model."""
    return metrics.groupBy("model").agg(
        *[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in ("train", "test") for m in names]
    )


def weighted_ensemble(predictions: DataFrame, weights: dict[str, float], tolerance: float = 0.01, name: str = "ensemble") -> DataFrame:
    """Weighted mean of the models' predictions per row; the weights must sum to one within the tolerance."""
    if abs(sum(weights.values()) - 1.0) > tolerance:
        raise ValueError(f"ensemble weights sum to {sum(weights.values())}")
    weight = None
    for model, w in weights.items():
        match = F.col("model") == model
        weight = F.when(match, F.lit(w)) if weight is None else weight.when(match, F.lit(w))
    return predictions.where(F.col("model").isin(list(weights))).groupBy("row_id", "split").agg(
        F.max("label").alias("label"), F.sum(weight * F.col("prediction")).alias("prediction")
    ).withColumn("model", F.lit(name))
