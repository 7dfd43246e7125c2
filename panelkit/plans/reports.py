"""Report relations: the tables and texts that users read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators import metrics as M
from panelkit.operators.importance import top_features
from panelkit.operators.lookup import display_name, model_label
from panelkit.operators.ranks import small_rank


def comparison_table(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """Train/test RMSE and R2 side by side, CV RMSE and the overfit gap (train minus test RMSE)."""
    wide = M.wide_metrics(M.regression_metrics(predictions), ["rmse", "r2"])
    cv = M.cross_validation_summary(folds).select("model", F.col("cv_rmse_mean").alias("cv_rmse"))
    return wide.join(cv, "model", "left").withColumn("overfit_gap", F.col("train_rmse") - F.col("test_rmse"))


def comprehensive_table(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    extended = M.extended_metrics(predictions)
    wide = M.wide_metrics(extended, ["rmse", "mae", "mape", "r2", "max_error", "median_abs_error"])
    cv = M.cross_validation_summary(folds)
    return wide.join(cv, "model", "left").select(
        "model", "train_rmse", "test_rmse", "train_mae", "test_mae", "test_mape", "train_r2", "test_r2",
        F.col("cv_rmse_mean").alias("cv_rmse"), "cv_r2_mean", "cv_r2_std",
        (F.col("train_rmse") - F.col("test_rmse")).alias("overfit_gap"),
        F.col("test_max_error").alias("max_error"), F.col("test_median_abs_error").alias("median_abs_error"),
    )


def ranking(comparison: DataFrame) -> DataFrame:
    """Models by test R2, best first."""
    return comparison.withColumn("rank", small_rank([], [F.col("test_r2").desc(), F.col("model")]))


def performance_table(comparison: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled models with RMSE to two and R2 to three decimals."""
    return model_label(comparison, "model", labels, "model_name").select(
        "model_name", F.round("train_rmse", 2).alias("train_rmse"), F.round("test_rmse", 2).alias("test_rmse"),
        F.round("test_r2", 3).alias("test_r2"), F.round("cv_rmse", 2).alias("cv_rmse"),
    )


def feature_table(importances: DataFrame, names: DataFrame, n: int = 10) -> DataFrame:
    """Rank, display name and importance of the top features of one model."""
    return display_name(top_features(importances, [], n), "feature", names).select("rank", "display", "importance")


def segment_table(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Listed models per segment; the label stands on the first row of a segment only."""
    order = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    first = small_rank(["segment", "model"], [F.col("rmse")], "copy")
    kept = results.where(F.col("model").isin(list(models))).withColumn("copy", first).where(F.col("copy") == 1)
    placed = kept.withColumn("row_in_segment", small_rank(["segment"], [order]))
    label = F.when(F.col("row_in_segment") == 1, F.col("segment")).otherwise("")
    return placed.select("segment", "row_in_segment", label.alias("label"), "model", "n", "rmse", "r2")


def summary_sentence(df: DataFrame, target: str, second: str) -> DataFrame:
    """One sentence about the target and one accompanying variable."""
    found = df.agg(
        F.avg(target).alias("m"), F.stddev_samp(target).alias("s"), F.min(target).alias("lo"), F.max(target).alias("hi"),
        F.avg(second).alias("m2"), F.stddev_samp(second).alias("s2"),
    )
    text = (
        f"{target}: average %.1f (sd %.1f, between %.1f and %.1f); "
        f"{second}: average %.0f (sd %.0f)"
    )
    return found.select(F.format_string(text, "m", "s", "lo", "hi", "m2", "s2").alias("summary"))


def best_models(metrics: DataFrame) -> DataFrame:
    """Best model per test metric."""
    return M.best_per_metric(metrics.where(F.col("split") == "test"))


def recommendation(comparison: DataFrame, simple: str = "Tree") -> DataFrame:
    """Best model overall and best model whose name contains ``simple``."""
    fits = F.when(F.contains(F.col("model"), F.lit(simple)), F.struct("test_rmse", "model"))
    return comparison.agg(
        F.min_by("model", F.struct(-F.col("test_r2"), F.col("model"))).alias("best_overall"),
        F.min_by("model", fits).alias("best_simple"),
    )


def _lines(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack parts of ``section, place, line`` and number the lines; reports are result-sized."""
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.withColumn("line_no", small_rank([], [F.col("section"), F.col("place"), F.col("line")])).select("line_no", "line")


def _part(df: DataFrame, section: int, line: Column, place: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), (place if place is not None else F.lit(0)).cast("int").alias("place"), line.alias("line")
    )


def comparison_report(metrics: DataFrame, comparison: DataFrame, simple: str = "Tree") -> DataFrame:
    best = best_models(metrics).withColumn(
        "place", F.array_position(F.array(*[F.lit(m) for m in ("rmse", "mae", "r2", "mape")]), F.col("metric"))
    )
    mae = metrics.where(F.col("split") == "test").select("model", F.col("mae").alias("test_mae"))
    ranked = ranking(comparison).join(mae, "model")
    advice = recommendation(comparison, simple)
    return _lines([
        _part(best, 1, F.format_string("winner on %s is %s, at %.3f", "metric", "best_model", "best_value"), F.col("place")),
        _part(ranked, 2, F.format_string(
            "place %d, %s: r2=%.4f rmse=%.4f mae=%.4f on the test rows, train less test rmse=%.4f",
            "rank", "model", "test_r2", "test_rmse", "test_mae", "overfit_gap"), F.col("rank")),
        _part(advice, 3, F.concat(F.lit("choice by r2: "), F.col("best_overall"))),
        _part(advice.where(F.col("best_simple").isNotNull()), 4, F.concat(F.lit("choice among simple models: "), F.col("best_simple"))),
    ])


def segmentation_report(results: DataFrame, importances: DataFrame, n: int = 5, width: int = 50) -> DataFrame:
    """Per segment: size, mean and deviation, model scores and the top features.

    ``results``: segment, n, mean, std, model, rmse, r2; ``importances``: segment, feature, importance.
    """
    place = F.dense_rank().over(Window.orderBy("segment"))
    # a model that misses rows does not speak for its segment
    heads = results.groupBy("segment").agg(F.max(F.struct("n", "mean", "std")).alias("h")).select("segment", "h.*")
    lines = [
        heads.select("segment", F.lit(0).alias("block"), F.lit(0).alias("place"),
                     F.format_string("[%s] rows=%d, target average=%.2f, sd=%.2f", "segment", "n", "mean", "std").alias("line")),
        results.select("segment", F.lit(1).alias("block"),
                       small_rank(["segment"], [F.col("model")], "place"),
                       F.format_string("  %s: RMSE=%.2f, R2=%.3f", "model", "rmse", "r2").alias("line")),
        top_features(importances, ["segment"], n).select(
            "segment", F.lit(2).alias("block"), F.col("rank").alias("place"),
            F.format_string("  %d. %s: %.4f", F.col("rank"), F.substring("feature", 1, width), F.col("importance")).alias("line")),
    ]
    stacked = reduce(DataFrame.unionByName, lines).withColumn("section", place)
    order = [F.col("section"), F.col("block"), F.col("place")]
    return stacked.select(small_rank([], order, "line_no"), "line")


def statistical_report(bootstrap: DataFrame, permutation: DataFrame, matrix: DataFrame, consensus: DataFrame) -> DataFrame:
    """Top ten intervals and score drops, the rank matrix and the key counts."""
    by_mean = bootstrap.withColumn("rank", small_rank([], [F.col("mean_importance").desc(), F.col("feature")])).where(F.col("rank") <= 10)
    by_drop = permutation.withColumn("rank", small_rank([], [F.col("mean_score_drop").desc(), F.col("feature")])).where(F.col("rank") <= 10)
    cut = F.substring("feature", 1, 38)
    scores = matrix.where(F.col("model_a") != F.col("model_b")).agg(F.avg("rho").alias("mean"))
    return _lines([
        _part(by_mean, 1, F.format_string("%d %s %.4f %s", F.col("rank"), cut, F.col("mean_importance"),
                                          S.interval(F.col("ci_lower"), F.col("ci_upper"))), F.col("rank")),
        _part(by_drop, 2, F.format_string("%d %s %.4f %s", F.col("rank"), cut, F.col("mean_score_drop"),
                                          S.yes_no(F.col("significant"))), F.col("rank")),
        _part(matrix, 3, F.format_string("%s / %s %.3f", "model_a", "model_b", "rho"),
              F.row_number().over(Window.orderBy("model_a", "model_b"))),
        _part(bootstrap.agg(F.count_if(F.col("ci_lower") > 0).alias("k")), 4,
              F.format_string("lower interval end above zero: %d features", "k")),
        _part(permutation.agg(F.count_if(F.col("significant")).alias("k")), 5,
              F.format_string("score drop with p below 0.05: %d features", "k")),
        _part(scores, 6, F.format_string("rank agreement between models, averaged: %.3f", "mean")),
        _part(consensus, 7, F.col("feature"), F.row_number().over(Window.orderBy("mean_rank", "feature"))),
    ])
