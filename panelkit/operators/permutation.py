"""Permutation importance: how far R2 falls when one feature is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.importance import top_features
from panelkit.operators.inference import drop_summary
from panelkit.operators.metrics import r2
from panelkit.operators.splits import SEED, with_shuffled_values
from panelkit.session import settled

Predict = Callable[[DataFrame], DataFrame]


def permutation_drops(
    df: DataFrame, key: str, label: str, features: Sequence[str], tested: Sequence[str], predict: Predict,
    replicates: int = 50, seed: int = SEED,
) -> DataFrame:
    """``feature, replicate, score_drop``; ``predict`` adds a ``prediction`` column from the feature columns.

    A replicate shuffles all rows once and lends the shuffled values to every feature. Variants are made and
    scored row by row in one pipeline, so the expansion is aggregated before any shuffle.
    """
    base = settled(df.select(key, label, *features), "permutation-rows")
    baseline = predict(base.withColumn("label", F.col(label))).agg(r2().alias("score")).first()["score"]
    shuffled = with_shuffled_values(base, key, tested, replicates, seed)
    variants = F.explode(F.array(*[
        F.struct(
            F.lit(t).alias("feature"),
            *[(F.col(f"{c}_shuffled") if c == t else F.col(c)).alias(c) for c in features],
        )
        for t in tested
    ])).alias("variant")
    expanded = shuffled.select("replicate", F.col(label).alias("label"), variants)
    scored = predict(expanded.select("replicate", "label", F.col("variant.feature").alias("feature"),
                                     *[F.col(f"variant.{c}").alias(c) for c in features]))
    return scored.groupBy("feature", "replicate").agg(r2().alias("score")).select(
        "feature", "replicate", (F.lit(baseline) - F.col("score")).alias("score_drop")
    )


def permutation_importance(
    df: DataFrame, key: str, label: str, features: Sequence[str], importances: DataFrame, predict: Predict,
    replicates: int = 50, top_k: int = 20, seed: int = SEED,
) -> DataFrame:
    """Drops of the ``top_k`` features by baseline importance, with a one-sided t-test; largest drop first."""
    top = {r["feature"]: r["importance"] for r in top_features(importances, [], top_k).collect()}
    tested = [f for f in features if f in top]
    drops = permutation_drops(df, key, label, features, tested, predict, replicates, seed)
    known = importances.select("feature", F.col("importance").alias("baseline_importance"))
    return drop_summary(drops).join(known, "feature").select(
        "feature", "baseline_importance", "mean_score_drop", "std_score_drop", "t_statistic", "p_value", "significant"
    ).orderBy(F.col("mean_score_drop").desc(), "feature")
