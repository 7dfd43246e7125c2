"""Paired tests between models, tests on replicates, rank consistency and normal plots."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.probability import normal_two_sided, t_greater, t_two_sided
from panelkit.functions.scalar import better_of, inverse_normal, pair_label, yes_no
from panelkit.operators.ranks import average_ranks, positions, tied_rank
from panelkit.session import settled


def model_names(predictions: DataFrame) -> list[str]:
    return sorted(r["model"] for r in predictions.select("model").distinct().collect())


#: So many pairs have an exact signed-rank probability.
EXACT_PAIRS = 50


def aligned_errors(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per ``row_id`` with the absolute error of every model: ``e0, e1, ...``.

    This is the self-join of models on the row, as one shuffle for any number of models.
    """
    loss = F.abs(F.col("label") - F.col("prediction"))
    return predictions.groupBy("row_id").agg(
        *[F.max(F.when(F.col("model") == m, loss)).alias(f"e{i}") for i, m in enumerate(models)]
    )


def paired_errors(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """``row_id, model_a, model_b, error_a, error_b`` for every pair of models in order."""
    pairs = [
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                 F.col(f"e{i}").alias("error_a"), F.col(f"e{j}").alias("error_b"))
        for (i, a), (j, b) in combinations(enumerate(models), 2)
    ]
    both = F.col("error_a").isNotNull() & F.col("error_b").isNotNull()
    return aligned_errors(predictions, models).select("row_id", F.inline(F.array(*pairs))).where(both)


def t_statistic(mean: Column, deviation: Column, n: Column) -> Column:
    """Mean over its standard error, from a population deviation."""
    return F.try_divide(mean * F.sqrt(n - F.lit(1.0)), deviation)


def paired_t(pairs: DataFrame) -> DataFrame:
    """``model_a, model_b, n, t_statistic, p_value``: two-sided, n - 1 degrees of freedom."""
    d = F.col("error_a") - F.col("error_b")
    moments = pairs.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std")
    )
    return moments.withColumn("t_statistic", t_statistic(F.col("mean"), F.col("std"), F.col("n"))).select(
        "model_a", "model_b", "n", "t_statistic",
        t_two_sided(F.col("t_statistic"), F.col("n") - 1).alias("p_value"),
    )


def signed_ranks(pairs: DataFrame, edges: Sequence[float] | None = None, digits: int | None = None) -> DataFrame:
    """Tie-averaged ranks of the non-zero absolute differences with the number of positive ones per value.

    ``digits`` compares differences at that many decimals, so that ties do not hang on the last bits.
    """
    d = F.col("error_a") - F.col("error_b")
    if digits is not None:
        d = F.round(d, digits)
    differences = pairs.select("model_a", "model_b", F.abs(d).alias("abs_diff"), (d > 0).alias("positive")).where(
        F.col("abs_diff") > 0
    )
    return average_ranks(
        differences, ["model_a", "model_b"], "abs_diff", {"positives": F.count_if(F.col("positive"))}, edges
    )


def exact_signed_rank(statistic: Column, n: Column) -> Column:
    """Two-sided probability of a smaller rank sum this small, of n different non-zero values.

    The number of subsets of the ranks 1 to n with each sum: every rank adds its shifted counts.
    """
    last = (n * (n + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), last), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda have, rank: F.transform(
        have, lambda c, s: c + F.when(s >= rank, F.get(have, s - rank)).otherwise(F.lit(0.0))))
    below = F.aggregate(F.slice(counts, 1, F.floor(statistic).cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def wilcoxon(pairs: DataFrame, edges: Sequence[float] | None = None, digits: int | None = None) -> DataFrame:
    """Signed-rank test: smaller rank sum and its two-sided p-value.

    Exact for up to ``EXACT_PAIRS`` pairs that all differ, and by different amounts; else normal with tie correction.
    """
    d = F.col("error_a") - F.col("error_b")
    equal = pairs.where((d if digits is None else F.round(d, digits)) == 0).groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("equal"))
    ties = F.col("ties").cast("double")
    sums = signed_ranks(pairs, edges, digits).groupBy("model_a", "model_b").agg(
        F.sum(F.col("rank") * F.col("positives")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("ties") - F.col("positives"))).alias("w_minus"),
        F.sum(ties).alias("m"), F.sum(ties * ties * ties - ties).alias("tie_term"),
    )
    m = F.col("m")
    variance = m * (m + 1) * (2 * m + 1) / F.lit(24.0) - F.col("tie_term") / F.lit(48.0)
    statistic = F.least("w_plus", "w_minus")
    z = F.try_divide(statistic - m * (m + 1) / F.lit(4.0), F.sqrt(variance))
    found = sums.select(
        "model_a", "model_b", statistic.alias("w_statistic"), z.alias("z_statistic"), m.cast("long").alias("n_nonzero"), "tie_term"
    ).join(equal, ["model_a", "model_b"], "left")
    exact = (F.col("n_nonzero") <= EXACT_PAIRS) & (F.col("tie_term") == 0) & F.col("equal").isNull()
    p = F.when(exact, exact_signed_rank(F.col("w_statistic"), F.col("n_nonzero"))).otherwise(normal_two_sided(F.col("z_statistic")))
    return found.select("model_a", "model_b", "w_statistic", "z_statistic", "n_nonzero", p.alias("w_p_value"))


def model_comparison_tests(predictions: DataFrame, models: Sequence[str], digits: int | None = None) -> DataFrame:
    """Paired t and signed-rank results side by side, one row per model pair."""
    pairs = settled(paired_errors(predictions, models), "paired-errors")
    return paired_t(pairs).join(wilcoxon(pairs, digits=digits), ["model_a", "model_b"], "left").select(
        pair_label(F.col("model_a"), F.col("model_b")).alias("comparison"),
        "t_statistic", "p_value", yes_no(F.col("p_value") < 0.05).alias("significant"),
        better_of(F.col("t_statistic"), F.col("model_a"), F.col("model_b")).alias("better_model"),
        "w_statistic", "w_p_value", yes_no(F.col("w_p_value") < 0.05).alias("w_significant"),
    )


def drop_summary(drops: DataFrame, keys: Sequence[str] = ("feature",), value: str = "score_drop") -> DataFrame:
    """Mean and population deviation of score drops, one-sided t-test against zero."""
    moments = drops.groupBy(*keys).agg(
        F.avg(value).alias("mean_score_drop"), F.stddev_pop(value).alias("std_score_drop"),
        F.count(F.lit(1)).alias("n"),
    )
    tested = moments.withColumn(
        "t_statistic", t_statistic(F.col("mean_score_drop"), F.col("std_score_drop"), F.col("n"))
    ).withColumn("p_value", t_greater(F.col("t_statistic"), F.col("n") - 1))
    return tested.withColumn("significant", F.col("p_value") < 0.05).drop("n")


def spearman_matrix(importances: DataFrame) -> DataFrame:
    """``model_a, model_b, rho, n``: all ordered pairs, diagonal included.

    Importances are one row per model and feature, so groups are as wide as the schema.
    """
    ranked = importances.select("model", "feature", tied_rank(["model"], "importance").alias("rank"))
    left = ranked.select(F.col("model").alias("model_a"), "feature", F.col("rank").alias("rank_a"))
    right = ranked.select(F.col("model").alias("model_b"), "feature", F.col("rank").alias("rank_b"))
    return left.join(right, "feature").groupBy("model_a", "model_b").agg(
        F.when(F.col("model_a") == F.col("model_b"), F.lit(1.0)).otherwise(F.corr("rank_a", "rank_b")).alias("rho"),
        F.count(F.lit(1)).alias("n"),
    )


def spearman_tests(importances: DataFrame) -> DataFrame:
    """Adds the two-sided p-value (t with n - 2 degrees of freedom); the diagonal has p = 0."""
    matrix = spearman_matrix(importances)
    rho, free = F.col("rho"), F.col("n") - F.lit(2)
    t = F.try_divide(rho * F.sqrt(free), F.sqrt(F.lit(1.0) - rho * rho))
    p = F.when(F.abs(rho) >= 1.0, F.lit(0.0)).otherwise(t_two_sided(t, free))
    return matrix.withColumn("p_value", p)


def consistency(matrix: DataFrame) -> DataFrame:
    """Mean off-diagonal rank correlation."""
    return matrix.where(F.col("model_a") != F.col("model_b")).agg(F.avg("rho").alias("mean_correlation"))


def normal_plot(predictions: DataFrame, edges: Sequence[float] | None = None) -> DataFrame:
    """Ordered residuals per model against normal quantiles at Filliben's positions."""
    residuals = predictions.select("model", "row_id", (F.col("label") - F.col("prediction")).alias("residual"))
    ordered = positions(residuals, ["model"], "residual", "row_id", "position", edges)
    sizes = residuals.groupBy("model").agg(F.count("residual").cast("double").alias("n"))
    counts = {r["model"]: r["n"] for r in sizes.collect()}
    n = F.coalesce(*[F.when(F.col("model") == m, F.lit(c)) for m, c in counts.items()], F.lit(1.0))
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    place = (
        F.when(F.col("position") == n, last)
        .when(F.col("position") == 1, F.lit(1.0) - last)
        .otherwise((F.col("position") - F.lit(0.3175)) / (n + F.lit(0.365)))
    )
    return ordered.select("model", "position", "residual", inverse_normal(place).alias("quantile"))


def normal_fit(plot: DataFrame) -> DataFrame:
    """Least-squares line through a normal plot, per model."""
    return plot.groupBy("model").agg(
        F.regr_slope("residual", "quantile").alias("slope"), F.regr_intercept("residual", "quantile").alias("intercept"),
        F.sqrt(F.regr_r2("residual", "quantile")).alias("r"),
    )
