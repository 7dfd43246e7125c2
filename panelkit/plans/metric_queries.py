"""Queries for metrics, tests, importance relations and reports on deterministic predictors."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators import importance as I
from panelkit.operators import inference as X
from panelkit.operators import metrics as M
from panelkit.operators import quality, segments
from panelkit.operators.permutation import permutation_drops
from panelkit.operators.ranks import positions, small_rank, tied_rank
from panelkit.plans import frames as B
from panelkit.plans import panel_queries as P
from panelkit.plans import reports as R
from panelkit.plans.catalog import q, query, r, rounded, t_greater_sql, t_two_sided_sql
from panelkit.plans.frames import with_sql
from panelkit.session import fresh_path
from panelkit.sources import tables

#: Weights of this query's own models.
WEIGHTS = {"m_const": 0.1, "m_entity": 0.25, "m_ym": 0.1, "m_lin": 0.45, "m_prod": 0.1}


def metrics(spark, sf_dir) -> DataFrame:
    return M.regression_metrics(B.predictions(spark, sf_dir))


# ------------------------------------------------------------------ metrics


@query("a13_regression_metrics", with_sql("metrics", f"SELECT model, split, n, {q(['rmse', 'mae', 'r2'])} FROM metrics"))
def regression_metrics(spark, sf_dir):
    return rounded(metrics(spark, sf_dir))


EXTENDED = ["rmse", "mae", "r2", "mape", "explained_variance", "max_error", "residual_mean", "residual_std",
            "residual_skewness", "residual_kurtosis", "median_abs_error"]


@query("a14_extended_metrics", with_sql("extended", f"SELECT model, split, n, {q(EXTENDED)} FROM extended"))
def extended_metrics(spark, sf_dir):
    return rounded(M.extended_metrics(B.predictions(spark, sf_dir)))


BAND_SQL = P._band_case.replace("target", "label")


@query("a15_band_metrics", with_sql("test_predictions", f"""SELECT segment, model, n, {q(['rmse', 'mae', 'r2'])} FROM (
    SELECT {BAND_SQL} AS segment, model, {B.metric_columns()} FROM test_predictions GROUP BY 1, 2)"""))
def band_metrics(spark, sf_dir):
    return rounded(M.band_metrics(B.test_predictions(spark, sf_dir), B.BANDS))


CV = ["cv_rmse_mean", "cv_rmse_std", "cv_mae_mean", "cv_mae_std", "cv_r2_mean", "cv_r2_std"]


@query("a16_fold_metrics", with_sql("fold_metrics", f"SELECT model, fold, {q(['mse'], 2)}, {q(['rmse', 'mae', 'r2'])} FROM fold_metrics"))
def fold_metrics(spark, sf_dir):
    found = M.fold_metrics(B.cv_predictions(spark, sf_dir))
    return found.select("model", "fold", r("mse", 2).alias("mse"), *[r(c).alias(c) for c in ("rmse", "mae", "r2")])


@query("a16b_cross_validation", with_sql("cv_summary", f"SELECT model, {q(CV)} FROM cv_summary"))
def cross_validation(spark, sf_dir):
    return rounded(M.cross_validation_summary(B.cv_predictions(spark, sf_dir)))


@query("a21_best_models", with_sql("extended", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, min_by(model, {s}{m}) AS best_model, round({f}({m}), 6) AS best_value FROM extended WHERE split = 'test'"
    for m, s, f in (("rmse", "", "min"), ("mae", "", "min"), ("mape", "", "min"), ("r2", "-", "max")))))
def best_models(spark, sf_dir):
    return rounded(R.best_models(M.extended_metrics(B.predictions(spark, sf_dir))))


@query("a23_residual_histogram", with_sql("test_predictions", """SELECT model, CAST(least(floor((e - lo) * 30 / (hi - lo)) + 1, 30) AS INTEGER) AS bin, count(*) AS n
    FROM test_predictions JOIN (SELECT model AS m, min(e) AS lo, max(e) AS hi FROM test_predictions GROUP BY 1) ON m = model GROUP BY 1, 2"""))
def residual_histogram(spark, sf_dir):
    return M.residual_histogram(B.test_predictions(spark, sf_dir), 30)


@query("a24_error_boxes", with_sql("test_predictions", f"""SELECT model, {q(['q1', 'q2', 'q3'], 4).replace('AS q2', 'AS median')},
    round(min(CASE WHEN abs(e) BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN abs(e) END), 4) AS whisker_low,
    round(max(CASE WHEN abs(e) BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN abs(e) END), 4) AS whisker_high,
    count(CASE WHEN NOT abs(e) BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers
    FROM test_predictions JOIN (SELECT model AS m, {P.QUARTILES.format(c='abs(e)')} FROM test_predictions GROUP BY 1) ON m = model
    GROUP BY model, q1, q2, q3"""))
def error_boxes(spark, sf_dir):
    return rounded(M.error_boxes(B.test_predictions(spark, sf_dir)), 4)


@query("a25_error_trend", with_sql("test_predictions", """SELECT model, round(regr_slope(abs(e), label), 6) AS slope,
    round(regr_intercept(abs(e), label), 4) AS intercept FROM test_predictions GROUP BY 1"""))
def error_trend(spark, sf_dir):
    found = M.error_trend(B.test_predictions(spark, sf_dir))
    return found.select("model", r("slope").alias("slope"), r("intercept", 4).alias("intercept"))


PIVOT_SQL = with_sql("test_predictions", f"""SELECT segment, {', '.join(f"round(max(CASE WHEN model = '{m}' THEN rmse END), 4) AS {m}" for m in B.MODELS)}
    FROM (SELECT {BAND_SQL} AS segment, model, {B.metric_columns()} FROM test_predictions GROUP BY 1, 2) GROUP BY 1""")


@query("a26_metric_pivot", PIVOT_SQL)
def metric_pivot(spark, sf_dir):
    found = M.band_metrics(B.test_predictions(spark, sf_dir), B.BANDS)
    return rounded(M.pivot_metric(found, "segment", "model", "rmse", B.MODELS), 4)


@query("f9_residuals", with_sql("test_predictions", "SELECT row_id, model, round(e, 4) AS residual, round(abs(e), 4) AS abs_error FROM test_predictions"))
def residuals(spark, sf_dir):
    return B.test_predictions(spark, sf_dir).select(
        "row_id", "model", r(M.error(), 4).alias("residual"), r(F.abs(M.error()), 4).alias("abs_error"))


@query("f20_overfit_gap", with_sql("metrics", """SELECT model, round(max(CASE WHEN split = 'train' THEN rmse END)
    - max(CASE WHEN split = 'test' THEN rmse END), 6) AS overfit_gap FROM metrics GROUP BY 1"""))
def overfit_gap(spark, sf_dir):
    wide = M.wide_metrics(metrics(spark, sf_dir), ["rmse"])
    return wide.select("model", r(F.col("train_rmse") - F.col("test_rmse")).alias("overfit_gap"))


@query("f21_weighted_ensemble", with_sql("wide_predictions", f"""SELECT split, n, {q(['rmse', 'mae', 'r2'])} FROM (
    SELECT split, {B.metric_columns(prediction='p')} FROM (SELECT split, label,
    {' + '.join(f'coalesce({m} * {w}::DOUBLE, 0)' for m, w in WEIGHTS.items())} AS p FROM wide_predictions) GROUP BY 1)"""))
def weighted_ensemble(spark, sf_dir):
    mixed = M.weighted_ensemble(B.predictions(spark, sf_dir), WEIGHTS)
    return rounded(M.regression_metrics(mixed, ["split"]))


@query("p19_rounded_labels", with_sql("metrics", """SELECT model AS "Model", round(max(CASE WHEN split = 'test' THEN rmse END), 3) AS "Test RMSE" FROM metrics GROUP BY 1"""))
def rounded_labels(spark, sf_dir):
    wide = M.wide_metrics(metrics(spark, sf_dir), ["rmse"])
    return wide.select(F.col("model").alias("Model"), r("test_rmse", 3).alias("Test RMSE"))


@query("o4_model_ranking", with_sql("metrics", """SELECT model, round(r2, 6) AS r2,
    CAST(row_number() OVER (ORDER BY r2 DESC, model) AS INTEGER) AS rank FROM metrics WHERE split = 'test'"""))
def model_ranking(spark, sf_dir):
    test = metrics(spark, sf_dir).where(F.col("split") == "test")
    return test.select("model", r("r2").alias("r2"), small_rank([], [F.col("r2").desc(), F.col("model")])).orderBy("rank")


@query("t1_union_results", with_sql("metrics", f"""SELECT model, split, 'rmse' AS metric, round(rmse, 6) AS value FROM metrics
    UNION ALL SELECT model, split, 'mae', round(mae, 6) FROM metrics UNION ALL SELECT model, split, 'r2', round(r2, 6) FROM metrics"""))
def union_results(spark, sf_dir):
    return rounded(metrics(spark, sf_dir).unpivot(["model", "split"], ["rmse", "mae", "r2"], "metric", "value"))


@query("s7_read_results", with_sql("metrics", f"SELECT model, split, n, {q(['rmse', 'mae', 'r2'])} FROM metrics"))
def read_results(spark, sf_dir):
    path = fresh_path(spark, "metrics")
    tables.write_table(metrics(spark, sf_dir), path, single_file=True)
    return rounded(tables.read_table(spark, path))


# ------------------------------------------------------------------ paired tests


@query("j6_paired_errors", with_sql("pairs", f"SELECT row_id, model_a, model_b, {q(['error_a', 'error_b'], 4)} FROM pairs"))
def paired_errors(spark, sf_dir):
    return rounded(X.paired_errors(B.test_predictions(spark, sf_dir), B.MODELS), 4)


@query("x1_paired_t", with_sql("t_tests", f"SELECT model_a, model_b, n, {q(['t_statistic'])} FROM t_tests"))
def paired_t(spark, sf_dir):
    return rounded(X.paired_t(X.paired_errors(B.test_predictions(spark, sf_dir), B.MODELS)).drop("p_value"))


@query("x1b_paired_t_p_values", with_sql("t_tests", f"""SELECT model_a, model_b, n, round(t_statistic, 6) AS t_statistic,
    round({t_two_sided_sql('t_statistic', 'n - 1')}, 6) AS p_value FROM t_tests"""))
def paired_t_p_values(spark, sf_dir):
    return rounded(X.paired_t(X.paired_errors(B.test_predictions(spark, sf_dir), B.MODELS)))


@query("w4_signed_ranks", with_sql("signed", """SELECT model_a, model_b, count(*) AS n, round(sum(rank), 2) AS rank_sum,
    round(sum(rank * rank), 0) AS square_sum, round(sum(CASE WHEN positive THEN rank ELSE 0 END), 2) AS positive_sum FROM signed GROUP BY 1, 2"""))
def signed_ranks(spark, sf_dir):
    ranked = X.signed_ranks(X.paired_errors(B.test_predictions(spark, sf_dir), B.MODELS), digits=6)
    return ranked.groupBy("model_a", "model_b").agg(
        F.sum("ties").alias("n"), r(F.sum(F.col("rank") * F.col("ties")), 2).alias("rank_sum"),
        r(F.sum(F.col("rank") * F.col("rank") * F.col("ties")), 0).alias("square_sum"),
        r(F.sum(F.col("rank") * F.col("positives")), 2).alias("positive_sum"),
    )


@query("x2_wilcoxon", with_sql("wilcoxon", "SELECT model_a, model_b, round(w_statistic, 2) AS w_statistic, n_nonzero FROM wilcoxon"))
def wilcoxon(spark, sf_dir):
    found = X.wilcoxon(X.paired_errors(B.test_predictions(spark, sf_dir), B.MODELS), digits=6)
    return found.select("model_a", "model_b", r("w_statistic", 2).alias("w_statistic"), "n_nonzero")


@query("x2b_exact_signed_rank", with_sql(["frame", "test_predictions"], f"""SELECT model_a, model_b, w AS w_statistic, n AS n_nonzero,
    round(CASE WHEN equal = 0 AND n <= 50 THEN least(1.0::DOUBLE, 2 * list_sum(c[1:CAST(floor(w) AS INTEGER) + 1]) / pow(2.0::DOUBLE, n))
               ELSE {B.normal_two_sided_sql('(w - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE)')} END, 6) AS w_p_value FROM (
      SELECT model_a, model_b, least(sum(CASE WHEN d > 0 THEN rank ELSE 0 END), sum(CASE WHEN d < 0 THEN rank ELSE 0 END)) :: DOUBLE AS w,
             count(CASE WHEN d <> 0 THEN 1 END) AS n, count(CASE WHEN d = 0 THEN 1 END) AS equal FROM (
        SELECT *, row_number() OVER (PARTITION BY model_a, model_b, d = 0 ORDER BY abs(d)) AS rank FROM (
          SELECT a.model AS model_a, b.model AS model_b, round(a.loss - b.loss, 6) AS d FROM losses a JOIN losses b ON a.entity = b.entity
          JOIN numbered x ON x.model = a.model JOIN numbered y ON y.model = b.model AND x.place < y.place)) GROUP BY 1, 2) LEFT JOIN sums ON r = n""",
    losses="SELECT entity, model, avg(abs(label - prediction)) AS loss FROM test_predictions JOIN frame USING (row_id) GROUP BY 1, 2",
    numbered=f"SELECT unnest({list(B.MODELS)}) AS model, generate_subscripts({list(B.MODELS)}, 1) AS place",
    sums="""WITH RECURSIVE dp(r, c) AS (SELECT 0, list_transform(range(1276), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    UNION ALL SELECT r + 1, list_transform(range(1276), lambda i: c[i + 1] + CASE WHEN i > r THEN c[i - r] ELSE 0.0::DOUBLE END) FROM dp WHERE r < 50) SELECT * FROM dp"""))
def exact_signed_rank(spark, sf_dir):
    """Mean errors of the entities, of which there are few: the distribution of the rank sum is counted."""
    rows = B.test_predictions(spark, sf_dir).join(B.frame(spark, sf_dir).select("row_id", "entity"), "row_id")
    losses = rows.groupBy(F.col("entity").alias("row_id"), "model").agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("label"))
    found = X.wilcoxon(X.paired_errors(losses.withColumn("prediction", F.lit(0.0)), B.MODELS), digits=6)
    return rounded(found.drop("z_statistic"))


@query("f13_f14_pair_labels", with_sql("t_tests", f"""SELECT model_a || ' vs ' || model_b AS comparison,
    CASE WHEN t_statistic < 0 THEN model_a ELSE model_b END AS better_model,
    CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM (SELECT *, {t_two_sided_sql('t_statistic', 'n - 1')} AS p FROM t_tests)"""))
def pair_labels(spark, sf_dir):
    found = X.paired_t(X.paired_errors(B.test_predictions(spark, sf_dir), B.MODELS))
    return found.select(
        S.pair_label(F.col("model_a"), F.col("model_b")).alias("comparison"),
        S.better_of(F.col("t_statistic"), F.col("model_a"), F.col("model_b")).alias("better_model"),
        S.yes_no(F.col("p_value") < 0.05).alias("significant"))


INVERSE_NORMAL_SQL = """CASE WHEN p < 0.02425 THEN (((((-7.784894002430293e-3 * l + -3.223964580411365e-1) * l + -2.400758277161838e0) * l + -2.549732539343734e0) * l + 4.374664141464968e0) * l + 2.938163982698783e0)
        / ((((7.784695709041462e-3 * l + 3.224671290700398e-1) * l + 2.445134137142996e0) * l + 3.754408661907416e0) * l + 1)
    WHEN p > 0.97575 THEN -(((((-7.784894002430293e-3 * h + -3.223964580411365e-1) * h + -2.400758277161838e0) * h + -2.549732539343734e0) * h + 4.374664141464968e0) * h + 2.938163982698783e0)
        / ((((7.784695709041462e-3 * h + 3.224671290700398e-1) * h + 2.445134137142996e0) * h + 3.754408661907416e0) * h + 1)
    ELSE (((((-3.969683028665376e1 * c * c + 2.209460984245205e2) * c * c + -2.759285104469687e2) * c * c + 1.383577518672690e2) * c * c + -3.066479806614716e1) * c * c + 2.506628277459239e0) * c
        / (((((-5.447609879822406e1 * c * c + 1.615858368580409e2) * c * c + -1.556989798598866e2) * c * c + 6.680131188771972e1) * c * c + -1.328068155288572e1) * c * c + 1) END"""
NORMAL_PLOT_SQL = f"""SELECT model, e, {INVERSE_NORMAL_SQL} AS z FROM (
    SELECT *, sqrt(-2 * ln(p)) AS l, sqrt(-2 * ln(1 - p)) AS h, p - 0.5 AS c FROM (
    SELECT model, e, CASE WHEN i = n THEN pow(0.5, 1.0::DOUBLE / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0::DOUBLE / n)
           ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p
    FROM (SELECT model, e, row_number() OVER (PARTITION BY model ORDER BY e) AS i, count(*) OVER (PARTITION BY model) AS n FROM test_predictions)))"""


@query("w7_normal_plot", with_sql("test_predictions", "SELECT model, round(e, 4) AS residual, round(z, 6) AS quantile FROM points", points=NORMAL_PLOT_SQL))
def normal_plot(spark, sf_dir):
    plot = X.normal_plot(B.test_predictions(spark, sf_dir))
    return plot.select("model", r("residual", 4).alias("residual"), r("quantile").alias("quantile"))


@query("x9_normal_fit", with_sql("test_predictions", """SELECT model, round(regr_slope(e, z), 4) AS slope, round(regr_intercept(e, z), 4) AS intercept,
    round(sqrt(regr_r2(e, z)), 6) AS r FROM points GROUP BY 1""", points=NORMAL_PLOT_SQL))
def normal_fit(spark, sf_dir):
    found = X.normal_fit(X.normal_plot(B.test_predictions(spark, sf_dir)))
    return found.select("model", r("slope", 4).alias("slope"), r("intercept", 4).alias("intercept"), r("r").alias("r"))


# ------------------------------------------------------------------ importance relations


@query("j8_named_importances", with_sql("model_importances", "SELECT model, feature, round(importance, 6) AS importance FROM model_importances"))
def named_importances(spark, sf_dir):
    found = B.model_importances(spark, sf_dir)
    place = F.array_position(F.array(*[F.lit(f) for f in B.FEATURES]), F.col("feature"))
    vectors = found.groupBy("model").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(place, "importance"))), lambda s: s["importance"]).alias("importances"))
    return rounded(I.name_vector(vectors, tables.feature_list(spark, B.FEATURES)))


@query("j7_rank_pairs", with_sql("feature_ranks", """SELECT a.model AS model_a, b.model AS model_b, a.feature, a.rank AS rank_a, b.rank AS rank_b
    FROM feature_ranks a JOIN feature_ranks b ON a.feature = b.feature"""))
def rank_pairs(spark, sf_dir):
    ranked = B.model_importances(spark, sf_dir).select("model", "feature", tied_rank(["model"], "importance").alias("rank"))
    left = ranked.select(F.col("model").alias("model_a"), "feature", F.col("rank").alias("rank_a"))
    return left.join(ranked.select(F.col("model").alias("model_b"), "feature", F.col("rank").alias("rank_b")), "feature")


@query("w3_tied_ranks", """SELECT user_id, event_type, n, rank() OVER (PARTITION BY event_type ORDER BY n)
    + (count(*) OVER (PARTITION BY event_type, n) - 1) / 2.0::DOUBLE AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def tied_ranks(spark, sf_dir):
    from panelkit.operators.ranks import average_ranks

    counts = B.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranks = average_ranks(counts.withColumn("n", F.col("n").cast("double")), ["event_type"], "n")
    return counts.join(ranks.select("event_type", F.col("n").cast("long").alias("n"), "rank"), ["event_type", "n"]).select(
        "user_id", "event_type", "n", "rank")


@query("w1_rank_numbers", with_sql("cv_summary", """SELECT model, CAST(row_number() OVER (ORDER BY cv_rmse_mean, model) AS INTEGER) AS rank FROM cv_summary"""))
def rank_numbers(spark, sf_dir):
    found = M.cross_validation_summary(B.cv_predictions(spark, sf_dir))
    return found.select("model", small_rank([], [F.col("cv_rmse_mean"), F.col("model")]))


TOP_SQL = """SELECT model, feature, importance, CAST(row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM model_importances"""


@query("w2_top_features", with_sql("model_importances", f"SELECT model, feature, round(importance, 6) AS importance, rank FROM ({TOP_SQL}) WHERE rank <= 3"))
def top_features(spark, sf_dir):
    return rounded(I.top_features(B.model_importances(spark, sf_dir), ["model"], 3)).select("model", "feature", "importance", "rank")


@query("o2_top_n", with_sql("model_importances", """SELECT feature, round(importance, 6) AS importance FROM model_importances
    WHERE model = 'even_year' ORDER BY importance DESC, feature LIMIT 5"""))
def top_n(spark, sf_dir):
    one = B.model_importances(spark, sf_dir).where(F.col("model") == "even_year")
    return rounded(one.orderBy(F.col("importance").desc(), "feature").limit(5).select("feature", "importance"))


SUMMARY = ["mean_importance", "std_importance", "ci_lower", "ci_upper", "ci_width", "cv"]


@query("a17_bootstrap_summary", with_sql("bootstrap", f"SELECT model, feature, {q(SUMMARY)} FROM bootstrap"))
def bootstrap_summary(spark, sf_dir):
    return rounded(I.replicate_summary(B.importances(spark, sf_dir)))


@query("f18_safe_ratio", with_sql("bootstrap", "SELECT feature, count(*) AS n, count(cv) AS known, round(avg(cv), 6) AS cv FROM bootstrap GROUP BY 1"))
def safe_ratio(spark, sf_dir):
    found = I.replicate_summary(B.importances(spark, sf_dir))
    return found.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("cv").alias("known"), r(F.avg("cv")).alias("cv"))


@query("p15_significance", with_sql("bootstrap", "SELECT model, feature, ci_lower > 0 AS significant FROM bootstrap"))
def significance(spark, sf_dir):
    return I.replicate_summary(B.importances(spark, sf_dir)).select("model", "feature", (F.col("ci_lower") > 0).alias("significant"))


@query("a20_significant_count", with_sql("bootstrap", "SELECT model, count(CASE WHEN ci_lower > 0 THEN 1 END) AS significant FROM bootstrap GROUP BY 1"))
def significant_count(spark, sf_dir):
    return I.replicate_summary(B.importances(spark, sf_dir)).groupBy("model").agg(F.count_if(F.col("ci_lower") > 0).alias("significant"))


@query("o3_sorted_importance", with_sql("bootstrap", """SELECT model, feature, CAST(row_number() OVER (ORDER BY mean_importance DESC, feature, model) AS INTEGER) AS place FROM bootstrap"""))
def sorted_importance(spark, sf_dir):
    found = I.replicate_summary(B.importances(spark, sf_dir))
    return found.select("model", "feature", small_rank([], [F.col("mean_importance").desc(), F.col("feature"), F.col("model")], "place")).orderBy("place")


@query("t3_distinct_top", with_sql("model_importances", f"SELECT DISTINCT feature FROM ({TOP_SQL}) WHERE rank <= 4"))
def distinct_top(spark, sf_dir):
    return I.top_features(B.model_importances(spark, sf_dir), ["model"], 4).select("feature").distinct()


@query("o5_feature_axis", with_sql("model_importances", f"SELECT feature, CAST(row_number() OVER (ORDER BY feature) AS INTEGER) AS place FROM (SELECT DISTINCT feature FROM ({TOP_SQL}) WHERE rank <= 4)"))
def feature_axis(spark, sf_dir):
    axis = I.top_features(B.model_importances(spark, sf_dir), ["model"], 4).select("feature").distinct()
    return axis.select("feature", small_rank([], [F.col("feature")], "place")).orderBy("feature")


@query("t2_top_intersection", with_sql("model_importances", f"""SELECT feature FROM ({TOP_SQL}) WHERE rank <= 4 AND model = 'even_year'
    INTERSECT SELECT feature FROM ({TOP_SQL}) WHERE rank <= 4 AND model = 'first_half'"""))
def top_intersection(spark, sf_dir):
    top = I.top_features(B.model_importances(spark, sf_dir), ["model"], 4)
    pick = lambda m: top.where(F.col("model") == m).select("feature")
    return pick("even_year").intersect(pick("first_half"))


@query("j10_semi_top", with_sql("model_importances", f"""SELECT feature, rank FROM ({TOP_SQL}) WHERE rank <= 4 AND model = 'odd_year'
    AND feature IN (SELECT feature FROM ({TOP_SQL}) WHERE rank <= 4 AND model = 'second_half')"""))
def semi_top(spark, sf_dir):
    top = I.top_features(B.model_importances(spark, sf_dir), ["model"], 4)
    other = top.where(F.col("model") == "second_half").select("feature")
    return top.where(F.col("model") == "odd_year").join(other, "feature", "left_semi").select("feature", "rank")


_union = f"(SELECT DISTINCT feature FROM ({TOP_SQL}) WHERE rank <= 2)"


@query("j9_default_zero", with_sql("model_importances", f"""SELECT m.model, u.feature, round(coalesce(t.importance, 0), 6) AS importance
    FROM (SELECT DISTINCT model FROM model_importances) m CROSS JOIN {_union} u
    LEFT JOIN (SELECT * FROM ({TOP_SQL}) WHERE rank <= 2) t ON t.model = m.model AND t.feature = u.feature"""))
def default_zero(spark, sf_dir):
    top = I.top_features(B.model_importances(spark, sf_dir), ["model"], 2)
    return rounded(I.completed(top.select("model", "feature", "importance"), "model", top.select("feature").distinct()))


MATRIX_SQL = with_sql("model_importances", f"""SELECT model, {', '.join(f"round(coalesce(max(CASE WHEN feature = '{f}' THEN importance END), 0), 6) AS {f}" for f in B.FEATURES)}
    FROM model_importances GROUP BY 1""")


@query("a27_importance_matrix", MATRIX_SQL)
def importance_matrix(spark, sf_dir):
    return rounded(I.importance_matrix(B.model_importances(spark, sf_dir), "model", 10))


@query("x4_spearman", with_sql("spearman", "SELECT model_a, model_b, n, round(rho, 6) AS rho FROM spearman"))
def spearman(spark, sf_dir):
    return rounded(X.spearman_matrix(B.model_importances(spark, sf_dir)))


@query("x4b_spearman_p_values", with_sql("spearman", f"""SELECT model_a, model_b, n, round(rho, 6) AS rho, round(CASE WHEN abs(rho) >= 1 THEN 0
    ELSE {t_two_sided_sql('rho * sqrt(n - 2) / sqrt(1 - rho * rho)', 'n - 2')} END, 6) AS p_value FROM spearman"""))
def spearman_p_values(spark, sf_dir):
    return rounded(X.spearman_tests(B.model_importances(spark, sf_dir)))


@query("a19_mean_correlation", with_sql("spearman", "SELECT round(avg(rho), 6) AS mean_correlation FROM spearman WHERE model_a < model_b"))
def mean_correlation(spark, sf_dir):
    matrix = X.spearman_matrix(B.model_importances(spark, sf_dir)).where(F.col("model_a") <= F.col("model_b"))
    return rounded(X.consistency(matrix))


@query("x7_consistency", with_sql("spearman", "SELECT round(avg(rho), 6) AS mean_correlation FROM spearman WHERE model_a <> model_b"))
def consistency(spark, sf_dir):
    return rounded(X.consistency(X.spearman_matrix(B.model_importances(spark, sf_dir))))


CONSENSUS_SQL = f"""SELECT a.feature, (a.rank + b.rank) / 2.0::DOUBLE AS mean_rank FROM ({TOP_SQL}) a JOIN ({TOP_SQL}) b ON a.feature = b.feature
    WHERE a.model = 'even_year' AND b.model = 'odd_year' AND a.rank <= 5 AND b.rank <= 5 ORDER BY 2, 1 LIMIT 3"""


@query("x8_consensus", with_sql("model_importances", CONSENSUS_SQL))
def consensus(spark, sf_dir):
    top = I.top_features(B.model_importances(spark, sf_dir), ["model"], 5)
    pick = lambda m: top.where(F.col("model") == m).select("feature", "rank")
    return I.consensus(pick("even_year"), pick("odd_year"), 5, 3)


# ------------------------------------------------------------------ permutation tests on a fixed predictor

REPS = 50
TESTED = B.FEATURES
# a fixed predictor in which every feature has a part
PARTS = {"n_items": 10.0, "qty_avg": 1.0, "tax_avg": 1000.0, "bal": 0.01, "total": 0.001}
_picked = {f: f"CASE WHEN f.feature = '{f}' THEN m.new_{f} ELSE m.{f} END" for f in TESTED}
_predicted = lambda c: " + ".join([f"({c['price_avg']}) * ({c['disc_avg']})", *[f"{w}::DOUBLE * ({c[f]})" for f, w in PARTS.items()]])
_r2 = "1 - sum((label - p) * (label - p)) / nullif(var_pop(label) * count(*), 0)"
DROPS_SQL = f"""SELECT s.feature, CAST(s.replicate AS INTEGER) AS replicate, b.score - s.score AS score_drop FROM (
    SELECT feature, replicate, {_r2} AS score FROM (
      SELECT f.feature, m.replicate, m.label, {_predicted(_picked)} AS p
      FROM (SELECT k.replicate, b.target AS label, {', '.join(f'b.{f}, k.{f} AS new_{f}' for f in TESTED)}
            FROM (SELECT *, row_number() OVER (ORDER BY md5(concat(row_id, ':base42'))) AS pos FROM split_frame WHERE split = 'test') b
            JOIN (SELECT replicate, {', '.join(TESTED)},
                         row_number() OVER (PARTITION BY replicate ORDER BY md5(concat(row_id, ':perm42:', replicate))) AS pos
                  FROM split_frame CROSS JOIN (SELECT unnest(range({REPS})) AS replicate) WHERE split = 'test') k ON k.pos = b.pos) m
      CROSS JOIN (SELECT unnest({TESTED}) AS feature) f) GROUP BY 1, 2) s
    CROSS JOIN (SELECT {_r2} AS score FROM (SELECT target AS label, {_predicted({f: f for f in TESTED})} AS p FROM split_frame WHERE split = 'test')) b"""


def product_drops(spark, sf_dir, replicates: int = REPS) -> DataFrame:
    from panelkit.operators.splits import with_split

    df = with_split(B.frame(spark, sf_dir), "row_id").where(F.col("split") == "test")
    rest = reduce(add, [F.lit(w) * F.col(f) for f, w in PARTS.items()])
    predict = lambda d: d.withColumn("prediction", F.col("price_avg") * F.col("disc_avg") + rest)
    return permutation_drops(df, "row_id", "target", TESTED, TESTED, predict, replicates)


@query("x6_permutation_drops", with_sql("split_frame", "SELECT feature, replicate, round(score_drop, 6) AS score_drop FROM drops", drops=DROPS_SQL))
def permutation_score_drops(spark, sf_dir):
    return rounded(product_drops(spark, sf_dir))


@query("a18_drop_summary", with_sql("split_frame", """SELECT feature, round(avg(score_drop), 6) AS mean_score_drop,
    round(stddev_pop(score_drop), 6) AS std_score_drop FROM drops GROUP BY 1""", drops=DROPS_SQL))
def drop_summary(spark, sf_dir):
    return rounded(X.drop_summary(product_drops(spark, sf_dir)).select("feature", "mean_score_drop", "std_score_drop"))


T_DROP_SQL = """SELECT feature, round(avg(score_drop) * sqrt(count(*) - 1) / nullif(CASE WHEN stddev_pop(score_drop) > 1e-12 THEN stddev_pop(score_drop) ELSE 0 END, 0), 2) AS t_statistic
    FROM drops GROUP BY 1"""


@query("x3_one_sample_t", with_sql("split_frame", T_DROP_SQL, drops=DROPS_SQL))
def one_sample_t(spark, sf_dir):
    found = X.drop_summary(product_drops(spark, sf_dir))
    return found.select("feature", r(F.when(F.col("std_score_drop") > 1e-12, F.col("t_statistic")), 2).alias("t_statistic"))


TESTED_SQL = f"""SELECT feature, mean_score_drop, std_score_drop, t_statistic, {t_greater_sql('t_statistic', str(REPS - 1))} AS p_value FROM (
    SELECT feature, avg(score_drop) AS mean_score_drop, stddev_pop(score_drop) AS std_score_drop,
           avg(score_drop) * sqrt({REPS - 1}) / nullif(stddev_pop(score_drop), 0) AS t_statistic FROM drops GROUP BY 1)"""


@query("f12_stars", with_sql("split_frame", """SELECT feature, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS stars
    FROM tested""", drops=DROPS_SQL, tested=TESTED_SQL))
def stars(spark, sf_dir):
    return X.drop_summary(product_drops(spark, sf_dir)).select("feature", S.stars(F.col("p_value")).alias("stars"))


# ------------------------------------------------------------------ report relations

COMPARISON_SQL = """SELECT m.model, max(CASE WHEN split = 'train' THEN rmse END) AS train_rmse, max(CASE WHEN split = 'test' THEN rmse END) AS test_rmse,
    max(CASE WHEN split = 'train' THEN r2 END) AS train_r2, max(CASE WHEN split = 'test' THEN r2 END) AS test_r2,
    max(cv_rmse_mean) AS cv_rmse, max(CASE WHEN split = 'train' THEN rmse END) - max(CASE WHEN split = 'test' THEN rmse END) AS overfit_gap
    FROM metrics m LEFT JOIN cv_summary c ON c.model = m.model GROUP BY 1"""
COMPARISON = ["train_rmse", "test_rmse", "train_r2", "test_r2", "cv_rmse", "overfit_gap"]


def comparison(spark, sf_dir) -> DataFrame:
    return R.comparison_table(B.predictions(spark, sf_dir), B.cv_predictions(spark, sf_dir))


@query("q1_model_comparison", with_sql(["metrics", "cv_summary"], f"SELECT model, {q(COMPARISON, 3)} FROM c", c=COMPARISON_SQL))
def model_comparison(spark, sf_dir):
    return rounded(comparison(spark, sf_dir), 3)


COMPREHENSIVE_SQL = """SELECT e.model, max(CASE WHEN split = 'train' THEN rmse END) AS train_rmse, max(CASE WHEN split = 'test' THEN rmse END) AS test_rmse,
    max(CASE WHEN split = 'train' THEN mae END) AS train_mae, max(CASE WHEN split = 'test' THEN mae END) AS test_mae,
    max(CASE WHEN split = 'test' THEN mape END) AS test_mape, max(CASE WHEN split = 'train' THEN r2 END) AS train_r2,
    max(CASE WHEN split = 'test' THEN r2 END) AS test_r2, max(cv_rmse_mean) AS cv_rmse, max(cv_r2_mean) AS cv_r2_mean,
    max(cv_r2_std) AS cv_r2_std, max(CASE WHEN split = 'train' THEN rmse END) - max(CASE WHEN split = 'test' THEN rmse END) AS overfit_gap,
    max(CASE WHEN split = 'test' THEN max_error END) AS max_error, max(CASE WHEN split = 'test' THEN median_abs_error END) AS median_abs_error
    FROM extended e LEFT JOIN cv_summary c ON c.model = e.model GROUP BY 1"""
COMPREHENSIVE = ["train_rmse", "test_rmse", "train_mae", "test_mae", "test_mape", "train_r2", "test_r2", "cv_rmse",
                 "cv_r2_mean", "cv_r2_std", "overfit_gap", "max_error", "median_abs_error"]


@query("q2_comprehensive_metrics", with_sql(["extended", "cv_summary"], f"SELECT model, {q(COMPREHENSIVE, 3)} FROM c", c=COMPREHENSIVE_SQL))
def comprehensive(spark, sf_dir):
    return rounded(R.comprehensive_table(B.predictions(spark, sf_dir), B.cv_predictions(spark, sf_dir)), 3)


@query("q3_pairwise_tests", with_sql(["t_tests", "wilcoxon"], """SELECT t.model_a || ' vs ' || t.model_b AS comparison, round(t_statistic, 6) AS t_statistic,
    CASE WHEN t_statistic < 0 THEN t.model_a ELSE t.model_b END AS better_model, round(w_statistic, 2) AS w_statistic
    FROM t_tests t LEFT JOIN wilcoxon w ON w.model_a = t.model_a AND w.model_b = t.model_b"""))
def pairwise_tests(spark, sf_dir):
    found = X.model_comparison_tests(B.test_predictions(spark, sf_dir), B.MODELS, digits=6)
    return found.select("comparison", r("t_statistic").alias("t_statistic"), "better_model", r("w_statistic", 2).alias("w_statistic"))


@query("q3b_pairwise_tests_full", with_sql(["t_tests", "wilcoxon", "wilcoxon_p"], f"""SELECT model_a || ' vs ' || model_b AS comparison, round(t_statistic, 6) AS t_statistic,
    round(p, 6) AS p_value, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant, CASE WHEN t_statistic < 0 THEN model_a ELSE model_b END AS better_model,
    round(w_statistic, 2) AS w_statistic, round(w_p_value, 6) AS w_p_value, CASE WHEN w_p_value < 0.05 THEN 'Yes' ELSE 'No' END AS w_significant
    FROM (SELECT t.*, {t_two_sided_sql('t_statistic', 'n - 1')} AS p, w_statistic, w_p_value FROM t_tests t
          LEFT JOIN wilcoxon w ON w.model_a = t.model_a AND w.model_b = t.model_b
          LEFT JOIN wilcoxon_p v ON v.model_a = t.model_a AND v.model_b = t.model_b)"""))
def pairwise_tests_full(spark, sf_dir):
    found = X.model_comparison_tests(B.test_predictions(spark, sf_dir), B.MODELS, digits=6)
    return rounded(found.withColumn("w_statistic", r("w_statistic", 2)))


@query("q4_band_performance", with_sql("test_predictions", f"""SELECT segment AS "Segment", model AS "Model", n AS "N Samples", round(rmse, 4) AS "RMSE",
    round(mae, 4) AS "MAE", round(r2, 6) AS "R2" FROM (SELECT {BAND_SQL} AS segment, model, {B.metric_columns()} FROM test_predictions GROUP BY 1, 2)"""))
def band_performance(spark, sf_dir):
    found = M.band_metrics(B.test_predictions(spark, sf_dir), B.BANDS)
    return found.select(F.col("segment").alias("Segment"), F.col("model").alias("Model"), F.col("n").alias("N Samples"),
                        r("rmse", 4).alias("RMSE"), r("mae", 4).alias("MAE"), r("r2").alias("R2"))


SEGMENT_RESULT_SQL = f"""SELECT segment, model, n, rmse, r2, mean, std FROM (
    SELECT coalesce(label_text, 'Other') AS segment, model, {B.metric_columns()}, avg(label) AS mean, stddev_pop(label) AS std
    FROM (SELECT p.*, f.entity, d.label AS label_text FROM test_predictions p JOIN frame f ON f.row_id = p.row_id
          LEFT JOIN region_dim d ON d.code = f.entity) GROUP BY 1, 2)"""


def segment_results(spark, sf_dir) -> DataFrame:
    """Scores per region and model of the fixed predictors on test rows."""
    where = segments.lookup_segment(B.frame(spark, sf_dir).select("row_id", "entity"), "entity", B.region_dimension(spark, sf_dir))
    labelled = B.test_predictions(spark, sf_dir).join(where.select("row_id", "segment"), "row_id")
    return labelled.groupBy("segment", "model").agg(
        F.count(F.lit(1)).alias("n"), M.rmse().alias("rmse"), M.r2().alias("r2"), F.avg("label").alias("mean"),
        F.stddev_pop("label").alias("std"))


@query("p20_filtered_results", with_sql(["test_predictions", "region_dim"], "SELECT segment, model, n, round(rmse, 2) AS rmse FROM s WHERE model IN ('m_lin', 'm_prod')", s=SEGMENT_RESULT_SQL))
def filtered_results(spark, sf_dir):
    kept = segment_results(spark, sf_dir).where(F.col("model").isin("m_lin", "m_prod"))
    first = kept.withColumn("copy", small_rank(["segment", "model"], [F.col("rmse")], "copy")).where(F.col("copy") == 1)
    return first.select("segment", "model", "n", r("rmse", 2).alias("rmse"))


TOP_MODELS = ["m_prod", "m_lin", "m_entity"]
SEGMENT_TABLE_SQL = f"""SELECT segment, i AS row_in_segment, CASE WHEN i = 1 THEN segment ELSE '' END AS label, model, n, round(rmse, 2) AS rmse, round(r2, 3) AS r2
    FROM (SELECT *, CAST(list_position({TOP_MODELS}, model) AS INTEGER) AS i FROM s WHERE model IN ({', '.join(repr(m) for m in TOP_MODELS)}))"""


@query("q12_segment_table", with_sql(["test_predictions", "region_dim"], SEGMENT_TABLE_SQL, s=SEGMENT_RESULT_SQL))
def segment_table(spark, sf_dir):
    found = R.segment_table(segment_results(spark, sf_dir), TOP_MODELS)
    return found.select("segment", "row_in_segment", "label", "model", "n", r("rmse", 2).alias("rmse"), r("r2", 3).alias("r2"))


@query("w8_first_row_label", with_sql(["test_predictions", "region_dim"],
    "SELECT segment, model, CASE WHEN row_number() OVER (PARTITION BY segment ORDER BY model) = 1 THEN segment END AS label FROM s", s=SEGMENT_RESULT_SQL))
def first_row_label(spark, sf_dir):
    found = segment_results(spark, sf_dir)
    first = small_rank(["segment"], [F.col("model")], "place")
    return found.withColumn("place", first).select("segment", "model", F.when(F.col("place") == 1, F.col("segment")).alias("label"))


@query("q6_bootstrap_table", with_sql("bootstrap", f"SELECT feature, {q(SUMMARY)} FROM bootstrap WHERE model = 'even_year'"))
def bootstrap_table(spark, sf_dir):
    one = B.importances(spark, sf_dir).where(F.col("model") == "even_year")
    return rounded(I.replicate_summary(one, ["feature"]).orderBy(F.col("mean_importance").desc(), "feature"))


@query("q7_permutation_table", with_sql(["split_frame", "model_importances"], """SELECT d.feature, round(max(i.importance), 6) AS baseline_importance,
    max(round(mean_score_drop, 6)) AS mean_score_drop, max(round(std_score_drop, 6)) AS std_score_drop, max(round(t_statistic, 2)) AS t_statistic,
    max(round(p_value, 6)) AS p_value, bool_or(p_value < 0.05) AS significant
    FROM tested d JOIN model_importances i ON i.feature = d.feature AND i.model = 'even_year' GROUP BY 1""", drops=DROPS_SQL, tested=TESTED_SQL))
def permutation_table(spark, sf_dir):
    base = B.model_importances(spark, sf_dir).where(F.col("model") == "even_year")
    found = X.drop_summary(product_drops(spark, sf_dir)).join(base.select("feature", F.col("importance").alias("baseline_importance")), "feature")
    return rounded(found.select("feature", "baseline_importance", "mean_score_drop", "std_score_drop", r("t_statistic", 2).alias("t_statistic"),
                                "p_value", "significant"))


GROUPS = ["even_year", "first_half", "odd_year", "second_half"]


@query("q8_consistency_matrix", with_sql("spearman", f"""SELECT model_a AS model, {', '.join(f"round(max(CASE WHEN model_b = '{g}' THEN rho END), 6) AS {g}" for g in GROUPS)} FROM spearman GROUP BY 1"""))
def consistency_matrix(spark, sf_dir):
    matrix = X.spearman_matrix(B.model_importances(spark, sf_dir))
    return rounded(M.pivot_metric(matrix, "model_a", "model_b", "rho", GROUPS).withColumnRenamed("model_a", "model"))


@query("q9_descriptive_table", with_sql("frame_nulls", f"""SELECT {P.display_sql('d.variable')} AS "Variable", n AS "N", round(mean, 4) AS "Mean", round(std, 4) AS "SD",
    round(min, 4) AS "Min", round(max, 4) AS "Max", round(missing_pct, 2) AS "Missing %" FROM ({P.describe_sql('frame_nulls', [*P.NULLABLE, 'target'])}) d"""))
def descriptive_report(spark, sf_dir):
    from panelkit.operators.lookup import display_name

    found = quality.describe(B.frame_nulls(spark, sf_dir), [*P.NULLABLE, "target"])
    named = display_name(rounded(found), "variable", P.name_dimension(spark))
    return named.select(F.col("display").alias("Variable"), F.col("n").alias("N"), r("mean", 4).alias("Mean"), r("std", 4).alias("SD"),
                        r("min", 4).alias("Min"), r("max", 4).alias("Max"), r("missing_pct", 2).alias("Missing %"))


@query("q10_performance_table", with_sql(["metrics", "cv_summary"], f"""SELECT {P.label_sql('c.model')} AS model_name, round(train_rmse, 2) AS train_rmse,
    round(test_rmse, 2) AS test_rmse, round(test_r2, 3) AS test_r2, round(cv_rmse, 2) AS cv_rmse FROM c""", c=COMPARISON_SQL))
def performance_table(spark, sf_dir):
    return R.performance_table(comparison(spark, sf_dir), P.label_dimension(spark))


@query("q11_feature_table", with_sql("model_importances", f"SELECT rank, {P.display_sql('t.feature')} AS display, round(importance, 6) AS importance FROM ({TOP_SQL}) t WHERE model = 'odd_year' AND rank <= 10"))
def feature_table(spark, sf_dir):
    one = B.model_importances(spark, sf_dir).where(F.col("model") == "odd_year")
    return rounded(R.feature_table(one, P.name_dimension(spark)))


@query("q13_summary_sentence", with_sql("frame", """SELECT printf('target: average %.1f (sd %.1f, between %.1f and %.1f); price_avg: average %.0f (sd %.0f)',
    avg(target), stddev_samp(target), min(target), max(target), avg(price_avg), stddev_samp(price_avg)) AS summary FROM frame"""))
def summary_sentence(spark, sf_dir):
    return R.summary_sentence(B.frame(spark, sf_dir), "target", "price_avg")


@query("q14_plot_points", with_sql("test_predictions", f"SELECT row_id, model, {q(['label', 'prediction'], 4)}, round(e, 4) AS residual FROM test_predictions"))
def plot_points(spark, sf_dir):
    return rounded(B.test_predictions(spark, sf_dir).withColumn("residual", M.error()), 4)


@query("q15_metric_bars", with_sql("extended", "SELECT model, split, metric, round(value, 4) AS value FROM (UNPIVOT (SELECT model, split, rmse, mae, r2, mape FROM extended) ON rmse, mae, r2, mape INTO NAME metric VALUE value)"))
def metric_bars(spark, sf_dir):
    found = M.extended_metrics(B.predictions(spark, sf_dir))
    return rounded(found.unpivot(["model", "split"], ["rmse", "mae", "r2", "mape"], "metric", "value"), 4)


@query("q16_band_pivot", PIVOT_SQL)
def band_pivot(spark, sf_dir):
    found = M.band_metrics(B.test_predictions(spark, sf_dir), B.BANDS)
    return rounded(M.pivot_metric(found, "segment", "model", "rmse", B.MODELS), 4)


@query("q17_interval_bars", with_sql("bootstrap", """SELECT short_name, round(mean_importance, 6) AS mean_importance, round(mean_importance - ci_lower, 6) AS below,
    round(ci_upper - mean_importance, 6) AS above FROM (SELECT *, CASE WHEN length(feature) > 5 THEN substr(feature, 1, 5) || '...' ELSE feature END AS short_name
    FROM bootstrap WHERE model = 'first_half' ORDER BY mean_importance DESC, feature LIMIT 5)"""))
def interval_bars(spark, sf_dir):
    one = B.importances(spark, sf_dir).where(F.col("model") == "first_half")
    top = I.replicate_summary(one, ["feature"]).orderBy(F.col("mean_importance").desc(), "feature").limit(5)
    return top.select(
        S.ellipsis(F.col("feature"), 5).alias("short_name"), r("mean_importance").alias("mean_importance"),
        r(F.col("mean_importance") - F.col("ci_lower")).alias("below"), r(F.col("ci_upper") - F.col("mean_importance")).alias("above"))


@query("q18_comparison_report", with_sql(["extended", "cv_summary", "metrics"], """SELECT CAST(row_number() OVER (ORDER BY section, place, line) AS INTEGER) AS line_no, line FROM (
    SELECT 1 AS section, p AS place, printf('winner on %s is %s, at %.3f', metric, best_model, best_value) AS line FROM (
      SELECT 1 AS p, 'rmse' AS metric, min_by(model, rmse) AS best_model, min(rmse) AS best_value FROM extended WHERE split = 'test' UNION ALL
      SELECT 2, 'mae', min_by(model, mae), min(mae) FROM extended WHERE split = 'test' UNION ALL
      SELECT 3, 'r2', max_by(model, r2), max(r2) FROM extended WHERE split = 'test' UNION ALL
      SELECT 4, 'mape', min_by(model, mape), min(mape) FROM extended WHERE split = 'test')
    UNION ALL SELECT 2, rank, printf('place %d, %s: r2=%.4f rmse=%.4f mae=%.4f on the test rows, train less test rmse=%.4f', rank, model, test_r2, test_rmse, test_mae, overfit_gap)
      FROM (SELECT c.*, e.mae AS test_mae, row_number() OVER (ORDER BY test_r2 DESC, c.model) AS rank FROM c JOIN extended e ON e.model = c.model AND e.split = 'test')
    UNION ALL SELECT 3, 0, 'choice by r2: ' || max_by(model, test_r2) FROM c
    UNION ALL SELECT 4, 0, 'choice among simple models: ' || min_by(model, test_rmse) FROM c WHERE model LIKE '%lin%')""", c=COMPARISON_SQL))
def comparison_report(spark, sf_dir):
    found = M.extended_metrics(B.predictions(spark, sf_dir))
    return R.comparison_report(found, comparison(spark, sf_dir), "lin")


@query("s12_text_report", with_sql("bootstrap", """SELECT printf('%d. %s: %.4f [%.4f, %.4f]', row_number() OVER (ORDER BY mean_importance DESC, feature), feature, mean_importance, ci_lower, ci_upper) AS line
    FROM bootstrap WHERE model = 'odd_year'"""))
def text_report(spark, sf_dir):
    one = I.replicate_summary(B.importances(spark, sf_dir).where(F.col("model") == "odd_year"), ["feature"])
    ranked = one.withColumn("line_no", small_rank([], [F.col("mean_importance").desc(), F.col("feature")], "line_no"))
    lines = ranked.select("line_no", F.format_string("%d. %s: %.4f %s", F.col("line_no"), F.col("feature"), F.col("mean_importance"),
                                                     S.interval(F.col("ci_lower"), F.col("ci_upper"))).alias("line"))
    path = fresh_path(spark, "report")
    tables.write_report(lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("q19_segmentation_report", with_sql(["test_predictions", "region_dim", "frame"], """SELECT CAST(row_number() OVER (ORDER BY segment, block, place) AS INTEGER) AS line_no, line FROM (
    SELECT DISTINCT segment, 0 AS block, 0 AS place, printf('[%s] rows=%d, target average=%.2f, sd=%.2f', segment, n, mean, std) AS line FROM (SELECT segment, max(n) AS n, arg_max(mean, n) AS mean, arg_max(std, n) AS std FROM s GROUP BY 1)
    UNION ALL SELECT segment, 1, row_number() OVER (PARTITION BY segment ORDER BY model), printf('  %s: RMSE=%.2f, R2=%.3f', model, rmse, r2) FROM s
    UNION ALL SELECT segment, 2, rank, printf('  %d. %s: %.4f', rank, feature, importance) FROM (
      SELECT *, row_number() OVER (PARTITION BY segment ORDER BY importance DESC, feature) AS rank FROM g) WHERE rank <= 3)""",
    s=SEGMENT_RESULT_SQL, sq=f"""SELECT coalesce(label, 'Other') AS segment, {', '.join(f'coalesce(pow(corr({f}, target), 2), 0) AS {f}' for f in B.FEATURES)}
        FROM frame LEFT JOIN region_dim ON code = entity GROUP BY 1""",
    g=" UNION ALL ".join(f"SELECT segment, '{f}' AS feature, {f} / ({' + '.join(B.FEATURES)}) AS importance FROM sq" for f in B.FEATURES)))
def segmentation_report(spark, sf_dir):
    labelled = segments.lookup_segment(B.frame(spark, sf_dir), "entity", B.region_dimension(spark, sf_dir))
    found = I.correlation_importance(labelled, B.FEATURES, "target", ["segment"])
    return R.segmentation_report(segment_results(spark, sf_dir), found, 3)


@query("q20_statistical_report", with_sql(["bootstrap", "spearman", "split_frame", "model_importances"], f"""SELECT CAST(row_number() OVER (ORDER BY section, place, line) AS INTEGER) AS line_no, line FROM (
    SELECT 1 AS section, rank AS place, printf('%d %s %.4f [%.4f, %.4f]', rank, feature, mean_importance, ci_lower, ci_upper) AS line
      FROM (SELECT *, row_number() OVER (ORDER BY mean_importance DESC, feature) AS rank FROM bootstrap WHERE model = 'even_year')
    UNION ALL SELECT 2, rank, printf('%d %s %.4f %s', rank, feature, m, CASE WHEN p_value < 0.05 THEN 'Yes' ELSE 'No' END)
      FROM (SELECT feature, m, p_value, row_number() OVER (ORDER BY m DESC, feature) AS rank FROM (SELECT feature, p_value, round(mean_score_drop, 9) AS m FROM tested))
    UNION ALL SELECT 3, row_number() OVER (ORDER BY model_a, model_b), printf('%s / %s %.3f', model_a, model_b, rho) FROM spearman
    UNION ALL SELECT 4, 0, printf('lower interval end above zero: %d features', count(CASE WHEN ci_lower > 0 THEN 1 END)) FROM bootstrap WHERE model = 'even_year'
    UNION ALL SELECT 5, 0, printf('score drop with p below 0.05: %d features', count(CASE WHEN p_value < 0.05 THEN 1 END)) FROM tested
    UNION ALL SELECT 6, 0, printf('rank agreement between models, averaged: %.3f', avg(rho)) FROM spearman WHERE model_a <> model_b
    UNION ALL SELECT 7, row_number() OVER (ORDER BY mean_rank, feature), feature FROM ({CONSENSUS_SQL}))""", drops=DROPS_SQL, tested=TESTED_SQL))
def statistical_report(spark, sf_dir):
    drops = X.drop_summary(product_drops(spark, sf_dir)).withColumn("mean_score_drop", r("mean_score_drop", 9))
    top = I.top_features(B.model_importances(spark, sf_dir), ["model"], 5)
    pick = lambda m: top.where(F.col("model") == m).select("feature", "rank")
    intervals = I.replicate_summary(B.importances(spark, sf_dir).where(F.col("model") == "even_year"), ["feature"])
    matrix = X.spearman_matrix(B.model_importances(spark, sf_dir))
    return R.statistical_report(intervals, drops, matrix, I.consensus(pick("even_year"), pick("odd_year"), 5, 3))
