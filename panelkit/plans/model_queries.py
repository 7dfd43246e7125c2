"""Queries that train models, all at their default settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.models import boosting as H
from panelkit.models import trees as T
from panelkit.operators import importance as I
from panelkit.operators import inference as X
from panelkit.operators import metrics as M
from panelkit.operators import segments
from panelkit.operators.permutation import permutation_importance
from panelkit.operators.splits import with_split
from panelkit.plans import frames as B
from panelkit.plans.catalog import query, r, rounded
from panelkit.plans.frames import with_sql
from panelkit.plans.reuse import reuse, reuse_parts
from panelkit.session import fresh_path
from panelkit.sources import bundles
from panelkit.sources import fixed_values as fixed

_models: dict[tuple[str, str, str], T.TreeModel] = {}


def split_rows(spark, sf_dir) -> DataFrame:
    return B.written(spark, sf_dir, "model-rows", lambda: with_split(
        B.frame(spark, sf_dir).select("row_id", "entity", "price_avg", *[f for f in B.FEATURES if f != "price_avg"], "target"), "row_id"))


def train_rows(spark, sf_dir) -> DataFrame:
    return split_rows(spark, sf_dir).where(F.col("split") == "train")


def fitted_all(spark, sf_dir, keys) -> dict[str, T.TreeModel]:
    place = (spark.sparkContext.applicationId, f"{sf_dir} {B.state(spark, sf_dir)}")
    missing = [k for k in keys if (*place, k) not in _models]
    if missing:
        found = T.train_together(missing, train_rows(spark, sf_dir), B.FEATURES, "target", "row_id")
        _models.update({(*place, k): model for k, model in found.items()})
    return {k: _models[*place, k] for k in keys}


def fitted(spark, sf_dir, key: str) -> T.TreeModel:
    return fitted_all(spark, sf_dir, [key])[key]


def forget_models() -> None:
    _models.clear()


def model_metrics(spark, sf_dir, keys) -> DataFrame:
    models = fitted_all(spark, sf_dir, keys)
    return M.regression_metrics(T.predict_long(models, split_rows(spark, sf_dir), "row_id", "target"))


def _training_query(name: str, key: str) -> None:
    @query(name)
    def run(spark, sf_dir):
        return model_metrics(spark, sf_dir, [key])


for _name, _key in (("m1_decision_tree", "decision_tree"), ("m2_random_forest", "random_forest"),
                    ("m3_gradient_boosting", "gradient_boosting"), ("m4_depthwise_boosting", "xgboost"),
                    ("m5_leafwise_boosting", "lightgbm")):
    _training_query(_name, _key)


#: Some of the points that the boosted model's grid has.
BOOSTED_GRID = {"max_depth": [3, 5], "learning_rate": [0.05, 0.1], "n_estimators": [100]}


def searched(spark, sf_dir, key: str, grid: dict) -> DataFrame:
    return B.written(spark, sf_dir, f"grid-{key}", lambda: T.grid_search(key, train_rows(spark, sf_dir), B.FEATURES, "target", "row_id", grid)[1])


@query("m6_grid_search")
def grid_search(spark, sf_dir):
    return searched(spark, sf_dir, "decision_tree", fixed.GRIDS["decision_tree"])


@query("m6b_batched_grid_search")
def batched_grid_search(spark, sf_dir):
    return searched(spark, sf_dir, "xgboost", BOOSTED_GRID)


@query("m6c_grid_checks", with_sql("split_frame", """SELECT model, points, points AS fits, true AS beat_mean FROM
    (SELECT unnest(['decision_tree', 'xgboost']) AS model, unnest([24, 4]) :: BIGINT AS points)"""))
def grid_checks(spark, sf_dir):
    """Every point is a fit of its own, and better than the variance of the target."""
    spread = train_rows(spark, sf_dir).agg(F.var_pop("target")).first()[0]
    found = grid_search(spark, sf_dir).withColumn("model", F.lit("decision_tree")).unionByName(
        batched_grid_search(spark, sf_dir).withColumn("model", F.lit("xgboost")))
    return found.groupBy("model").agg(F.count("*").alias("points"), F.countDistinct("params").alias("fits"), (F.max("cv_mse") < spread).alias("beat_mean"))


@query("m7_default_fit")
def default_fit(spark, sf_dir):
    return model_metrics(spark, sf_dir, T.KEYS)


@query("m7b_default_sizes", f"""SELECT unnest({list(T.KEYS)}) AS model, unnest([1, 200, 200, 200, 200]) :: BIGINT AS trees, true AS within_depth, true AS within_leaves""")
def default_sizes(spark, sf_dir):
    """Trees of the default models, none deeper or with more leaves than its settings say."""
    rows = []
    for key, model in fitted_all(spark, sf_dir, T.KEYS).items():
        setting, trees = model.boosted.params[0], model.boosted.sums[0]
        leaves = setting.num_leaves or 1 << 62
        rows.append((key, len(trees), all(t["depth"] <= setting.depth_limit for t in trees), all(t["leaves"] <= leaves for t in trees)))
    return spark.createDataFrame(rows, "model string, trees long, within_depth boolean, within_leaves boolean")


def cross_validated(spark, sf_dir) -> DataFrame:
    """Out-of-fold predictions of all five models."""
    def build():
        return reduce(DataFrame.unionByName, T.cross_validate_all(T.KEYS, train_rows(spark, sf_dir), B.FEATURES, "target", "row_id"))

    return B.written(spark, sf_dir, "cross-validated", build)


@query("m8_cross_validation")
def cross_validation(spark, sf_dir):
    return M.cross_validation_summary(cross_validated(spark, sf_dir))


@query("m8b_fold_checks", with_sql("split_frame", f"""SELECT model, CAST(fold AS INTEGER) AS fold, count(*) AS n, true AS beats_mean FROM (
    SELECT model, CAST(('0x' || substr(md5(concat(row_id, ':fold42')), 1, 8)) AS BIGINT) % 5 AS fold FROM split_frame
    CROSS JOIN (SELECT unnest({list(T.KEYS)}) AS model) WHERE split = 'train') GROUP BY 1, 2"""))
def fold_checks(spark, sf_dir):
    """Each fold is predicted once by a model that did not see it."""
    found = cross_validated(spark, sf_dir).groupBy("model", "fold").agg(F.count("prediction").alias("n"), M.r2().alias("r2"))
    return found.select("model", "fold", "n", (F.col("r2") > 0).alias("beats_mean"))


@query("m9_predictions", with_sql("frame", f"SELECT row_id, model FROM frame CROSS JOIN (SELECT unnest({list(T.KEYS)}) AS model)"))
def model_predictions(spark, sf_dir):
    models = fitted_all(spark, sf_dir, T.KEYS)
    scored = T.predict_long(models, split_rows(spark, sf_dir), "row_id", "target")
    return scored.where(F.col("prediction").isNotNull()).select("row_id", "model")


@query("m10_importances")
def model_importances(spark, sf_dir):
    return T.importances_long(fitted_all(spark, sf_dir, T.KEYS), spark)


@query("m10b_importance_sums", f"SELECT unnest({list(T.KEYS)}) AS model, 1.0::DOUBLE AS total, 7::BIGINT AS features")
def importance_sums(spark, sf_dir):
    return model_importances(spark, sf_dir).groupBy("model").agg(
        F.round(F.sum("importance"), 6).alias("total"), F.count(F.lit(1)).alias("features"))


@query("m11_train_all")
def train_all(spark, sf_dir):
    return model_metrics(spark, sf_dir, list(T.KEYS))


@query("m11b_model_checks", with_sql("split_frame", f"""SELECT model, split, count(*) AS n, true AS beats_mean
    FROM split_frame CROSS JOIN (SELECT unnest({list(T.KEYS)}) AS model) GROUP BY 1, 2"""))
def model_checks(spark, sf_dir):
    """Every model scores all rows of both splits, and better than the mean does."""
    return model_metrics(spark, sf_dir, list(T.KEYS)).select("model", "split", "n", (F.col("r2") > 0).alias("beats_mean"))


def regional(spark, sf_dir) -> DataFrame:
    return segments.lookup_segment(B.frame(spark, sf_dir).select("row_id", "entity", "target", *B.FEATURES), "entity", B.region_dimension(spark, sf_dir))


def by_income(spark, sf_dir) -> DataFrame:
    """Rows with the quartile of their mean price as income segment."""
    rows = B.frame(spark, sf_dir).select("row_id", "target", *B.FEATURES)
    return segments.quartile_segment(rows, "price_avg", fixed.INCOME_LABELS, "segment")


SEGMENT_MODELS = tuple(T.SEGMENT_DEFAULTS)


def segment_training(spark, sf_dir, rows=regional):
    """Test predictions of all models of all segments."""
    return B.written(spark, sf_dir, f"segments-{rows.__name__}", lambda: T.train_segments(
        rows(spark, sf_dir), "segment", B.FEATURES, "target", "row_id", SEGMENT_MODELS)[0])


@query("m12_segment_models")
def segment_models(spark, sf_dir):
    return M.regression_metrics(segment_training(spark, sf_dir), ["segment", "model"])


@query("m12b_segment_test_rows", with_sql(["frame", "region_dim"], f"""SELECT segment, model, count(*) AS n FROM (
    SELECT row_id, segment, least(0.2::DOUBLE, greatest(0.1::DOUBLE, 10.0::DOUBLE / count(*) OVER (PARTITION BY segment))) AS f
    FROM (SELECT row_id, coalesce(label, 'Other') AS segment FROM frame LEFT JOIN region_dim ON code = entity))
    CROSS JOIN (SELECT unnest({list(SEGMENT_MODELS)}) AS model) WHERE CAST(('0x' || substr(md5(concat(row_id, ':42')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE >= 1 - f GROUP BY 1, 2"""))
def segment_test_rows(spark, sf_dir):
    scored = segment_training(spark, sf_dir)
    return scored.where(F.col("prediction").isNotNull()).groupBy("segment", "model").agg(F.count(F.lit(1)).alias("n"))


_sizes_sql = """SELECT segment_type, segment, model, n, round(mean, 4) AS mean, round(std, 4) AS std, true AS beats_mean FROM (
    SELECT 'Region' AS segment_type, coalesce(label, 'Other') AS segment, count(*) AS n, avg(target) AS mean, stddev_pop(target) AS std
    FROM frame LEFT JOIN region_dim ON code = entity GROUP BY 1, 2
    UNION ALL SELECT 'Income', CASE WHEN price_avg <= q1 THEN 'Low Income' WHEN price_avg <= q2 THEN 'Lower-Middle Income'
           WHEN price_avg <= q3 THEN 'Upper-Middle Income' ELSE 'High Income' END, count(*), avg(target), stddev_pop(target)
    FROM frame, (SELECT quantile_cont(price_avg, 0.25) AS q1, quantile_cont(price_avg, 0.5) AS q2, quantile_cont(price_avg, 0.75) AS q3 FROM frame) GROUP BY 1, 2)
    CROSS JOIN (SELECT unnest({models}) AS model)"""


def segment_table(spark, sf_dir) -> DataFrame:
    parts = []
    for name, rows in (("Region", regional), ("Income", by_income)):
        sizes = segments.segment_summary(rows(spark, sf_dir), "segment", "target")
        found = M.regression_metrics(segment_training(spark, sf_dir, rows), ["segment", "model"]).drop("n").join(sizes, "segment")
        parts.append(found.withColumn("segment_type", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query("q5b_segment_checks", with_sql(["frame", "region_dim"], _sizes_sql.format(models=list(SEGMENT_MODELS))))
def segment_checks(spark, sf_dir):
    """All models per region and income quartile, with the segment's size, and better than its mean."""
    return segment_table(spark, sf_dir).select(
        "segment_type", "segment", "model", "n", r("mean", 4).alias("mean"), r("std", 4).alias("std"), (F.col("r2") > 0).alias("beats_mean"))


@query("q5_segment_results")
def segment_results(spark, sf_dir):
    return segment_table(spark, sf_dir).select("segment_type", "segment", "n", "mean", "std", "model", "rmse", "mae", "r2")


#: Settings of the bootstrap's models, and how many of them.
BOOTSTRAP = {"n_estimators": 100, "max_depth": 5, "learning_rate": 0.1}


def replicates(spark, sf_dir) -> DataFrame:
    return B.written(spark, sf_dir, "bootstrap", lambda: T.bootstrap_importances(
        "xgboost", train_rows(spark, sf_dir), B.FEATURES, "target", "row_id", B.REPLICATES, BOOTSTRAP))


@query("x5_bootstrap_intervals")
def bootstrap_intervals(spark, sf_dir):
    return I.replicate_summary(replicates(spark, sf_dir)).orderBy(F.col("mean_importance").desc(), "feature")


@query("x5b_replicate_checks", f"SELECT CAST(unnest(range({B.REPLICATES})) AS INTEGER) AS replicate, {len(B.FEATURES)}::BIGINT AS features, 1.0::DOUBLE AS total")
def replicate_checks(spark, sf_dir):
    """Every replicate rates every feature, and its importances sum to one."""
    return replicates(spark, sf_dir).groupBy("replicate").agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"))


@query("x6b_model_permutation")
def model_permutation(spark, sf_dir):
    model = fitted(spark, sf_dir, "xgboost")
    test = split_rows(spark, sf_dir).where(F.col("split") == "test")
    return permutation_importance(test, "row_id", "target", B.FEATURES, model.importances(spark), T.predictor(model), 50, len(B.FEATURES))


@query("x4c_model_consistency")
def model_consistency(spark, sf_dir):
    return X.spearman_tests(model_importances(spark, sf_dir))


@query("u3_result_reuse", with_sql("frame", "SELECT entity, count(*) AS n FROM frame GROUP BY 1"))
def result_reuse(spark, sf_dir):
    folder = fresh_path(spark, "results")
    data = B.frame(spark, sf_dir).select("row_id", "entity")
    build = lambda: data.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    reuse(spark, folder, data, {"by": "entity"}, build)
    # the second call must find the stored table and build nothing
    return reuse(spark, folder, data, {"by": "entity"}, lambda: data.where(F.lit(False)).groupBy("entity").agg(F.count(F.lit(1)).alias("n")))


@query("u3b_partial_reuse", with_sql("frame", """SELECT CAST(part AS INTEGER) AS replicate, n, CASE WHEN part < 3 THEN 1 ELSE 2 END AS built_in
    FROM (SELECT count(*) AS n FROM frame) CROSS JOIN (SELECT unnest(range(5)) AS part)"""))
def partial_reuse(spark, sf_dir):
    """Three stored parts of five: the second call builds the other two."""
    folder, data = fresh_path(spark, "parts"), B.frame(spark, sf_dir).select("row_id")
    size = lambda numbers, call: data.agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array(*[F.lit(k) for k in numbers])).alias("replicate"), "n", F.lit(call).alias("built_in"))
    reuse_parts(spark, folder, data, {}, range(3), lambda numbers: size(numbers, 1))
    return reuse_parts(spark, folder, data, {}, range(5), lambda numbers: size(numbers, 2))


@query("u4_consistency_check", "SELECT count(*) AS rows, true AS same, false AS same_after_change FROM orders")
def consistency_check(spark, sf_dir):
    from panelkit.plans.reuse import check_unchanged, fingerprint_text

    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    stored = fingerprint_text(orders)
    shuffled = orders.orderBy(F.desc("o_totalprice"))
    changed = orders.withColumn("o_custkey", F.col("o_custkey") + F.lit(1))
    return orders.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(check_unchanged(shuffled, stored, False)).alias("same"),
        F.lit(check_unchanged(changed, stored, False)).alias("same_after_change"))


def _bundle(spark, sf_dir) -> str:
    path = fresh_path(spark, "bundle")
    models = fitted_all(spark, sf_dir, ("decision_tree", "lightgbm"))
    bundles.save_bundle(spark, path, models, split_rows(spark, sf_dir), "target", source=sf_dir.rsplit("/", 1)[-1])
    return path


@query("s10_save_bundle", with_sql("split_frame", """SELECT '1' AS version, count(CASE WHEN split = 'train' THEN 1 END) AS n_train,
    count(CASE WHEN split = 'test' THEN 1 END) AS n_test, CAST(7 AS INTEGER) AS n_features, 'target' AS label, 'decision_tree,lightgbm' AS models FROM split_frame"""))
def save_bundle(spark, sf_dir):
    return bundles.bundle_summary(spark, _bundle(spark, sf_dir)).drop("source")


@query("s11_load_bundle", with_sql("split_frame", """SELECT model, split, count(*) AS n, 0::BIGINT AS changed FROM split_frame
    CROSS JOIN (SELECT unnest(['decision_tree', 'lightgbm']) AS model) GROUP BY 1, 2"""))
def load_bundle(spark, sf_dir):
    models, rows, _ = bundles.load_bundle(spark, _bundle(spark, sf_dir))
    before = fitted_all(spark, sf_dir, list(models))
    old = T.predict_long(before, rows, "row_id", "target").withColumnRenamed("prediction", "before").select("row_id", "model", "before")
    new = T.predict_long(models, rows, "row_id", "target")
    return new.join(old, ["row_id", "model"]).groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("prediction") - F.col("before")) > 1e-9).alias("changed"))


# ------------------------------------------------------------------ parts of the boosting job that SQL can state

BINS = 16
_extremes = ", ".join(f"min({f}) AS {f}_lo, max({f}) AS {f}_hi" for f in B.FEATURES)
_mean_sql = "(SELECT avg(target) AS m FROM frame)"
HISTOGRAM_SQL = " UNION ALL ".join(f"""SELECT '{f}' AS feature, bin, sum(m - target) AS gradient, count(*) AS weight FROM (
    SELECT target, m, CAST({' + '.join(f'CASE WHEN {f} > {f}_lo + ({f}_hi - {f}_lo) * {k} / {BINS}.0::DOUBLE THEN 1 ELSE 0 END' for k in range(1, BINS))} AS INTEGER) AS bin
    FROM frame, e, {_mean_sql}) GROUP BY 2""" for f in B.FEATURES)


def even_edges(spark, sf_dir) -> list[list[float]]:
    row = B.frame(spark, sf_dir).agg(*[g(f).alias(f"{f}_{n}") for f in B.FEATURES for n, g in (("lo", F.min), ("hi", F.max))]).first()
    ends = [(row[f"{f}_lo"], row[f"{f}_hi"]) for f in B.FEATURES]
    return [[lo + (hi - lo) * k / float(BINS) for k in range(1, BINS)] for lo, hi in ends]


@query("h1_level_histogram", with_sql("frame", "SELECT feature, bin, round(gradient, 1) AS gradient, weight FROM h", e=f"SELECT {_extremes} FROM frame", h=HISTOGRAM_SQL))
def level_histogram(spark, sf_dir):
    found = H.level_histogram(B.frame(spark, sf_dir), "row_id", B.FEATURES, "target", even_edges(spark, sf_dir))
    return found.select("feature", "bin", r("gradient", 1).alias("gradient"), "weight")


@query("h1b_first_split", with_sql("frame", """SELECT feature, bin, round(gain, 0) AS gain FROM (
    SELECT feature, bin, 0.5 * (gl * gl / hl + (g - gl) * (g - gl) / (h - hl) - g * g / h) AS gain FROM (
      SELECT feature, bin, sum(gradient) OVER (PARTITION BY feature ORDER BY bin) AS gl, sum(weight) OVER (PARTITION BY feature ORDER BY bin) AS hl,
             sum(gradient) OVER (PARTITION BY feature) AS g, sum(weight) OVER (PARTITION BY feature) AS h FROM h) WHERE hl < h)
    ORDER BY gain DESC LIMIT 1""", e=f"SELECT {_extremes} FROM frame", h=HISTOGRAM_SQL))
def first_split(spark, sf_dir):
    stump = H.BoostParams(n_estimators=1, max_depth=1, reg_lambda=0.0, learning_rate=1.0)
    model = H.fit_boosted(B.frame(spark, sf_dir), "row_id", B.FEATURES, "target", stump, edges=even_edges(spark, sf_dir))
    tree = model.trees[0][0]
    rows = [(B.FEATURES[tree.feature[0]], tree.bin[0], tree.gain[0])]
    return rounded(spark.createDataFrame(rows, "feature string, bin int, gain double"), 0)
