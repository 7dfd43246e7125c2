from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.models import boosting as H
from panelkit.models import trees as T
from panelkit.operators import metrics as M
from panelkit.operators.splits import bootstrap_weights, with_split
from panelkit.plans.reuse import reuse_parts
from panelkit.session import fresh_path
from panelkit.sources import bundles

FEATURES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 3))
    y = np.where(x[:, 0] > 0, 5.0, -5.0) + 2 * x[:, 1] + rng.normal(size=1500) * 0.1
    rows = [(i, *map(float, x[i]), float(y[i]), ["n", "s", "w"][i % 3]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, noise double, y double, seg string").repartition(3)
    return with_split(df, "id").persist()


def rmse(df):
    return df.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0]


@pytest.mark.parametrize("key", ["decision_tree", "random_forest", "gradient_boosting", "xgboost", "lightgbm"])
def test_every_model_learns_and_ranks_features(spark, data, key):
    params = {"decision_tree": {"max_depth": 8}, "random_forest": {"n_estimators": 10, "max_depth": 8},
              "gradient_boosting": {"n_estimators": 8, "learning_rate": 0.3, "max_depth": 4}}.get(
        key, {"n_estimators": 12, "learning_rate": 0.3, "max_depth": 4})
    model = T.train(key, data.where("split = 'train'"), FEATURES, "y", "id", params)
    spread = data.agg(F.stddev_pop("y")).first()[0]
    assert rmse(model.transform(data.where("split = 'test'"))) < 0.4 * spread
    found = {r.feature: r.importance for r in model.importances(spark).collect()}
    assert sum(found.values()) == pytest.approx(1.0)
    assert min(found, key=found.get) == "noise"


def test_boosting_does_not_depend_on_partitioning(data):
    params = [H.BoostParams(n_estimators=4, max_depth=3, subsample=0.8, colsample_bytree=0.7)] * 2
    edges = H.quantile_edges(data, FEATURES, 16)
    weights = bootstrap_weights("id", 2)
    one = H.fit_boosted(data.repartition(1), "id", FEATURES, "y", params, weights, edges)
    many = H.fit_boosted(data.repartition(9), "id", FEATURES, "y", params, weights, edges, block_rows=500)
    assert one.node_rows() == many.node_rows()


@pytest.mark.parametrize("params", [
    {"max_depth": 4, "subsample": 0.8, "colsample_bytree": 0.7}, {"max_depth": 5, "num_leaves": 6}, {"max_depth": -1, "num_leaves": 9, "reg_alpha": 0.5}])
def test_whole_models_and_shared_levels_grow_the_same_trees(data, monkeypatch, params):
    """One task a model, and jobs a level for all models with siblings from what is left of the parent."""
    holes = data.withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a")))
    settings = [H.BoostParams(n_estimators=3, **params), H.BoostParams(n_estimators=2, learning_rate=0.3, **params)]
    edges = H.quantile_edges(data, FEATURES, 32)
    run = lambda: H.fit_boosted(holes.repartition(6), "id", FEATURES, "y", settings, bootstrap_weights("id", 2), edges, block_rows=300)
    alone = run()
    monkeypatch.setattr(H, "ALONE_BYTES", 0)
    assert alone.node_rows() == run().node_rows()


def test_missing_values_go_where_they_fit(spark):
    """Missing values with high labels go to the high side, those with low labels to the low side."""
    for height in (0.0, 10.0):
        rows = [(k, float(k % 10), 10.0 if k % 10 > 4 else 0.0) for k in range(300)] + [(300 + k, None, height) for k in range(100)]
        df = spark.createDataFrame(rows, "id long, x double, y double")
        model = H.fit_boosted(df, "id", ["x"], "y", H.BoostParams(n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0))
        assert model.trees[0][0].low[0] == (height == 0.0)
        assert rmse(model.transform(df)) == pytest.approx(0.0, abs=1e-6)


def test_weights_of_any_size_count_and_others_raise(spark):
    df = spark.createDataFrame([(k, float(k % 2), float(k % 2)) for k in range(200)], "id long, x double, y double")
    heavy = H.fit_boosted(df, "id", ["x"], "y", H.BoostParams(n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0),
                          F.array(F.when(F.col("x") > 0, 256).otherwise(1)))
    assert rmse(heavy.transform(df)) == pytest.approx(0.0, abs=1e-6) and heavy.base[0] == pytest.approx(256 / 257)
    for wrong in (-1, 70_000):
        with pytest.raises(ValueError):
            H.fit_boosted(df, "id", ["x"], "y", weights=F.array(F.lit(wrong)))


def test_trees_equal_a_plain_grower(data):
    """Depth-wise trees against a grower that looks at every cut of every node in Python."""
    pdf = data.toPandas()
    edges = [[-1.0, 0.0, 1.0], [-0.5, 0.5], [0.0]]
    model = H.fit_boosted(data, "id", FEATURES, "y", H.BoostParams(n_estimators=2, max_depth=3, learning_rate=0.5, min_child_samples=5), edges=edges)
    margin = np.full(len(pdf), pdf["y"].mean())

    def grow(rows, depth):
        g, best = (margin - pdf["y"].to_numpy())[rows], None
        for f, cuts in zip(FEATURES, edges):
            for e in cuts:
                low = pdf[f].to_numpy()[rows] <= e
                n, m = low.sum(), (~low).sum()
                if min(n, m) >= 5:
                    gain = 0.5 * (g[low].sum() ** 2 / (n + 1) + g[~low].sum() ** 2 / (m + 1) - g.sum() ** 2 / (n + m + 1))
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, low)
        if depth == 3 or best is None or best[0] <= 1e-9:
            step[rows] = -0.5 * g.sum() / (len(rows) + 1) if depth else 0.0
            return
        grow(rows[best[1]], depth + 1)
        grow(rows[~best[1]], depth + 1)

    for _ in range(2):
        step = np.zeros(len(pdf))
        grow(np.arange(len(pdf)), 0)
        margin = margin + step
    got = model.transform(data).select("id", "prediction").toPandas().set_index("id")["prediction"]
    assert np.allclose(got.loc[pdf["id"]].to_numpy(), margin, atol=1e-5)


def test_boosting_loss_falls_and_survives_checkpoints(data, monkeypatch):
    monkeypatch.setattr(H, "CHECKPOINT_EVERY", 2)
    monkeypatch.setattr(H, "ALONE_BYTES", 0)
    losses = []
    for rounds in (1, 3, 7):
        model = H.fit_boosted(data, "id", FEATURES, "y", H.BoostParams(n_estimators=rounds, max_depth=3, learning_rate=0.3))
        losses.append(rmse(model.transform(data)))
    assert losses[0] > losses[1] > losses[2]


def test_leaf_budget_depth_and_minimum_gain(data):
    tree = H.fit_boosted(data, "id", FEATURES, "y", H.BoostParams(n_estimators=1, max_depth=-1, num_leaves=5)).trees[0][0]
    assert sum(f < 0 for f in tree.feature) == 5
    deep = H.fit_boosted(data, "id", FEATURES, "y", H.BoostParams(n_estimators=1, max_depth=2)).trees[0][0]
    assert max(deep.depth) == 2
    none = H.fit_boosted(data, "id", FEATURES, "y", H.BoostParams(n_estimators=1, gamma=1e9)).trees[0][0]
    assert none.feature == [-1]


def test_best_first_growth_takes_the_largest_gains(data):
    wide = H.fit_boosted(data, "id", FEATURES, "y", H.BoostParams(n_estimators=1, max_depth=4)).trees[0][0]
    few = H.fit_boosted(data, "id", FEATURES, "y", H.BoostParams(n_estimators=1, max_depth=4, num_leaves=4)).trees[0][0]
    # replay on the full tree: split the open node with the largest gain three times
    opened, gains = [0], []
    for _ in range(3):
        node = max(opened, key=lambda n: wide.gain[n])
        opened.remove(node)
        gains.append(wide.gain[node])
        opened += [wide.left[node], wide.right[node]]
    assert sorted(g for g in few.gain if g > 0) == pytest.approx(sorted(gains))


def test_batched_models_equal_models_trained_alone(data):
    settings = [H.BoostParams(n_estimators=3, max_depth=3), H.BoostParams(n_estimators=2, max_depth=2, learning_rate=0.5)]
    edges = H.quantile_edges(data, FEATURES, 16)
    in_a = F.when(F.col("id") % 2 == 0, 1).otherwise(0)
    both = H.fit_boosted(data, "id", FEATURES, "y", settings, F.array(in_a, F.lit(1)), edges)
    alone = H.fit_boosted(data.where("id % 2 = 0"), "id", FEATURES, "y", settings[0], None, edges)
    assert [n[2:7] for n in both.node_rows() if n[0] == 0] == [n[2:7] for n in alone.node_rows()]
    assert both.base[0] == alone.base[0]
    assert len(both.trees[1]) == 2


def test_stump_matches_a_direct_search(data):
    pdf = data.toPandas()
    edges = [[0.0], [-1.0, 0.0, 1.0], [0.0]]
    model = H.fit_boosted(data, "id", FEATURES, "y", H.BoostParams(n_estimators=1, max_depth=1, reg_lambda=0.0, learning_rate=1.0), edges=edges)
    best = max(
        ((pdf.loc[pdf[f] <= e, "y"].mean() - pdf["y"].mean()) ** 2 * (pdf[f] <= e).sum()
         + (pdf.loc[pdf[f] > e, "y"].mean() - pdf["y"].mean()) ** 2 * (pdf[f] > e).sum(), f, e)
        for f, cuts in zip(FEATURES, edges) for e in cuts)
    tree = model.trees[0][0]
    assert FEATURES[tree.feature[0]] == best[1] and tree.gain[0] == pytest.approx(best[0] / 2, rel=1e-6)


def test_cross_validation_covers_every_row_once(data):
    for key, params in (("decision_tree", {"max_depth": 3}), ("xgboost", {"n_estimators": 2})):
        scored = T.cross_validate(key, data, FEATURES, "y", "id", params, folds=3)
        assert scored.count() == 1500 and scored.select("row_id").distinct().count() == 1500
        assert M.cross_validation_summary(scored).count() == 1


def test_grid_search_prefers_the_better_point(data):
    for key, grid in (("decision_tree", {"max_depth": [1, 6]}), ("xgboost", {"max_depth": [1, 4], "n_estimators": [4], "learning_rate": [0.4]})):
        model, table = T.grid_search(key, data, FEATURES, "y", "id", grid, folds=3)
        scores = [r.cv_mse for r in table.orderBy("point").collect()]
        assert scores[1] < scores[0]
        assert model.params["max_depth"] == grid["max_depth"][1]


def test_grid_sizes():
    from panelkit.sources.fixed_values import GRIDS

    assert {k: len(T.grid_points(g)) for k, g in GRIDS.items()} == {
        "decision_tree": 24, "random_forest": 48, "gradient_boosting": 64, "xgboost": 192, "lightgbm": 768}


def test_segments_share_jobs_and_keep_their_rows(data):
    scored, found = T.train_segments(data, "seg", FEATURES, "y", "id", ("xgboost", "random_forest"),
                                     {"xgboost": {"n_estimators": 3}, "random_forest": {"n_estimators": 2, "max_depth": 3}})
    assert scored.where("prediction is null").count() == 0
    assert {r.segment for r in scored.select("segment").distinct().collect()} == {"n", "s", "w"}
    sums = found.groupBy("segment", "model").agg(F.sum("importance").alias("s")).collect()
    assert len(sums) == 6 and all(r.s == pytest.approx(1.0) for r in sums)


def test_bootstrap_replicates_differ_and_repeat(data):
    run = lambda key, p: sorted(map(tuple, T.bootstrap_importances(key, data, FEATURES, "y", "id", 3, p).collect()))
    first = run("xgboost", {"n_estimators": 2, "max_depth": 3})
    assert first == run("xgboost", {"n_estimators": 2, "max_depth": 3})
    assert len({v for _, _, f, v in first if f == "a"}) == 3
    assert len(run("decision_tree", {"max_depth": 3})) == 9


@pytest.mark.parametrize("key", ["xgboost", "random_forest"])
def test_stored_replicates_are_not_fitted_again(spark, data, key):
    folder, asked = fresh_path(spark, "parts"), []
    params = {"n_estimators": 2, "max_depth": 3, **({"subsample": 0.8} if key == "xgboost" else {})}

    def fit(numbers):
        asked.append(numbers)
        return T.bootstrap_importances(key, data, FEATURES, "y", "id", params=params, numbers=numbers)

    read = lambda wanted, settings=params: {(r.replicate, r.feature): r.importance for r in reuse_parts(spark, folder, data, settings, wanted, fit).collect()}
    read(range(3))
    five = read(range(5))
    assert asked == [[0, 1, 2], [3, 4]] and len(five) == 15
    again = read([1, 4])
    assert asked == [[0, 1, 2], [3, 4]] and again == {k: v for k, v in five.items() if k[0] in (1, 4)}
    whole = T.bootstrap_importances(key, data, FEATURES, "y", "id", 5, params)
    assert {(r.replicate, r.feature): pytest.approx(r.importance, abs=1e-6) for r in whole.collect()} == five
    read(range(2), {**params, "other": 1})
    assert asked[-1] == [0, 1]
    spark.createDataFrame([("x", 0, "a", 9.0)], "model string, replicate int, feature string, importance double").write.parquet(
        f"{next(iter(_paths(spark, folder)))}/batch=0/unfinished")
    assert read(range(5)) == five


def _paths(spark, folder):
    place = spark._jvm.org.apache.hadoop.fs.Path(folder + "/*/*")
    return [f.getPath().toString() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)]


def test_bundle_round_trip_and_changed_rows(spark, data):
    path = fresh_path(spark, "test-bundle")
    models = T.train_all(data.where("split = 'train'"), FEATURES, "y", "id", ["decision_tree", "lightgbm"],
                         {"decision_tree": {"max_depth": 3}, "lightgbm": {"n_estimators": 2}})
    bundles.save_bundle(spark, path, models, data, "y")
    loaded, rows, meta = bundles.load_bundle(spark, path)
    assert meta["n_features"] == 3 and rows.count() == 1500 and meta["n_train"] + meta["n_test"] == 1500
    for key, model in models.items():
        assert rmse(loaded[key].transform(data)) == pytest.approx(rmse(model.transform(data)))
    with pytest.raises(FileNotFoundError):
        bundles.load_bundle(spark, path + "-none")
    data.limit(10).write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        bundles.load_bundle(spark, path)


def test_template_keeps_class_and_settings(data):
    made = T.estimator("random_forest", {"n_estimators": 3, "max_depth": 4, "max_features": "sqrt"}, "y")
    model = T.Pipeline(stages=[T.assembler(FEATURES), made]).fit(data)
    made = T.from_template(model.stages[-1], {"numTrees": 5})
    assert type(made).__name__ == "RandomForestRegressor"
    assert (made.getNumTrees(), made.getMaxDepth(), made.getFeatureSubsetStrategy()) == (5, 4, "sqrt")


@pytest.mark.parametrize("key", T.KEYS)
def test_template_of_every_model(data, key):
    params = {"max_depth": 3} if key == "decision_tree" else {"n_estimators": 2, "max_depth": 3}
    model = T.train(key, data, FEATURES, "y", "id", params)
    made = T.from_template(model, {"max_depth": 2})
    assert made == T.Template(key, {**params, "max_depth": 2})
    again = made.fit(data, FEATURES, "y", "id")
    assert max(d for t in again.boosted.trees[0] for d in t.depth) == 2


def test_single_tree_equals_a_plain_grower(data):
    """A tree with smallest leaf and smallest split against every cut of every node in Python."""
    pdf = data.toPandas()
    edges = [[-1.0, 0.0, 1.0], [-0.5, 0.5], [0.0]]
    setting = T.boost_params("decision_tree", {"max_depth": 4, "min_samples_leaf": 7, "min_samples_split": 60})
    model = H.fit_boosted(data, "id", FEATURES, "y", setting, edges=edges)
    y, want = pdf["y"].to_numpy(), np.zeros(len(pdf))

    def grow(rows, depth):
        best = None
        if depth < 4 and len(rows) >= 60:
            for f, cuts in zip(FEATURES, edges):
                for e in cuts:
                    low = pdf[f].to_numpy()[rows] <= e
                    if min(low.sum(), (~low).sum()) >= 7:
                        spread = sum(((y[part] - y[part].mean()) ** 2).sum() for part in (rows[low], rows[~low]))
                        if best is None or spread < best[0] - 1e-9:
                            best = (spread, low)
        if best is None or best[0] > ((y[rows] - y[rows].mean()) ** 2).sum() - 1e-9:
            want[rows] = y[rows].mean()
            return
        grow(rows[best[1]], depth + 1)
        grow(rows[~best[1]], depth + 1)

    grow(np.arange(len(pdf)), 0)
    got = model.transform(data).select("id", "prediction").toPandas().set_index("id")["prediction"]
    assert np.allclose(got.loc[pdf["id"]].to_numpy(), want, atol=1e-5)


def test_forests_draw_rows_and_features_and_do_not_depend_on_partitioning(data):
    setting = T.boost_params("random_forest", {"n_estimators": 12, "max_depth": 20, "max_features": "sqrt", "min_samples_leaf": 2, "min_samples_split": 5})
    edges = H.quantile_edges(data, FEATURES, 64)
    one = H.fit_boosted(data.repartition(1), "id", FEATURES, "y", setting, edges=edges)
    other = H.fit_boosted(data.repartition(7), "id", FEATURES, "y", setting, edges=edges)
    assert one.node_rows() == other.node_rows()
    assert len(one.trees[0]) == 12 and len({tuple(t.feature[:7]) for t in one.trees[0]}) > 6
    assert {t.feature[0] for t in one.trees[0]} == {0, 1, 2}  # one feature a node: even the noise stands at a root
    few = H.fit_boosted(data, "id", FEATURES, "y", replace(setting, n_estimators=1), edges=edges)
    assert rmse(one.transform(data)) < rmse(few.transform(data))


def test_missing_values_in_a_single_tree(spark):
    for height in (0.0, 10.0):
        rows = [(k, float(k % 10), 10.0 if k % 10 > 4 else 0.0) for k in range(300)] + [(300 + k, None, height) for k in range(100)]
        df = spark.createDataFrame(rows, "id long, x double, y double")
        model = H.fit_boosted(df, "id", ["x"], "y", T.boost_params("decision_tree", {"max_depth": 1}))
        assert rmse(model.transform(df)) == pytest.approx(0.0, abs=1e-6)


def test_parameter_mapping():
    assert T.mllib_params("random_forest", {"max_depth": None, "n_estimators": 7, "min_samples_split": 5}) == {"maxDepth": 30, "numTrees": 7}
    assert T.mllib_params("gradient_boosting", {"n_estimators": 7, "learning_rate": 0.1, "subsample": 0.9}) == {
        "maxIter": 7, "stepSize": 0.1, "subsamplingRate": 0.9}
    assert T.boost_params("lightgbm", {"max_depth": -1}).depth_limit == 30
    assert T.boost_params("xgboost", {}).reg_lambda == 1.0


def test_large_forests_stay_in_the_shared_folder(spark, data, monkeypatch):
    """Trees beyond the bound neither reach the driver for scoring nor for importances, and give what small ones do."""
    params = {"n_estimators": 12, "max_depth": 8, "max_features": "sqrt"}
    holes = data.withColumn("a", F.when(F.col("id") % 7 > 0, F.col("a")))
    small = T.train("random_forest", holes, FEATURES, "y", "id", params)
    folds = T.cross_validate("random_forest", holes, FEATURES, "y", "id", params, 3)
    grid = T.grid_search("decision_tree", holes, FEATURES, "y", "id", {"max_depth": [2, 5]}, 3)[1]
    monkeypatch.setattr(H, "DRIVER_NODES", 0)
    monkeypatch.setattr(H, "SCORE_ROWS", 400)
    monkeypatch.setattr(H, "BLOCK_ROWS", 300)
    large = T.train("random_forest", holes, FEATURES, "y", "id", params)
    assert small.boosted.stored is None and large.boosted.stored is not None
    for model in (large, saved_model(spark, large)):
        both = model.transform(small.transform(holes, "one"), "two")
        assert both.count() == 1500 and both.where("two is null or abs(one - two) > 1e-9").count() == 0
        assert model.boosted.importance_rows() == small.boosted.importance_rows()
    assert [t["leaves"] for t in large.boosted.sums[0]] == [sum(f < 0 for f in t.feature) for t in small.boosted.trees[0]]
    again = T.cross_validate("random_forest", holes, FEATURES, "y", "id", params, 3).withColumnRenamed("prediction", "again")
    assert again.join(folds, ["row_id", "fold"]).where("abs(prediction - again) < 1e-9").count() == 1500
    scores = T.grid_search("decision_tree", holes, FEATURES, "y", "id", {"max_depth": [2, 5]}, 3)[1]
    assert [r.cv_mse for r in scores.orderBy("point").collect()] == pytest.approx([r.cv_mse for r in grid.orderBy("point").collect()])


def test_large_forests_are_written_in_one_form(spark, data, monkeypatch):
    monkeypatch.setattr(H, "DRIVER_NODES", 0)
    model = T.train("random_forest", data, FEATURES, "y", "id", {"n_estimators": 6, "max_depth": 4})
    stored = spark.read.parquet(*model.boosted.stored.inputFiles())
    assert stored.where("trees is not null").count() == 2 and stored.where("grown is not null").count() == 0


@pytest.mark.parametrize("setting", [{"max_depth": 6}, {"max_depth": 5, "num_leaves": 20}, {"max_depth": 2, "gamma": 1e9}, {"max_depth": 9}])
def test_leaves_are_looked_up_as_nodes_are_walked_to(setting, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (4_000, 3)).astype(np.uint8)
    y = np.where(x[:, 0] == 0, 3.0, x[:, 0] * x[:, 1]) + rng.normal(size=4_000)
    block = {"x": x, "y": y, "w": np.ones(4_000, np.uint16), "k": np.arange(4_000, dtype=np.uint64)}
    trees = [t.packed() for t in H._train_alone(block, H.BoostParams(n_estimators=3, **setting), 2.0**16, 0.0, 14)]
    other = np.concatenate([x, rng.integers(0, 256, (500, 3))]).astype(np.uint16)
    monkeypatch.setattr(H, "TABLE_ROWS", 1 << 40)
    walked = [H._descend(other, t).tolist() for t in trees]
    monkeypatch.setattr(H, "TABLE_ROWS", 0)
    large = [(t[0] < 0).sum() > 64 for t in trees]
    assert all(large) == (setting["max_depth"] == 9)
    if not any(large) and "gamma" not in setting:
        monkeypatch.setattr(H, "_goes_low", lambda *_: pytest.fail("rows were walked node by node"))
    assert [H._descend(other, t).tolist() for t in trees] == walked


def saved_model(spark, model):
    path = fresh_path(spark, "saved")
    model.boosted.save(spark, path)
    return T.TreeModel(model.key, model.features, model.params, boosted=H.BoostedModels.load(spark, path))


def test_many_models_do_not_leave_their_tasks(data, monkeypatch):
    """Rows, not rows times models, say whether models are trained by one task each; models of equal rows share a weight."""
    assert H.fits_one_block(700_000, 7, 100) and H.fits_one_block(700_000, 7)
    monkeypatch.setattr(H._Trainer, "best", lambda *_: pytest.fail("models grew level by level"))
    settings = [H.BoostParams(n_estimators=1, max_depth=k % 3 + 1) for k in range(30)]
    shared = F.array(F.when(F.col("id") % 2 == 0, 1).otherwise(0), F.lit(1))
    made = H.fit_boosted(data, "id", FEATURES, "y", settings, shared, columns=[k % 2 for k in range(30)])
    assert made.models == 30 and made.base[0] == made.base[2] != made.base[1]


def test_sums_of_many_rows_are_counted_in_exact_pieces(monkeypatch):
    x, slot = np.arange(50, dtype=np.uint8).reshape(-1, 1) % 4, np.arange(50) % 3
    count = lambda: H._count(x, slot, np.arange(50.0), np.ones(50), 3, 4, np.ones(1, bool)).tolist()
    whole = count()
    monkeypatch.setattr(H, "EXACT_BITS", 3)
    assert count() == whole


def spread_out(monkeypatch, node_rows=100):
    """Every model has more rows than a task takes."""
    monkeypatch.setattr(H, "ALONE_BYTES", 0)
    monkeypatch.setattr(H, "NODE_ROWS", node_rows)
    monkeypatch.setattr(H, "BLOCK_ROWS", 400)
    monkeypatch.setattr(H, "UNITS_AT_ONCE", 2)


@pytest.mark.parametrize("params", [
    {"n_estimators": 12, "max_depth": 8, "max_features": None, "min_samples_split": 5, "min_samples_leaf": 2},
    {"n_estimators": 6, "max_depth": None, "max_features": None}, {"n_estimators": 6, "max_depth": 2, "max_features": None}])
def test_forests_beyond_a_task_are_those_of_one_task(spark, data, monkeypatch, params):
    """Tops grown in shared jobs and what tasks grow below them are the trees of whole tasks, where every node asks all features."""
    holes = data.withColumn("a", F.when(F.col("id") % 7 > 0, F.col("a")))
    whole = T.train("random_forest", holes, FEATURES, "y", "id", params)
    spread_out(monkeypatch)
    spread = T.train("random_forest", holes, FEATURES, "y", "id", params)
    assert spread.boosted.stored is not None and spread.boosted.stored.count() == -(-params["n_estimators"] // 5)
    for model in (spread, saved_model(spark, spread)):
        both = model.transform(whole.transform(holes, "one"), "two")
        assert both.count() == 1500 and both.where("two is null or abs(one - two) > 1e-9").count() == 0
        assert [v for *_, v in model.boosted.importance_rows()] == pytest.approx([v for *_, v in whole.boosted.importance_rows()])
    for own in ("depth", "leaves"):
        assert [t[own] for t in spread.boosted.sums[0]] == [t[own] for t in whole.boosted.sums[0]]
    assert [sorted(t.value[t.feature < 0]) for t in spread.boosted.trees[0]] == [
        pytest.approx(sorted(t.value[t.feature < 0])) for t in whole.boosted.trees[0]]


def test_forests_beyond_a_task_do_not_depend_on_partitioning_or_company(data, monkeypatch):
    spread_out(monkeypatch)
    setting = T.boost_params("random_forest", {"n_estimators": 7, "max_depth": 20, "max_features": "sqrt", "min_samples_leaf": 2})
    edges = H.quantile_edges(data, FEATURES, 64)
    shape = lambda model, m=0: [[np.asarray(getattr(t, k)).tolist() for k in ("feature", "bin", "left", "value", "low")] for t in model.trees[m]]
    one = H.fit_boosted(data.repartition(1), "id", FEATURES, "y", setting, edges=edges)
    two = H.fit_boosted(data.repartition(7), "id", FEATURES, "y", [replace(setting, seed=1), setting], F.array(F.lit(1), F.lit(1)), edges)
    assert shape(one) == shape(two, 1) != shape(two)
    assert len({tuple(t.feature[:7]) for t in one.trees[0]}) > 4
    assert rmse(one.transform(data)) < 1.5


def test_folds_points_and_segments_beyond_a_task(data, monkeypatch):
    """The other callers of the engine, with a single tree, row weights beyond a byte, and a model without rows."""
    run = lambda: (
        T.cross_validate("decision_tree", data, FEATURES, "y", "id", {"max_depth": 6}, 3).orderBy("row_id").collect(),
        T.grid_search("decision_tree", data, FEATURES, "y", "id", {"max_depth": [2, None]}, 3)[1].orderBy("point").collect(),
        T.train_segments(data, "seg", FEATURES, "y", "id", ["random_forest"], {"random_forest": {"n_estimators": 3, "max_depth": 5, "max_features": None}})[0].orderBy("row_id").collect(),
        H.fit_boosted(data, "id", FEATURES, "y", [T.boost_params("random_forest", {"n_estimators": 2, "max_depth": 7, "max_features": None})] * 2,
                      F.array((F.col("id") % 3) * 30_000, F.lit(0))).transform(data, (F.col("id") % 2).cast("int")).orderBy("id").select("id", "prediction").collect())
    whole = run()
    spread_out(monkeypatch)
    for got, wanted in zip(run(), whole):
        assert len(got) == len(wanted)
        for a, b in zip(got, wanted):
            assert [pytest.approx(v) if isinstance(v, float) else v for v in b] == list(a)


def test_cuts_of_sorted_rows_and_of_tables_are_equal(monkeypatch):
    """Both ways to sum the cells of a level, with missing values, copies of rows and nodes of few rows."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, (3_000, 3)).astype(np.uint8)
    block = {"x": x, "y": x[:, 0] * 2.0 + (x[:, 1] == 0) * 9 + rng.normal(size=3_000), "w": rng.integers(0, 3, 3_000).astype(np.uint16),
             "k": np.arange(3_000, dtype=np.uint64)}
    setting = T.boost_params("random_forest", {"n_estimators": 3, "max_depth": 20, "max_features": "sqrt", "min_samples_leaf": 2})
    grow = lambda: [[np.asarray(getattr(t, k)).tolist() for k in t.FIELDS] for t in H._train_forest(block, setting, 2.0**16, 0.0, 42, range(3))]
    mixed = grow()
    for cells in (0, 1 << 40):
        monkeypatch.setattr(H, "DENSE_CELLS", cells)
        assert grow() == mixed


def test_one_boosted_model_of_many_rows_is_one_task():
    assert H.fits_one_block(7_100_000, 7, 1) and not H.fits_one_block(43_000_000, 7, 1)


def test_pieces_of_rows_give_the_trees_of_all_rows(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 30, (2_500, 3)).astype(np.uint8)
    for w in (np.ones(2_500), rng.integers(0, 4, 2_500)):
        block = {"x": x, "y": np.sin(x[:, 0]) + (x[:, 1] == 0) + rng.normal(size=2_500), "w": w.astype(np.uint16), "k": np.arange(2_500, dtype=np.uint64)}
        for share in (0.7, 1.0):
            setting = H.BoostParams(n_estimators=4, max_depth=4, subsample=share, colsample_bytree=share)
            grow = lambda: [[np.asarray(getattr(t, k)).tolist() for k in t.FIELDS] for t in H._train_alone(block, setting, 2.0**16, 0.0, 32)]
            whole = grow()
            monkeypatch.setattr(H, "PIECE_ROWS", 300)
            assert grow() == whole
            monkeypatch.undo()


def test_trees_scored_in_pairs_give_the_leaves_they_walk_to(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 50, (3_000, 4)).astype(np.uint16)
    block = {"x": x, "y": x[:, 0] * 1.0 * x[:, 1] + (x[:, 2] == 0) * 500, "w": np.ones(3_000, np.uint16), "k": np.arange(3_000, dtype=np.uint64)}
    trees = [t.packed() for kind in ({"max_depth": 5}, {"max_depth": 6}, {"max_depth": 2, "gamma": 1e12}, {"max_depth": 9})
             for t in H._train_alone(block, H.BoostParams(n_estimators=3, **kind), 2.0**16, 0.0, 51)]
    rows = np.concatenate([x, rng.integers(0, 300, (500, 4)).astype(np.uint16)])
    monkeypatch.setattr(H, "PIECE_ROWS", 1_000)
    got = H._Scorer(trees, 0.25)(rows)
    monkeypatch.setattr(H, "TABLE_ROWS", 1 << 40)
    want = np.full(len(rows), 0.25)
    for tree in trees:
        want += tree[4][H._descend(rows, tree)]
    assert got.tolist() == want.tolist()


def test_rows_walk_by_words_as_by_columns(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 60, (4_000, 3)).astype(np.uint8)
    tree = H._grow_whole(x, np.rint(x[:, 0] * x[:, 1] + rng.normal(size=4_000) * 900), np.ones(4_000), H.BoostParams(max_depth=12), 1, 62, 1.0, 1.0).packed()
    assert H._node_codes(tree) is not None and (tree[0] < 0).sum() > 64
    by_words = [H._descend(order(x), tree).tolist() for order in (np.ascontiguousarray, np.asfortranarray)]
    monkeypatch.setattr(H, "_node_codes", lambda _: None)
    assert by_words == [H._descend(order(x), tree).tolist() for order in (np.ascontiguousarray, np.asfortranarray)]


def test_counts_of_draws_are_those_of_the_steps():
    steps = np.cumsum([np.exp(-1) / H.math.factorial(k) for k in range(13)])
    draws = np.concatenate([np.random.default_rng(9).random(20_000), steps[:12], np.nextafter(steps[:12], 0), [0.0, 1 - 2.0**-53], np.arange(4096) / 4096])
    assert H._POISSON_OPEN.sum() <= 13 and H._poisson(draws).tolist() == np.searchsorted(H._POISSON_STEPS, draws, side="right").tolist()


def test_models_fitted_side_by_side_are_those_fitted_alone(spark, data):
    keys = ["decision_tree", "xgboost", "lightgbm"]
    found = T.train_together(keys, data.where("split = 'train'"), FEATURES, "y", "id")
    assert list(found) == keys
    for key in ("decision_tree", "lightgbm"):
        alone = T.train(key, data.where("split = 'train'"), FEATURES, "y", "id")
        assert found[key].boosted.node_rows() == alone.boosted.node_rows() and found[key].params == alone.params
