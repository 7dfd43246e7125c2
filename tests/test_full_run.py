from panelkit.plans import frames as B
from panelkit.plans.full_run import RunOptions, run
from panelkit.plans.panel_queries import FEATURE_SPECS


def test_full_run_returns_every_relation(spark, sf_dir):
    quick = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3}
    options = RunOptions(
        strategy="median", outliers="iqr", specs=FEATURE_SPECS[:2], models=("decision_tree", "xgboost"),
        params={"decision_tree": {"max_depth": 4}, "xgboost": quick}, bands=B.BANDS, segment_column="region",
        segment_models=("xgboost",), segment_params={"xgboost": quick}, bootstrap_replicates=4, permutations=3, top_k=4, folds=3,
    )
    panel = B.frame_nulls(spark, sf_dir).drop("ext_a", "ext_n", "ext_r").withColumn("region", B.F.col("region_key").cast("string"))
    found = run(panel, "row_id", "target", ["entity", "region_key", "year", "month", "region"], options)
    assert "tax_avg" not in found["prepared"].columns
    assert {"prepared", "predictions", "comparison", "comprehensive", "pairwise_tests", "bands", "segments", "segment_report",
            "bootstrap", "permutation", "consistency", "consensus", "statistical_report", "comparison_report"} <= set(found)
    for name, relation in found.items():
        assert relation.count() > 0, name
    assert found["consensus"].first()["feature"] in ("price_avg", "disc_avg")


def test_second_run_takes_stored_replicates(spark, sf_dir, monkeypatch):
    from dataclasses import replace

    from panelkit.models import trees as T
    from panelkit.session import fresh_path

    quick, asked, fit = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3}, [], T.bootstrap_importances
    monkeypatch.setattr(T, "bootstrap_importances", lambda *a, **k: asked.append(k["numbers"]) or fit(*a, **k))
    options = RunOptions(strategy="median", specs=(), models=("xgboost",), params={"xgboost": quick}, bands=B.BANDS, income_column=None,
                         cross_validate=False, bootstrap_replicates=2, permutations=2, top_k=2, reuse_folder=fresh_path(spark, "kept"))
    panel = B.frame_nulls(spark, sf_dir).drop("ext_a", "ext_n", "ext_r")
    first, *_, last = (run(panel, "row_id", "target", ["entity", "region_key", "year", "month"], o)["bootstrap"].collect()
                       for o in (options, options, replace(options, bootstrap_replicates=3)))
    assert asked == [[0, 1], [2]] and len(first) == len(last) > 0


def test_indicator_codes_run_end_to_end(spark, tmp_path):
    """Landed pages of all indicators, dotted codes and text row ids: 59 features, shipped specs and display names."""
    import json
    import random

    from panelkit.operators.lookup import display_name
    from panelkit.plans.full_run import ingest, prepare
    from panelkit.sources import fixed_values as fixed

    rng = random.Random(4)
    for code in fixed.INDICATORS:
        records = [
            {"countryiso3code": f"C{c:02d}", "country": {"id": f"{c}", "value": f"Country {c}"}, "date": str(year),
             "value": None if rng.random() < 0.02 and code != fixed.INDICATORS[0] else rng.uniform(1, 90)}
            for c in range(24) for year in range(2018, 2023)
        ]
        (tmp_path / f"{code}_1.json").write_text(json.dumps([{"total": len(records)}, records]))
    panel = ingest(spark, str(tmp_path), fixed.INDICATORS)
    assert panel.count() == 120 and panel.columns[:4] == ["row_id", "entity_code", "entity_name", "year"]
    target, ids = fixed.INDICATORS[0], ["row_id", "entity_code", "entity_name", "year"]
    quick = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3}
    options = RunOptions(strategy="median", models=("decision_tree", "xgboost"), params={"decision_tree": {"max_depth": 3}, "xgboost": quick},
                         segment_models=("xgboost",), segment_params={"xgboost": quick}, bootstrap_replicates=2, permutations=2, top_k=3, folds=2)
    found = run(panel, "row_id", target, ids, options)
    features = [r["feature"] for r in found["importances"].select("feature").distinct().collect()]
    assert len(features) == 59 and set(fixed.INDICATORS[1:]) | {"year_feature"} < set(features)
    assert {s["name"] for s in fixed.FEATURE_SPECS} < set(features)
    names = spark.createDataFrame(list(fixed.DISPLAY_NAMES.items()), "code string, display string")
    shown = {r["feature"]: r["display"] for r in display_name(found["importances"], "feature", names).collect()}
    assert all(shown[f] == fixed.DISPLAY_NAMES[f] for f in features if f in fixed.DISPLAY_NAMES)
    assert {r["segment"] for r in found["income_segments"].collect()} <= set(fixed.INCOME_LABELS) and target in found["prepared"].columns
    nearest, kept = prepare(panel.toDF(*[c.replace(".", "_") for c in panel.columns]), "row_id", target.replace(".", "_"), ids, RunOptions(specs=()))
    assert len(kept) == 53 and nearest.where(" OR ".join(f"`{c}` IS NULL" for c in kept)).count() == 0
