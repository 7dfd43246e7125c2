"""The whole analysis as one parameterised function that returns named relations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.models import trees as T
from panelkit.operators import importance as I
from panelkit.functions.scalar import quoted
from panelkit.operators import impute, inference, metrics, quality, segments, splits
from panelkit.operators.features import derive
from panelkit.operators.panel import repeated_keys, widen, with_year_feature
from panelkit.operators.permutation import permutation_importance
from panelkit.plans import reports as R
from panelkit.plans.reuse import reuse_parts
from panelkit.session import materialise
from panelkit.sources import fixed_values as fixed
from panelkit.sources.pages import collect_indicators
from panelkit.sources.tables import nan_to_null, safe_columns, safe_name


@dataclass
class RunOptions:
    """Settings of a full run; the switches turn whole steps off."""

    strategy: str = "knn"
    threshold: float = 0.6
    n_neighbors: int = 5
    outliers: str | None = None
    specs: Sequence[dict[str, Any]] = tuple(fixed.FEATURE_SPECS)
    models: Sequence[str] = T.KEYS
    params: dict[str, dict[str, Any]] = field(default_factory=dict)
    grids: dict[str, dict[str, Sequence[Any]]] = field(default_factory=dict)
    bands: Sequence[tuple] = tuple(fixed.TARGET_BANDS)
    segment_column: str | None = None
    income_column: str | None = "NY.GDP.PCAP"  # quartile segments of the first feature whose name holds this text
    segment_models: Sequence[str] = tuple(T.SEGMENT_DEFAULTS)
    segment_params: dict[str, dict[str, Any]] = field(default_factory=dict)
    tested_model: str = "xgboost"
    bootstrap_replicates: int = 100
    reuse_folder: str | None = None  # bootstrap replicates are kept here and only missing ones fitted
    permutations: int = 50
    top_k: int = 20
    folds: int = 5
    cross_validate: bool = True
    statistics: bool = True


def ingest(spark: SparkSession, path: str, names: Sequence[str] | None = None, start_year: int = 2000, end_year: int = 2023) -> DataFrame:
    """Landed indicator pages to a panel: ``row_id`` (code and year), code, name, year, a column per indicator, ``year_feature``.

    ``names`` are the wanted indicators in order, else those found, sorted. An indicator with two records for a code and year is refused.
    """
    long = materialise(collect_indicators(spark, path, start_year, end_year), "indicators")
    keys = ["entity_code", "year"]
    doubled = repeated_keys(long, keys, "indicator").limit(1).collect()
    if doubled:
        raise ValueError(f"more than one value of {doubled[0]['indicator']} for {doubled[0]['entity_code']} {doubled[0]['year']}")
    if names is None:
        names = sorted(r["indicator"] for r in long.select("indicator").distinct().collect())
    labels = long.groupBy("entity_code").agg(F.min("entity_name").alias("entity_name"))
    wide = widen(long, keys, "indicator", "value", names).join(labels, "entity_code")
    row_id = F.concat_ws("-", "entity_code", F.col("year").cast("string")).alias("row_id")
    return with_year_feature(wide.select(row_id, "entity_code", "entity_name", "year", *[quoted(n) for n in names]))


def _safe_spec(spec: dict[str, Any]) -> dict[str, Any]:
    """A spec on safe column names; its own name, operation and numbers stay."""
    change = lambda v: safe_name(v) if isinstance(v, str) else [safe_name(x) for x in v] if isinstance(v, list) else v
    return {**spec, "dependencies": change(spec.get("dependencies", [])),
            "parameters": {k: change(v) for k, v in spec.get("parameters", {}).items()}}


def _with_codes(df: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Names of columns, and of features in a result, as the caller knows them."""
    changed = {a: b for a, b in codes.items() if a != b}
    if not changed:
        return df
    df = df.toDF(*[changed.get(c, c) for c in df.columns])
    names = F.create_map(*[F.lit(x) for pair in changed.items() for x in pair])
    return df.withColumns({c: F.coalesce(names[F.col(c)], F.col(c)) for c in ("feature", "variable") if c in df.columns})


def prepare(panel: DataFrame, row_id: str, target: str, ids: Sequence[str], options: RunOptions) -> tuple[DataFrame, list[str]]:
    """Known targets, sparse columns dropped, values imputed, features derived, outliers removed; and the feature list."""
    df = quality.known_target(nan_to_null(panel), target)
    features = [c for c in quality.numeric_columns(df, [*ids, row_id, target])]
    df, kept = impute.handle_missing(df, features, options.strategy, options.threshold, row_id, options.n_neighbors)
    df, skipped = derive(df, options.specs)
    made = [s["name"] for s in options.specs if s["name"] not in skipped]
    if options.outliers:
        df = quality.remove_outliers(df, [*kept, *made, target], options.outliers)
    # a ratio by zero is missing after derivation; the models need a value
    df = impute.mean_impute(df, made) if made else df
    return df, [*kept, *made]


def run(panel: DataFrame, row_id: str, target: str, ids: Sequence[str], options: RunOptions | None = None) -> dict[str, DataFrame]:
    """Every relation of the analysis by name; result relations are small, row relations stay distributed.

    Column names may hold dots: the steps work on safe names, and all relations come back with the caller's names.
    """
    options = options or RunOptions()
    codes = {safe_name(c): c for c in panel.columns}
    if len(codes) < len(panel.columns):
        raise ValueError("two column names differ only in dots and underscores")
    plain = replace(options, specs=[_safe_spec(s) for s in options.specs],
                    segment_column=options.segment_column and safe_name(options.segment_column),
                    income_column=options.income_column and safe_name(options.income_column))
    found = _run(safe_columns(panel), safe_name(row_id), safe_name(target), [safe_name(i) for i in ids], plain)
    return {name: _with_codes(df, codes) for name, df in found.items()}


def _segments(rows: DataFrame, column: str, name: str, features: Sequence[str], target: str, row_id: str, options: RunOptions) -> dict[str, DataFrame]:
    scored, found = T.train_segments(rows, column, features, target, row_id, options.segment_models, options.segment_params)
    sizes = segments.segment_summary(rows.select(F.col(column).alias("segment"), target), "segment", target)
    results = metrics.regression_metrics(scored, ["segment", "model"]).drop("n").join(sizes, "segment")
    lead = options.tested_model if options.tested_model in options.segment_models else options.segment_models[0]
    report = R.segmentation_report(results, found.where(F.col("model") == lead))
    return {f"{name}s": results, f"{name}_importances": found, f"{name}_report": report}


def _run(panel: DataFrame, row_id: str, target: str, ids: Sequence[str], options: RunOptions) -> dict[str, DataFrame]:
    spark = panel.sparkSession
    prepared, features = prepare(panel, row_id, target, ids, options)
    rows = materialise(splits.with_split(prepared, row_id), "prepared")
    train_rows, test_rows = (rows.where(F.col("split") == s) for s in ("train", "test"))
    out: dict[str, DataFrame] = {"prepared": rows, "descriptive": quality.describe(rows, [target, *features])}

    models: dict[str, T.TreeModel] = {}
    for key in options.models:
        if key in options.grids:
            models[key], out[f"grid_{key}"] = T.grid_search(key, train_rows, features, target, row_id, options.grids[key], options.folds)
        else:
            models[key] = T.train(key, train_rows, features, target, row_id, options.params.get(key))
    out["predictions"] = materialise(T.predict_long(models, rows, row_id, target), "predictions")
    out["importances"] = T.importances_long(models, spark)
    extended = metrics.extended_metrics(out["predictions"])
    out["metrics"] = extended
    if options.cross_validate:
        parts = [T.cross_validate(k, train_rows, features, target, row_id, m.params, options.folds) for k, m in models.items()]
        folds = parts[0]
        for part in parts[1:]:
            folds = folds.unionByName(part)
        folds = materialise(folds, "folds")
        out["cross_validation"] = metrics.cross_validation_summary(folds)
        out["comparison"] = R.comparison_table(out["predictions"], folds)
        out["comprehensive"] = R.comprehensive_table(out["predictions"], folds)
        out["comparison_report"] = R.comparison_report(extended, out["comparison"], "tree")

    test = out["predictions"].where(F.col("split") == "test")
    if len(models) > 1:
        out["pairwise_tests"] = inference.model_comparison_tests(test, sorted(models))
    out["bands"] = metrics.band_metrics(test, options.bands)

    if options.segment_column:
        out.update(_segments(rows, options.segment_column, "segment", features, target, row_id, options))
    income = next((f for f in features if options.income_column and options.income_column in f), None)
    if income is not None:
        by_income = segments.quartile_segment(rows, income, fixed.INCOME_LABELS, "income_segment")
        out.update(_segments(materialise(by_income, "income"), "income_segment", "income_segment", features, target, row_id, options))

    if options.statistics:
        key = options.tested_model
        wanted = range(options.bootstrap_replicates)
        fit = lambda numbers: T.bootstrap_importances(
            key, train_rows, features, target, row_id, params=models[key].params, numbers=numbers)
        if options.reuse_folder:
            settings = {"model": key, "params": models[key].params, "features": list(features)}
            samples = reuse_parts(spark, options.reuse_folder, train_rows.select(row_id, target, *[quoted(f) for f in features]), settings, wanted, fit)
        else:
            samples = materialise(fit(list(wanted)), "bootstrap")
        out["bootstrap"] = I.replicate_summary(samples, ["feature"])
        base = models[key].importances(spark)
        out["permutation"] = materialise(permutation_importance(
            test_rows, row_id, target, features, base, T.predictor(models[key]), options.permutations, options.top_k), "permutation")
        matrix = inference.spearman_tests(out["importances"])
        out["consistency"] = matrix
        by_interval = I.top_features(out["bootstrap"].select("feature", F.col("mean_importance").alias("importance")), [], 10)
        by_drop = I.top_features(out["permutation"].select("feature", F.col("mean_score_drop").alias("importance")), [], 10)
        out["consensus"] = I.consensus(by_interval.select("feature", "rank"), by_drop.select("feature", "rank"))
        out["statistical_report"] = R.statistical_report(out["bootstrap"], out["permutation"], matrix, out["consensus"])
    return out
