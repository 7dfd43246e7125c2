"""Model bundles: fitted models, the split they were made on, and one metadata row."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.models.boosting import BoostedModels
from panelkit.models.trees import TreeModel
from panelkit.plans.reuse import check_unchanged, fingerprint_text
from panelkit.sources.tables import _exists

VERSION = "1"


def save_bundle(spark: SparkSession, path: str, models: dict[str, TreeModel], split_rows: DataFrame, label: str,
                split: str = "split", source: str = "") -> None:
    """Write every model, the split rows and the metadata below ``path``."""
    split_rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    for key, model in models.items():
        if model.boosted is not None:
            model.boosted.save(spark, f"{path}/models/{key}")
        else:
            model.pipeline.write().overwrite().save(f"{path}/models/{key}")
    first = next(iter(models.values()))
    counts = {r[split]: r["count"] for r in rows.groupBy(split).count().collect()}
    meta = [(
        VERSION, datetime.now(timezone.utc).isoformat(), fingerprint_text(rows), counts.get("train", 0), counts.get("test", 0),
        len(first.features), first.features, label, source, list(models), [json.dumps(m.params) for m in models.values()],
    )]
    spark.createDataFrame(
        meta, "version string, created string, fingerprint string, n_train long, n_test long, n_features int, "
              "features array<string>, label string, source string, model_keys array<string>, model_params array<string>",
    ).write.mode("overwrite").parquet(f"{path}/metadata")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/metadata"):
        raise FileNotFoundError(f"no model bundle at {path}")
    return spark.read.parquet(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict[str, TreeModel], DataFrame, dict]:
    """Models, split rows and metadata; raises when there is no bundle or the rows changed."""
    meta = load_metadata(spark, path).first().asDict()
    rows = spark.read.parquet(f"{path}/rows")
    if verify:
        check_unchanged(rows, meta["fingerprint"])
    models = {}
    for key, params in zip(meta["model_keys"], meta["model_params"]):
        place = f"{path}/models/{key}"
        kept = json.loads(params)
        if _exists(spark, f"{place}/nodes"):
            models[key] = TreeModel(key, meta["features"], kept, boosted=BoostedModels.load(spark, place))
        else:
            models[key] = TreeModel(key, meta["features"], kept, pipeline=PipelineModel.load(place))
    return models, rows, meta


def bundle_summary(spark: SparkSession, path: str) -> DataFrame:
    return load_metadata(spark, path).select(
        "version", "n_train", "n_test", "n_features", "label", "source", F.array_join("model_keys", ",").alias("models"))
