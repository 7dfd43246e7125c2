"""Dictionary relations: JSON mappings and the built-in names, categories and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.sources import fixed_values as fixed
from panelkit.sources.tables import _exists


def read_mapping(spark: SparkSession, path: str, key: str = "code", value: str = "label") -> DataFrame:
    """A JSON object as a two-column relation; keys that start with ``_`` are comments, a missing file is empty."""
    empty = spark.createDataFrame([], f"{key} string, {value} string")
    if not _exists(spark, path):
        return empty
    return parse_mapping(spark.read.text(path, wholetext=True), "value", key, value)


def parse_mapping(texts: DataFrame, text: str, key: str = "code", value: str = "label") -> DataFrame:
    pairs = F.explode(F.from_json(F.col(text), "map<string,string>"))
    return texts.select(pairs.alias(key, value)).where(~F.startswith(F.col(key), F.lit("_")))


def indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fixed.INDICATORS)), "pos int, code string")


def display_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.DISPLAY_NAMES.items()), "code string, display string")


def categories(spark: SparkSession) -> DataFrame:
    rows = [(c, f) for c, features in fixed.CATEGORIES.items() for f in features]
    return spark.createDataFrame(rows, "category string, feature string")


def model_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.MODEL_LABELS.items()), "key string, label string")
