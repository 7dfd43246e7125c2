"""Tiered dictionary lookups and feature-list predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import title_case


def display_name(df: DataFrame, code: str, dictionary: DataFrame, name: str = "display") -> DataFrame:
    """Dictionary text for a code: exact match, else case-insensitive, else the code in title case.

    ``dictionary`` has columns ``code, display``; when codes differ only in case the smallest wins.
    """
    exact = dictionary.groupBy(F.col("code").alias(code)).agg(F.min("display").alias("exact_name"))
    folded = dictionary.groupBy(F.upper("code").alias("folded_code")).agg(F.min_by("display", "code").alias("folded_name"))
    return (
        df.join(exact, code, "left")
        .withColumn("folded_code", F.upper(code))
        .join(folded, "folded_code", "left")
        .withColumn(name, F.coalesce("exact_name", "folded_name", title_case(F.col(code))))
        .drop("exact_name", "folded_name", "folded_code")
    )


def model_label(df: DataFrame, key: str, labels: DataFrame, name: str = "label_text") -> DataFrame:
    """Display label of a model key, ignoring case; unknown keys in title case. ``labels``: ``key, label``."""
    side = labels.groupBy(F.lower("key").alias("folded_key")).agg(F.min_by("label", "key").alias("known_label"))
    return (
        df.withColumn("folded_key", F.lower(key))
        .join(side, "folded_key", "left")
        .withColumn(name, F.coalesce("known_label", title_case(F.col(key))))
        .drop("folded_key", "known_label")
    )


def of_category(features: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    """Features of one category in list order; ``features``: ``pos, feature``, ``categories``: ``category, feature``."""
    chosen = categories.where(F.col("category") == category).select("feature")
    return features.join(chosen, "feature", "left_semi").select("pos", "feature").orderBy("pos")


def with_category(features: DataFrame, categories: DataFrame, fallback: str = "uncategorised") -> DataFrame:
    first = categories.groupBy("feature").agg(F.min("category").alias("category"))
    return features.join(first, "feature", "left").withColumn("category", F.coalesce("category", F.lit(fallback)))


def first_matching(features: DataFrame, text: str) -> DataFrame:
    """The first feature whose name contains the text, else the first feature of the list."""
    return features.agg(
        F.coalesce(
            F.min_by("feature", F.when(F.contains(F.lower("feature"), F.lit(text.lower())), F.col("pos"))),
            F.min_by("feature", "pos"),
        ).alias("feature")
    )
