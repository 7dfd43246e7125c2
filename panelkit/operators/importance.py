"""Relations over ``model, [replicate,] feature, importance``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import coefficient_of_variation, present
from panelkit.operators.ranks import small_rank
from panelkit.session import settled


def name_vector(vectors: DataFrame, features: DataFrame, vector: str = "importances") -> DataFrame:
    """Attach feature names to array positions: ``posexplode`` joined with ``pos, feature``."""
    others = [c for c in vectors.columns if c != vector]
    return vectors.select(*others, F.posexplode(vector).alias("pos", "importance")).join(
        features.select("pos", "feature"), "pos"
    ).select(*others, "feature", "importance")


def top_features(importances: DataFrame, keys: Sequence[str] = ("model",), n: int = 10) -> DataFrame:
    """The n largest importances per group with their rank; feature name breaks ties."""
    order = [F.col("importance").desc(), F.col("feature")]
    return importances.withColumn("rank", small_rank(keys, order)).where(F.col("rank") <= n)


def replicate_summary(samples: DataFrame, keys: Sequence[str] = ("model", "feature"), level: float = 0.95) -> DataFrame:
    """Mean, deviation, percentile interval, width and coefficient of variation over replicates.

    A group holds one value per replicate, so the exact percentile stays small.
    """
    tail = (1.0 - level) / 2.0
    found = samples.groupBy(*keys).agg(
        F.avg("importance").alias("mean_importance"), F.stddev_pop("importance").alias("std_importance"),
        F.percentile("importance", [tail, 1.0 - tail]).alias("bounds"),
    )
    lower, upper = F.col("bounds")[0], F.col("bounds")[1]
    return found.select(
        *keys, "mean_importance", "std_importance", lower.alias("ci_lower"), upper.alias("ci_upper"),
        (upper - lower).alias("ci_width"),
        coefficient_of_variation(F.col("mean_importance"), F.col("std_importance")).alias("cv"),
    )


def completed(importances: DataFrame, key: str, features: DataFrame) -> DataFrame:
    """Every key with every listed feature; features a key lacks count as zero.

    Keys are models or segments and features are columns, so the product is schema-sized.
    """
    present = importances.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("known"))
    names = features.select("feature").distinct().agg(F.sort_array(F.collect_set("feature")).alias("names")).first()["names"]
    return present.select(
        key, "known", F.explode(F.array(*[F.lit(n) for n in names])).alias("feature")
    ).select(key, "feature", F.coalesce(F.try_element_at("known", F.col("feature")), F.lit(0.0)).alias("importance"))


def importance_matrix(importances: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Key x feature matrix over the union of the keys' top n features."""
    top = top_features(importances, [key], n)
    union = top.select("feature").distinct()
    names = sorted(r["feature"] for r in union.collect())
    filled = completed(top.select(key, "feature", "importance"), key, union)
    return filled.groupBy(key).agg(*[F.max(F.when(F.col("feature") == f, F.col("importance"))).alias(f) for f in names])


def consensus(first: DataFrame, second: DataFrame, top: int = 10, keep: int = 5) -> DataFrame:
    """Features ranked within ``top`` in both relations, ordered by mean rank; inputs are ``feature, rank``."""
    a = first.where(F.col("rank") <= top).select("feature", F.col("rank").alias("rank_a"))
    b = second.where(F.col("rank") <= top).select("feature", F.col("rank").alias("rank_b"))
    mean = (F.col("rank_a") + F.col("rank_b")) / F.lit(2.0)
    return a.join(b, "feature").select("feature", mean.alias("mean_rank")).orderBy("mean_rank", "feature").limit(keep)


def correlation_importance(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]
) -> DataFrame:
    """Model-free importances: squared correlation with the target, scaled to sum one per group."""
    return _shares(df.groupBy(*keys).agg(*[F.pow(F.corr(f, target), F.lit(2.0)).alias(f) for f in features]), features, keys)


def _shares(squares: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    whole = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in features), F.lit(0.0))
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.try_divide(F.coalesce(F.col(f), F.lit(0.0)), whole).alias("importance"))
        for f in features
    ])
    return squares.select(*keys, F.inline(pairs))


def replicate_importance(
    df: DataFrame, features: Sequence[str], target: str, models: Column, weights: Column,
    make: Callable[[list[str | None]], np.ndarray] | None = None,
) -> DataFrame:
    """``model, replicate, feature, importance``: ``correlation_importance`` of every model and replicate without a copy of any row.

    ``models`` is an array of the models that a row belongs to, ``weights`` an array of its weight in each replicate, or the key of which
    ``make`` makes them (rows x replicates) in the task, so that rows carry none. A task multiplies its
    weights (rows x replicates) by its moments (rows x 6 a feature) and hands on one row per model and replicate. Values are centred
    first, so that sums of squares keep their digits; rows without a value or target do not count for that feature.
    """
    names = [f"x{i}" for i in range(len(features))]
    df = settled(df, "replicate-rows")
    rows = df.select(
        *[present(df, f).cast("double").alias(n) for f, n in zip(features, names)], present(df, target).cast("double").alias("y"),
        models.alias("models"), weights.cast("array<double>" if make is None else "string").alias("weights"))
    middle = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in [*names, "y"]]).first()
    centre, parts = [middle[c] for c in names], 6

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float) - middle["y"]
            columns = []
            for name, mean in zip(names, centre):
                x = batch.column(name).to_numpy(zero_copy_only=False).astype(float) - mean
                known = ~(np.isnan(x) | np.isnan(y))
                a, b = np.where(known, x, 0.0), np.where(known, y, 0.0)
                columns += [known.astype(float), a, b, a * a, b * b, a * b]
            values = np.stack(columns, axis=1)
            held = batch.column("weights")
            weight = held.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) if make is None else make(held.to_pylist()).astype(float)
            lists = batch.column("models")
            owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
            labels = lists.flatten().dictionary_encode()
            places = labels.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for place, model in enumerate(labels.dictionary.to_pylist()):
                own = owner[places == place]
                part = weight[own].T @ values[own]
                found[model] = found[model] + part if model in found else part
        for model, sums in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([model] * len(sums), pa.string()), pa.array(np.arange(len(sums)), pa.int32()), *[pa.array(c) for c in sums.T]],
                ["model", "replicate", *[f"s{k}" for k in range(sums.shape[1])]])

    sums = [f"s{k}" for k in range(parts * len(features))]
    schema = "model string, replicate int, " + ", ".join(f"{s} double" for s in sums)
    whole = rows.mapInArrow(moments, schema).groupBy("model", "replicate").agg(*[F.sum(s).alias(s) for s in sums])

    def square(k: int) -> Column:
        n, x, y, xx, yy, xy = (F.col(f"s{parts * k + j}") for j in range(parts))
        spread = (xx - x * x / n) * (yy - y * y / n)
        return F.when((n > 0) & (spread > 0), F.pow(xy - x * y / n, F.lit(2.0)) / spread)

    keys = ["model", "replicate"]
    return _shares(whole.select(*keys, *[square(k).alias(f) for k, f in enumerate(features)]), features, keys)
