"""Ranks and positions inside groups of any size.

A window over a whole group would sort it in one task. Here values are first cut into buckets at sketched
quantiles, the window runs inside a (group, bucket), and the small table of bucket sizes supplies the offsets.
A value that alone fills a bucket gets a bucket of its own, which may then be cut again by a row hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import settled

ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS = 16


def value_bounds(df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Bucket edges: sketched quantiles of ``value``; a repeated quantile becomes a one-value bucket."""
    size = df.count()
    buckets = max(MIN_BUCKETS, math.ceil(size / rows_per_bucket))
    steps = [k / buckets for k in range(1, buckets)]
    found = df.approxQuantile(value, steps, 1.0 / (4 * buckets)) if size else []
    edges: list[float] = []
    for k, edge in enumerate(found):
        if not edges or edge > edges[-1]:
            edges.append(edge)
        if k and found[k - 1] == edge:
            after = math.nextafter(edge, math.inf)
            if after > edges[-1]:
                edges.append(after)
    return edges


def with_bucket(df: DataFrame, value: str, edges: Sequence[float], name: str = "bucket") -> DataFrame:
    if not edges:
        return df.withColumn(name, F.lit(0))
    splits = [-math.inf, *edges, math.inf]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep")
    return cut.transform(df).withColumn(name, F.col(name).cast("int"))


def single_value_buckets(edges: Sequence[float]) -> list[int]:
    return [k + 1 for k in range(len(edges) - 1) if edges[k + 1] == math.nextafter(edges[k], math.inf)]


def average_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    counts: dict[str, Column] | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Tie-averaged rank of every distinct value in its group: ``keys, value, ties, rank`` and extra counts.

    Ties are folded into counts before the first shuffle, so a frequent value costs one row.
    """
    keys = list(keys)
    extra = counts or {}
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("ties"), *[c.alias(n) for n, c in extra.items()]
    )
    if edges is None:
        distinct = settled(distinct, "distinct-values")
        edges = value_bounds(distinct, value)
    placed = with_bucket(distinct, value, edges)
    sizes = placed.groupBy(*keys, "bucket").agg(F.sum("ties").alias("size"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("before", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    rank = F.col("offset") + F.col("before") + (F.col("ties") + F.lit(1)) / F.lit(2.0)
    return local.join(offsets, [*keys, "bucket"]).select(*keys, value, "ties", *extra, rank.alias("rank"))


def positions(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "position",
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Row positions 1..n in each group ordered by ``value``; equal values follow a hash of ``tie``, then ``tie``."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    if edges is None:
        rows = settled(rows, "ordered-rows")
        edges = value_bounds(rows, value)
    placed = with_bucket(rows, value, edges)
    alone = single_value_buckets(edges)
    pieces = max(1, math.ceil(placed.where(F.col("bucket").isin(alone)).count() / ROWS_PER_BUCKET)) if alone else 1
    spread = F.pmod(F.xxhash64(tie), F.lit(pieces)).cast("int")
    placed = placed.withColumn("part", F.when(F.col("bucket").isin(alone), spread).otherwise(0) if alone else F.lit(0))
    sizes = placed.groupBy(*keys, "bucket", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy(*keys).orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "bucket", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "bucket", "part").orderBy(value, F.xxhash64(tie), tie)
    local = placed.withColumn("local", F.row_number().over(inside))
    return local.join(offsets, [*keys, "bucket", "part"]).select(
        *df.columns, (F.col("offset") + F.col("local")).cast("long").alias(name)
    )


def hash_positions(df: DataFrame, keys: Sequence[str], digest: str, name: str = "position") -> DataFrame:
    """Positions 1..n ordered by a hex digest column; digests are uniform, so a prefix that fits their number is the bucket."""
    keys = list(keys)
    digits = 1 + int(math.log(max(df.count() / ROWS_PER_BUCKET, 1), 16))
    placed = df.withColumn("bucket", F.substring(digest, 1, digits))
    sizes = placed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(digest)
    local = placed.withColumn("local", F.row_number().over(inside))
    return local.join(offsets, [*keys, "bucket"]).select(
        *df.columns, (F.col("offset") + F.col("local")).cast("long").alias(name)
    )


def small_rank(partition: Sequence[str], order: Sequence[Column], name: str = "rank") -> Column:
    """row_number for result-sized groups (models, features, segments)."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).alias(name)


def tied_rank(partition: Sequence[str], value: str) -> Column:
    """Tie-averaged rank for result-sized groups."""
    ordered = Window.partitionBy(*partition).orderBy(value)
    same = Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - F.lit(1)) / F.lit(2.0)
