"""Train/test splits, folds, bootstrap weights and permutations from row keys only."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.hashing import hash_bucket, hash_prefix, hash_uniform, poisson_one
from panelkit.functions.scalar import adaptive_fraction, quoted
from panelkit.operators.ranks import hash_positions
from panelkit.session import materialise, sized

SEED = 42
#: Rows of all replicates that a task lines up at most, by uniform digests.
SHUFFLED_ROWS = 1 << 19


def split_column(key: str, test_fraction: float = 0.2, seed: int = SEED) -> Column:
    """'train' or 'test' by the key's hash: the same under any partitioning and input order."""
    train = round((1.0 - test_fraction) * 100)
    return F.when(hash_bucket(F.col(key), str(seed)) < train, "train").otherwise("test")


def with_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    return df.withColumn("split", split_column(key, test_fraction, seed))


def with_segment_split(df: DataFrame, key: str, segment: str, seed: int = SEED) -> DataFrame:
    """Split with the segment's own test share (see ``adaptive_fraction``)."""
    sizes = df.groupBy(segment).agg(F.count(F.lit(1)).alias("segment_rows"))
    shares = sizes.withColumn("test_fraction", adaptive_fraction(F.col("segment_rows")))
    draw = hash_uniform(F.col(key), str(seed))
    return df.join(sized(shares, "segment-shares"), segment).withColumn(
        "split", F.when(draw < F.lit(1.0) - F.col("test_fraction"), "train").otherwise("test")
    )


def fold_column(key: str, folds: int = 5, seed: int = SEED) -> Column:
    return F.pmod(hash_prefix(F.col(key), f"fold{seed}"), F.lit(folds)).cast("int")


def bootstrap_salt(replicate: int, seed: int = SEED) -> str:
    """The salt of ``bootstrap_weight``."""
    return f"boot{seed}:{replicate}"


def bootstrap_weight(key: str, replicate: Column | int, seed: int = SEED) -> Column:
    """How often a row is drawn in a replicate: Poisson(1), the large-n limit of sampling with replacement."""
    salt = replicate if isinstance(replicate, Column) else F.lit(replicate)
    return poisson_one(hash_uniform(F.col(key), F.concat(F.lit(f"boot{seed}:"), salt.cast("string"))))


def bootstrap_weights(key: str, replicates: int, seed: int = SEED) -> Column:
    """All replicate weights of a row as one array column."""
    return F.array(*[bootstrap_weight(key, r, seed) for r in range(replicates)])


def shuffled_values(
    df: DataFrame, key: str, columns: Sequence[str], replicates: int, seed: int = SEED
) -> DataFrame:
    """``replicate, key, <column>_shuffled``: each row paired with the values of another row, per replicate.

    Two orders of the same rows are lined up: one by a fixed hash of the key, one by the replicate's hash.
    The fixed order is ranked once; each replicate ranks its own order and joins on (replicate, position).
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    base = hash_positions(
        df.select(key, F.md5(F.concat(F.col(key).cast("string"), F.lit(f":base{seed}"))).alias("digest")), [], "digest"
    ).select(F.col(key), F.col("position"))
    donors = df.select(key, *[F.col(c).alias(f"{c}_shuffled") for c in columns], reps.alias("replicate")).withColumn(
        "digest",
        F.md5(F.concat(F.col(key).cast("string"), F.lit(f":perm{seed}:"), F.col("replicate").cast("string"))),
    )
    donors = hash_positions(donors, ["replicate"], "digest").drop("digest", key)
    return base.join(donors, "position").select(
        "replicate", key, *[f"{c}_shuffled" for c in columns]
    )


def with_shuffled_values(
    df: DataFrame, key: str, columns: Sequence[str], replicates: int, seed: int = SEED
) -> DataFrame:
    """``replicate``, the other columns of ``df`` and ``<column>_shuffled``: ``df`` joined by ``key`` with its ``shuffled_values``.

    The rows of all replicates are shuffled once, by the first digits of their digests, and put in order there. Digests are uniform, so the
    positions that such a bucket holds are nearly the same in every replicate: the rows at these positions are sent to the bucket. What the driver
    sees is one count for each replicate and bucket.
    """
    names = [c for c in df.columns if c != key]
    df = df.where(F.col(key).isNotNull())
    digest = lambda salt: F.unhex(F.md5(F.concat(F.col(key).cast("string"), salt)))
    base = hash_positions(df.select(key, F.md5(F.concat(F.col(key).cast("string"), F.lit(f":base{seed}"))).alias("digest")), [], "digest")
    base = materialise(df.join(base.select(key, "position"), key).select("position", *[quoted(c).alias(f"o{i}") for i, c in enumerate(names)]), "permutation-base")
    digits = max(0, math.ceil(math.log(max(base.count() * replicates / SHUFFLED_ROWS, 1), 16)))
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    donors = df.select(F.col(key), *[quoted(c).alias(f"l{i}") for i, c in enumerate(columns)], reps.alias("replicate")).withColumn(
        "digest", digest(F.concat(F.lit(f":perm{seed}:"), F.col("replicate").cast("string")))).drop(key).withColumn(
        "bucket", F.conv(F.hex(F.substring("digest", 1, (digits + 1) // 2)), 16, 10).cast("int") if digits else F.lit(0))
    if digits % 2:
        donors = donors.withColumn("bucket", F.shiftright("bucket", 4))
    sizes = donors.groupBy("replicate", "bucket").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros((replicates, 16**digits), np.int64)
    counts[sizes["replicate"], sizes["bucket"]] = sizes["n"]
    ends = np.cumsum(counts, axis=1)
    starts = ends - counts
    # positions of a bucket in any replicate
    low, high = starts.min(axis=0), ends.max(axis=0)

    @F.pandas_udf("array<int>")
    def places(position: pd.Series) -> pd.Series:
        at = position.to_numpy() - 1
        first, last = np.searchsorted(high, at, "right"), np.searchsorted(low, at, "right")
        return pd.Series([np.arange(a, b, dtype=np.int32) for a, b in zip(first, last)])

    def line_up(own: pa.Table, lent: pa.Table) -> pa.Table:
        lent = lent.sort_by([("replicate", "ascending"), ("digest", "ascending")])
        own = own.sort_by("position")
        replicate = lent.column("replicate").to_numpy()
        if len(lent):
            begins = np.searchsorted(replicate, replicate, "left")
            position = starts[replicate, lent.column("bucket")[0].as_py()] + np.arange(len(lent)) - begins + 1
        else:
            position = np.zeros(0, np.int64)
        known = own.column("position").to_numpy()
        first = np.searchsorted(known, position, "left")
        times = np.searchsorted(known, position, "right") - first
        giver = np.repeat(np.arange(len(lent)), times)
        taker = np.repeat(first - np.cumsum(times) + times, times) + np.arange(len(giver))
        own, lent = own.take(pa.array(taker)), lent.take(pa.array(giver))
        return pa.table([lent.column("replicate"), *[own.column(f"o{i}") for i in range(len(names))], *[lent.column(f"l{i}") for i in range(len(columns))]],
                        names=[f.name for f in schema.fields])

    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField("replicate", T.IntegerType()), *[T.StructField(c, kinds[c]) for c in names],
                           *[T.StructField(f"{c}_shuffled", kinds[c]) for c in columns]])
    placed = base.withColumn("bucket", F.explode(places("position")))
    return placed.groupBy("bucket").cogroup(donors.groupBy("bucket")).applyInArrow(line_up, schema)
