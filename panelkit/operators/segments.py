"""Segments by quartile, by fixed band and by lookup table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import right_closed
from panelkit.operators.quantiles import exact_quantiles
from panelkit.session import settled, sized

QUARTILE_LABELS = ("Low", "Lower-Middle", "Upper-Middle", "High")
MIN_SEGMENT_ROWS = 30


def quartile_segment(
    df: DataFrame, column: str, labels: Sequence[str] = QUARTILE_LABELS, name: str = "segment"
) -> DataFrame:
    df = settled(df)
    edges = exact_quantiles(df, [column], [0.25, 0.5, 0.75]).get((), {}).get(column, [None])
    if edges[0] is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn(name, right_closed(F.col(column), edges, labels))


def lookup_segment(
    df: DataFrame, key: str, dimension: DataFrame, name: str = "segment", fallback: str = "Other"
) -> DataFrame:
    """Left lookup ``key -> label`` in a two-column dimension; unmatched rows get the fallback.

    No broadcast hint: the dimension is read with its real size, so the planner broadcasts it when it is
    small and splits skewed keys when it is not.
    """
    code, label = dimension.columns
    side = dimension.groupBy(F.col(code).alias(key)).agg(F.min(label).alias(name))  # a repeated key must not multiply rows
    return df.join(side, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(fallback)))


def unmatched_keys(df: DataFrame, key: str, dimension: DataFrame, first: int = 10) -> DataFrame:
    """How often, and for which keys, the lookup fails: total rows, the first keys and how many keys remain."""
    code = dimension.columns[0]
    missing = settled(df.groupBy(key).count().join(dimension.select(F.col(code).alias(key)), key, "left_anti"), "unmatched-keys")
    listed = [r[key] for r in missing.orderBy(key).limit(first).collect()]
    return missing.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("unmatched_rows"),
        F.count(F.lit(1)).alias("unmatched_keys"),
    ).select(
        "unmatched_rows", "unmatched_keys", F.lit(",".join(str(k) for k in listed)).alias("first_keys"),
        F.greatest(F.col("unmatched_keys") - F.lit(first), F.lit(0)).cast("long").alias("more_keys"),
    )


def segment_summary(df: DataFrame, segment: str, target: str) -> DataFrame:
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"), F.stddev_pop(target).alias("std")
    )


def large_segments(df: DataFrame, segment: str, minimum: int = MIN_SEGMENT_ROWS) -> DataFrame:
    """Rows of segments with at least ``minimum`` rows; rows without a segment are left out."""
    kept = df.where(F.col(segment).isNotNull()).groupBy(segment).count().where(F.col("count") >= minimum)
    return df.join(sized(kept.select(segment), "segments"), segment, "left_semi")


def target_bands(boundaries: Sequence[float | None]) -> list[tuple[float | None, float | None, str]]:
    """Left-closed bands from consecutive boundaries; None at the end leaves the last band open."""
    bands = []
    for low, high in zip(boundaries, boundaries[1:]):
        label = f"{low:g}+" if high is None else f"{low:g}-{high:g}"
        bands.append((low, high, label))
    return bands
