"""Long indicator records to one wide entity x time panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import quoted


def repeated_keys(long: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys that occur more than once for one indicator."""
    return long.groupBy(*keys, name).count().where(F.col("count") > 1)


def widen(
    long: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str], aggregate=F.max
) -> DataFrame:
    """One column per listed indicator: the full outer join of all indicators on the keys, as one shuffle.

    Each indicator must be unique per key (see ``repeated_keys``); ``aggregate`` decides otherwise.
    """
    return long.groupBy(*keys).agg(
        *[aggregate(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    ).where(reduce(lambda a, b: a | b, [quoted(n).isNotNull() for n in names]))


def outer_join_all(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of frames with schemas of their own; used when they cannot be put in long form."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), frames)


def between_years(df: DataFrame, year: str, start: int, end: int) -> DataFrame:
    return df.where(F.col(year).between(start, end))


def with_year_feature(df: DataFrame, year: str = "year", name: str = "year_feature") -> DataFrame:
    return df.withColumn(name, F.col(year))


def panel_size(df: DataFrame, entity: str, approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count(F.lit(1)).alias("rows"), counter(F.col(entity)).alias("entities"))


def distinct_years(df: DataFrame, year: str = "year") -> DataFrame:
    return df.select(year).distinct().orderBy(year)


def preview(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(rows)
