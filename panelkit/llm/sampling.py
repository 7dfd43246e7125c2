"""Bounded samples of labelled rows for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELS = 256


def fold(key: str, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))


def order(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))


def labelled_sample(rows: DataFrame, key: str, label: str, per_label: int, seed: int) -> DataFrame:
    """At most about ``per_label`` rows of each label, and never more than ``per_label`` times the number of labels.

    Labels are the ``MAX_LABELS`` most frequent ones. Rows are chosen by a hash of the id, at a rate that follows the label's count.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(MAX_LABELS).collect()
    if not counts:
        return rows.limit(0)
    share = F.lit(None).cast("double")
    for row in counts:
        share = F.when(F.col(label) == F.lit(row[0]), F.lit(min(1.0, per_label / row["count"]))).otherwise(share)
    place = order(key, seed)
    chosen = rows.where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
    return chosen.orderBy(place, key).limit(per_label * len(counts))


def excerpts(text: str, key: str, count: int, length: int, seed: int) -> Column:
    """``count`` cuts of ``length`` characters at hashed places of the whole text."""
    span = F.greatest(F.length(text) - F.lit(length), F.lit(0)) + 1
    return F.array(*[
        F.substring(F.col(text), F.pmod(order(key, seed + k), span).cast("int") + F.lit(1), F.lit(length)) for k in range(count)
    ])
