"""Data fingerprints and results that are reused while the data stays the same."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.scalar import quoted
from panelkit.sources.tables import _exists


class DataChanged(ValueError):
    """The data does not match the fingerprint stored with a model or result."""


def fingerprint(df: DataFrame) -> DataFrame:
    """``rows, fingerprint``: an order-free sum of row hashes; copies of a row count."""
    row = F.to_json(F.struct(*[quoted(c) for c in sorted(df.columns)]))
    bits = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(bits).cast("string").alias("fingerprint"))


def fingerprint_text(df: DataFrame) -> str:
    row = fingerprint(df).first()
    return f"{row['rows']}-{row['fingerprint']}"


def check_unchanged(df: DataFrame, stored: str, raise_on_change: bool = True) -> bool:
    same = fingerprint_text(df) == stored
    if not same and raise_on_change:
        raise DataChanged("the data differs from the data the result was computed on")
    return same


def _place(folder: str, data: DataFrame, parameters: dict[str, Any]) -> str:
    """Where results of this data and these parameters lie."""
    text = json.dumps(parameters, sort_keys=True, default=str)
    digest = hashlib.sha256(text.encode()).hexdigest()[:24]
    return f"{folder.rstrip('/')}/fingerprint={fingerprint_text(data)}/params={digest}"


def reuse_parts(
    spark: SparkSession, folder: str, data: DataFrame, parameters: dict[str, Any], wanted: Sequence[int],
    build: Callable[[list[int]], DataFrame], part: str = "replicate",
) -> DataFrame:
    """A result table of numbered parts, of which only those not stored yet are built: with 60 of 100 stored, 40.

    Each call adds one batch below the fingerprint of the data and the hash of the parameters; a batch counts once it is complete. A part that two
    callers stored at the same time is read from one of them.
    """
    path = _place(folder, data, parameters)

    def complete() -> list[str]:
        if not _exists(spark, path):
            return []
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
        return [f"{path}/{n}" for n in sorted(names) if n.startswith("batch=") and _exists(spark, f"{path}/{n}/_SUCCESS")]

    def stored(batches: list[str]) -> DataFrame:
        return spark.read.option("basePath", path).parquet(*batches)

    batches = complete()
    held = {r[0] for r in stored(batches).select(part).distinct().collect()} if batches else set()
    missing = sorted(set(wanted) - held)
    if missing:
        build(missing).write.parquet(f"{path}/batch={uuid.uuid4().hex}")
        batches = complete()
    rows = stored(batches).where(F.col(part).isin(list(wanted)))
    first = rows.groupBy(part).agg(F.min("batch").alias("batch"))
    return rows.join(first, [part, "batch"], "left_semi").drop("batch")


def reuse(
    spark: SparkSession, folder: str, data: DataFrame, parameters: dict[str, Any], build: Callable[[], DataFrame]
) -> DataFrame:
    """A result table kept under the fingerprint of its data and the hash of its parameters."""
    path = _place(folder, data, parameters)
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
