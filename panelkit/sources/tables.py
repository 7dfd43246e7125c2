"""Table, feature-list and text scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from panelkit.functions.scalar import quoted


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, format: str | None = None) -> DataFrame:
    """Parquet or CSV (with header) by suffix or ``format``; NaN is turned into NULL."""
    kind = format or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
        df = (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
    else:
        df = reader.format(kind).load(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats}) if floats else df


def safe_name(name: str) -> str:
    return name.replace(".", "_")


def safe_columns(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores; dictionaries keep the original codes."""
    return df.toDF(*[safe_name(c) for c in df.columns])


def write_table(df: DataFrame, path: str, format: str = "parquet", single_file: bool = False, **options: str) -> None:
    """Overwrite a table; ``single_file`` is for result-sized relations only."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").options(**options)
    (writer.option("header", True).csv(path) if format == "csv" else writer.format(format).save(path))


def feature_list(spark: SparkSession, features: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(features)), "pos int, feature string")


def write_feature_list(spark: SparkSession, features: Sequence[str], path: str) -> None:
    write_table(feature_list(spark, features), path, single_file=True)


def read_feature_list(spark: SparkSession, path: str | None, df: DataFrame, target: str) -> list[str]:
    """Stored order, or every column but the target when no list was stored."""
    if path is not None and _exists(spark, path):
        return [r["feature"] for r in spark.read.parquet(path).orderBy("pos").collect()]
    return [c for c in df.columns if c != target]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_report(lines: DataFrame, path: str) -> None:
    """Text sink of a ``line_no, line`` relation in order; reports are result-sized."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
