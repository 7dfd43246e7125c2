"""Missing-value audit, column pruning and outlier filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelkit.functions.scalar import present, quoted
from panelkit.operators.quantiles import exact_quantiles
from panelkit.session import settled


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in set(without)]


def feature_columns(df: DataFrame, ids: Sequence[str], target: str) -> list[str]:
    """Every column that is neither an id nor the target."""
    taken = {*ids, target}
    return [c for c in df.columns if c not in taken]


def known_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(present(df, target).isNotNull())


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """``variable, missing, percentage`` from one aggregate over all columns, most missing first."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)])
    rows = counted.select("total", F.inline(pairs)).select(
        "variable",
        "missing",
        (F.try_divide(F.col("missing").cast("double"), F.col("total").cast("double")) * 100).alias("percentage"),
    )
    return (rows.where(F.col("missing") > 0) if only_missing else rows).orderBy(F.desc("missing"), "variable")


def remaining_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = reduce(lambda a, b: a + b, [F.when(present(df, c).isNull(), 1).otherwise(0) for c in columns])
    return df.agg(F.sum(cells).cast("long").alias("missing_cells"))


def missing_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Missing share per column; one row reaches the driver."""
    row = df.agg(*[F.avg(present(df, c).isNull().cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[i] or 0.0) for i, c in enumerate(columns)}


def drop_sparse_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.6) -> tuple[DataFrame, list[str]]:
    """Drop the columns whose missing share is strictly above the threshold; also returns their names."""
    dropped = [c for c, share in missing_shares(df.select(*[quoted(c) for c in columns]), columns).items() if share > threshold]
    return df.drop(*dropped), dropped


def drop_incomplete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def _inside_all(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """Rows that satisfy all conditions; a missing value fails its condition."""
    return df.where(reduce(and_, [F.coalesce(c, F.lit(False)) for c in conditions]))


def iqr_filter(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> DataFrame:
    """Keep rows whose columns all lie within k interquartile ranges of the quartiles."""
    df = settled(df)
    bounds = exact_quantiles(df, columns, [0.25, 0.75]).get((), {})
    conditions = []
    for c in columns:
        q1, q3 = bounds.get(c, [None, None])
        if q1 is None:
            conditions.append(F.lit(False))
        else:
            conditions.append(quoted(c).between(F.lit(q1 - k * (q3 - q1)), F.lit(q3 + k * (q3 - q1))))
    return _inside_all(df, conditions)


def zscore_filter(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> DataFrame:
    """Keep rows whose columns all have an absolute z-score (population deviation) below k."""
    df = settled(df)
    row = df.agg(
        *[f(quoted(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    conditions = [
        F.abs(F.try_divide(quoted(c) - F.lit(row[f"m{i}"]), F.lit(row[f"s{i}"]))) < F.lit(float(k))
        for i, c in enumerate(columns)
    ]
    return _inside_all(df, conditions)


def remove_outliers(df: DataFrame, columns: Sequence[str], method: str | None = "iqr", k: float = 3.0) -> DataFrame:
    if method in (None, "none"):
        return df
    if method == "iqr":
        return iqr_filter(df, columns, k)
    if method == "zscore":
        return zscore_filter(df, columns, k)
    raise ValueError(f"unknown outlier method: {method}")


def stage_audit(stages: dict[str, DataFrame]) -> DataFrame:
    """Row counts per stage in order, with the change against the stage before."""
    parts = [
        d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), F.lit(n).alias("stage"), "rows")
        for i, (n, d) in enumerate(stages.items())
    ]
    counted = reduce(DataFrame.unionByName, parts)
    before = F.lag("rows").over(Window.orderBy("step"))
    return counted.select("step", "stage", "rows", (F.col("rows") - before).alias("change"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, n, mean, std, min, max, missing_pct`` in one pass; ``n`` counts all rows, std is the sample one."""
    aggregates = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(columns):
        v = present(df, c).cast("double")
        aggregates += [
            F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"), F.count_if(v.isNull()).alias(f"miss{i}"),
        ]
    cells = F.array(*[
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{n}{i}").alias(n) for n in ("mean", "std", "min", "max", "miss")])
        for i, c in enumerate(columns)
    ])
    return df.agg(*aggregates).select("total", F.inline(cells)).select(
        "variable",
        F.col("total").alias("n"),
        "mean", "std", "min", "max",
        (F.try_divide(F.col("miss").cast("double"), F.col("total").cast("double")) * 100).alias("missing_pct"),
    )


def summary(df: DataFrame, target: str) -> DataFrame:
    t = quoted(target)
    return df.agg(F.avg(t).alias("mean"), F.stddev_pop(t).alias("std"), F.min(t).alias("min"), F.max(t).alias("max"))
