"""Mean, median and nearest-neighbour imputation behind one dispatcher."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import present
from panelkit.operators.neighbours import knn_impute
from panelkit.operators.quality import drop_incomplete_rows, drop_sparse_columns
from panelkit.operators.quantiles import exact_quantiles
from panelkit.session import settled


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(present(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    found = exact_quantiles(df, columns, [0.5]).get((), {})
    return {c: found.get(c, [None])[0] for c in columns}


def fill(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Replace NULL and NaN by the fitted value of the column; columns without any value stay NULL."""
    return df.withColumns(
        {c: F.coalesce(present(df, c).cast("double"), F.lit(v)) for c, v in values.items() if v is not None}
    )


def mean_impute(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    df = df if fit_on is not None else settled(df)
    return fill(df, column_means(df if fit_on is None else fit_on, columns))


def median_impute(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    df = df if fit_on is not None else settled(df)
    return fill(df, column_medians(df if fit_on is None else fit_on, columns))


def handle_missing(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = "knn",
    threshold: float = 0.6,
    row_id: str | None = None,
    n_neighbors: int = 5,
    fit_on: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Drop sparse columns, then impute or drop rows; returns the frame and the kept feature columns."""
    df, dropped = drop_sparse_columns(df, columns, threshold)
    kept = [c for c in columns if c not in dropped]
    if fit_on is not None:
        fit_on = fit_on.drop(*dropped)
    if strategy == "mean":
        return mean_impute(df, kept, fit_on), kept
    if strategy == "median":
        return median_impute(df, kept, fit_on), kept
    if strategy == "drop":
        return drop_incomplete_rows(df, kept), kept
    if strategy == "knn":
        if row_id is None:
            raise ValueError("nearest-neighbour imputation needs a unique row id column")
        return knn_impute(df, row_id, kept, n_neighbors, fit_on=fit_on), kept
    raise ValueError(f"unknown strategy: {strategy}")
