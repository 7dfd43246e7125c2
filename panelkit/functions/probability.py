"""Tail probabilities for result-sized relations (one row per model pair or feature)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    fraction, upper, lower = 1.0, 1.0, 0.0
    for step in range(0, 2000):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        lower = 1.0 / (1.0 + term * lower or tiny)
        upper = 1.0 + term / upper or tiny
        change = upper * lower
        fraction *= change
        if step and abs(change - 1.0) < 1e-15:
            break
    return front * (fraction - 1.0)


def student_tail(t: float, df: float) -> float:
    """P(T > t) for Student's t."""
    half = 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def _t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def _apply(function, t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [np.nan if pd.isna(a) or pd.isna(b) or b <= 0 else function(float(a), float(b)) for a, b in zip(t, df)],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def _two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(_t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def _greater_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(student_tail, t, df)


@F.pandas_udf(DoubleType())
def _erfc_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: np.nan if pd.isna(v) else math.erfc(v)).astype("float64")


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return F.nanvl(_two_sided_udf(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def t_greater(t: Column, df: Column) -> Column:
    """One-sided p-value for the alternative 'greater'."""
    return F.nanvl(_greater_udf(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return _erfc_udf(F.abs(z.cast("double")) / F.sqrt(F.lit(2.0)))
