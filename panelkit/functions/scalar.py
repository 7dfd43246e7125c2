"""Column builders: derivations, bands, labels and number formats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def present(df: DataFrame, name: str) -> Column:
    """A column with NaN turned into NULL, so that both count as missing."""
    value = quoted(name)
    return F.when(~F.isnan(value), value) if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else value


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def divide(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """Ratio times scale; NULL when the denominator is zero or missing."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return ratio if scale == 1.0 else ratio * F.lit(float(scale))


def log1p(value: Column) -> Column:
    """log(1 + x); NULL at and below -1."""
    return F.when(value > F.lit(-1.0), F.log1p(value))


def total(columns: Sequence[Column]) -> Column:
    """Row sum in which a missing value counts as zero."""
    return reduce(add, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])


def diversity(columns: Sequence[Column]) -> Column:
    """One minus the sum of squared shares of the row total."""
    whole = total(columns)
    squares = [F.pow(F.coalesce(F.try_divide(c, whole), F.lit(0.0)), F.lit(2.0)) for c in columns]
    return F.lit(1.0) - reduce(add, squares)


def band(value: Column, bands: Sequence[tuple[float | None, float | None, str]]) -> Column:
    """Label of the half-open band ``lower <= value < upper``; an open side is None."""
    expr = None
    for lower, upper, label in bands:
        inside = F.lit(True)
        if lower is not None:
            inside = inside & (value >= F.lit(float(lower)))
        if upper is not None:
            inside = inside & (value < F.lit(float(upper)))
        expr = F.when(inside, label) if expr is None else expr.when(inside, label)
    return F.when(value.isNotNull(), expr)


def right_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin ``(edge, next edge]`` with open outer bins."""
    expr = F.when(value <= F.lit(float(edges[0])), labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        expr = expr.when(value <= F.lit(float(edge)), label)
    return expr.when(value > F.lit(float(edges[-1])), labels[len(edges)])


def stars(p_value: Column) -> Column:
    return (
        F.when(p_value < 0.001, "***").when(p_value < 0.01, "**").when(p_value < 0.05, "*").otherwise("ns")
    )


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def better_of(statistic: Column, first: Column, second: Column) -> Column:
    """The first name when the statistic of first minus second is negative."""
    return F.when(statistic < 0, first).otherwise(second)


def pair_label(first: Column, second: Column) -> Column:
    return F.concat_ws(" vs ", first, second)


def title_case(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def ellipsis(text: Column, width: int = 30) -> Column:
    """Cut to ``width`` characters and mark the cut with three dots."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def interval(lower: Column, upper: Column, decimals: int = 4) -> Column:
    return F.format_string(f"[%.{decimals}f, %.{decimals}f]", lower, upper)


def escape_special(text: Column) -> Column:
    """Backslash before percent, ampersand and underscore, for typeset tables."""
    return F.regexp_replace(text, "([%&_])", "\\\\$1")


def coefficient_of_variation(mean: Column, deviation: Column) -> Column:
    """Deviation over mean; NULL (not infinity) when the mean is not positive."""
    return F.when(mean > 0, F.try_divide(deviation, mean))


def adaptive_fraction(rows: Column) -> Column:
    """Test share of a segment: at least ten rows where possible, between 10 % and 20 %."""
    return F.least(F.lit(0.2), F.greatest(F.lit(0.1), F.try_divide(F.lit(10.0), rows.cast("double"))))


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile by Acklam's published rational approximation (relative error 1.2e-9)."""
    # fixed values: Acklam's coefficients
    a = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
         1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0]
    b = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
         6.680131188771972e1, -1.328068155288572e1]
    c = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0,
         -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0]
    d = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0]

    def horner(coefficients: Sequence[float], x: Column) -> Column:
        return reduce(lambda acc, k: acc * x + F.lit(k), coefficients[1:], F.lit(coefficients[0]))

    def tail(q: Column) -> Column:
        return horner(c, q) / (horner(d, q) * q + F.lit(1.0))

    centre = p - F.lit(0.5)
    square = centre * centre
    middle = horner(a, square) * centre / (horner(b, square) * square + F.lit(1.0))
    low = F.sqrt(F.lit(-2.0) * F.ln(p))
    high = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(middle)
