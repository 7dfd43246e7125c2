"""Registry of runnable queries: a Spark builder and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = settle_rounding(sql)
        return function

    return add


# Averages of values with few decimals often end in an exact half of the last kept digit, which engines round
# either way after summing in another order. A nudge far below that digit settles such halves on both sides.
def _nudge(digits: int) -> float:
    return float(f"2e-{digits + 3}")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; sums taken in another order differ in the last bits."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: r(F.col(f"`{c}`"), digits) for c in doubles})


def r(column: Column | str, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value + F.lit(_nudge(digits)), digits)


def q(columns: list[str], digits: int = 6) -> str:
    """SQL select list that rounds each column under its own name."""
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _simpson(upper: str, integrand: str, steps: int = 4000) -> str:
    """SQL for the integral of ``integrand`` (in ``x``) from 0 to ``upper``."""
    point = integrand.replace("{x}", f"(i * ({upper}) / {steps}::DOUBLE)")
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)::DOUBLE"
    return f"(({upper}) / {3 * steps}::DOUBLE * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {point})))"


def t_two_sided_sql(t: str, free: str) -> str:
    """SQL for the two-sided p-value of Student's t: the density is integrated over the angle atan(t / sqrt(free))."""
    factor = f"exp(lgamma((({free}) + 1) / 2.0::DOUBLE) - lgamma(({free}) / 2.0::DOUBLE)) / sqrt(pi())"
    inner = _simpson(f"atan(abs({t}) / sqrt(({free})::DOUBLE))", f"pow(cos({{x}}), ({free}) - 1)")
    return f"greatest(0::DOUBLE, 1 - 2 * {factor} * {inner})"


def t_greater_sql(t: str, free: str) -> str:
    two = t_two_sided_sql(t, free)
    return f"(CASE WHEN ({t}) >= 0 THEN {two} / 2 ELSE 1 - {two} / 2 END)"


def normal_two_sided_sql(z: str) -> str:
    return f"greatest(0::DOUBLE, 1 - 2 / sqrt(2 * pi()) * {_simpson(f'least(abs({z}), 38::DOUBLE)', 'exp(-0.5::DOUBLE * {x} * {x})')})"


def settle_rounding(sql: str) -> str:
    """Add the same nudge to every ``round(x, d)`` of a SQL text."""
    out, place = [], 0
    while True:
        start = sql.find("round(", place)
        if start < 0:
            return "".join(out) + sql[place:]
        depth, comma, end = 1, -1, start + 6
        while depth:
            char = sql[end]
            depth += (char == "(") - (char == ")")
            if char == "," and depth == 1:
                comma = end
            end += 1
        inner, digits = sql[start + 6 : comma], int(sql[comma + 1 : end - 1])
        out.append(f"{sql[place:start]}round(({settle_rounding(inner)}) + {_nudge(digits)!r}::DOUBLE, {digits})")
        place = end
