"""Exact linear-interpolation quantiles without gathering a column in one task.

One pass brackets every wanted order statistic with a mergeable quantile sketch, a second pass counts what
lies below each bracket and gathers only the values strictly inside it. Heavy ties sit on bracket edges and
are counted, never gathered. Brackets that still hold too many values are narrowed by another pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalar import quoted
from panelkit.session import settled

ACCURACY = 10_000
GATHER_LIMIT = 200_000


def _matches(keys: Sequence[str], group: tuple) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, group)])


def _per_group(keys: Sequence[str], values: dict[tuple, float | None]) -> Column:
    """A literal that depends on the group; without keys there is one group."""
    if not keys:
        return F.lit(values[()])
    expr = None
    for group, value in values.items():
        expr = F.when(_matches(keys, group), F.lit(value)) if expr is None else expr.when(_matches(keys, group), F.lit(value))
    return expr


def _expected(size: int, accuracy: int) -> int:
    """Most values a first bracket can hold: sketch errors and margins on both sides."""
    return size if 3 * size < accuracy * 2 else math.ceil(10.0 * size / accuracy)


def _clean(column: Column) -> Column:
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    accuracy: int = ACCURACY,
    gather_limit: int = GATHER_LIMIT,
) -> dict[tuple, dict[str, list[float | None]]]:
    """``{group: {column: [quantile, ...]}}``; groups must be few (models, segments), rows may be many."""
    columns, keys = list(columns), list(keys)
    source = settled(df.select(*keys, *[_clean(quoted(c)).alias(f"v{i}") for i, c in enumerate(columns)]), "quantiles")
    # every wanted quantile needs the two order statistics around position p * (n - 1)
    first = [F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]
    grid = sorted({min(1.0, max(0.0, p + d)) for p in probabilities for d in (-3.0 / accuracy, 3.0 / accuracy)})
    first += [
        F.percentile_approx(f"v{i}", [float(g) for g in grid], accuracy).alias(f"q{i}") for i in range(len(columns))
    ]
    first += [f(f"v{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("lo", F.min), ("hi", F.max))]
    rows = {tuple(r[k] for k in keys): r for r in source.groupBy(*keys).agg(*first).collect()}

    answer: dict[tuple, dict[str, list[float | None]]] = {
        g: {c: [None] * len(probabilities) for c in columns} for g in rows
    }
    brackets: dict[tuple[int, int], dict[tuple, tuple[float, float]]] = {}
    ranks: dict[tuple[int, int, tuple], tuple[int, int, float]] = {}
    for group, row in rows.items():
        for i in range(len(columns)):
            n = row[f"n{i}"]
            for j, p in enumerate(probabilities):
                if not n:
                    continue
                position = p * (n - 1)
                low_rank = math.floor(position)
                ranks[i, j, group] = (low_rank, min(low_rank + 1, n - 1), position - low_rank)
                if 3 * n < accuracy * 2:  # small group: the margin is below one rank
                    margin = 2.0 / n
                else:
                    margin = 0.0
                below = p - 3.0 / accuracy - margin
                above = p + 3.0 / accuracy + margin
                known = list(zip(grid, row[f"q{i}"]))
                low = [v for g, v in known if g <= below]
                high = [v for g, v in known if g >= above]
                brackets.setdefault((i, j), {})[group] = (
                    low[-1] if low else row[f"lo{i}"],
                    high[0] if high else row[f"hi{i}"],
                )

    pending = dict(brackets)
    # all brackets together gather at most about this many values
    gather_limit = max(1000, gather_limit // max(1, sum(len(b) for b in brackets.values())))
    while pending:
        labels = list(pending)
        aggregates = []
        for t, (i, j) in enumerate(labels):
            low = _per_group(keys, {g: pending[i, j].get(g, (None, None))[0] for g in rows})
            high = _per_group(keys, {g: pending[i, j].get(g, (None, None))[1] for g in rows})
            value = F.col(f"v{i}")
            inside = (value > low) & (value < high)
            aggregates += [
                F.count_if(value < low).alias(f"below{t}"),
                F.count_if(value == low).alias(f"low{t}"),
                F.count_if(inside).alias(f"in{t}"),
                F.count_if(value == high).alias(f"high{t}"),
            ]
            if all(_expected(rows[g][f"n{i}"], accuracy) <= gather_limit for g in pending[i, j]):
                aggregates.append(F.sort_array(F.collect_list(F.when(inside, value))).alias(f"x{t}"))
        counts = {tuple(r[k] for k in keys): r for r in source.groupBy(*keys).agg(*aggregates).collect()}

        ready: dict[tuple[int, int], dict[tuple, tuple[float, float]]] = {}
        narrower: dict[tuple[int, int], dict[tuple, tuple[float, float]]] = {}
        wide: list[tuple[int, int, tuple]] = []
        for t, (i, j) in enumerate(labels):
            for group, (low, high) in pending[i, j].items():
                row = counts[group]
                low_rank, high_rank, _ = ranks[i, j, group]
                upto = row[f"below{t}"] + row[f"low{t}"] + row[f"in{t}"] + (row[f"high{t}"] if high > low else 0)
                if low_rank < row[f"below{t}"] or high_rank >= upto:
                    full = rows[group]
                    narrower.setdefault((i, j), {})[group] = (full[f"lo{i}"], full[f"hi{i}"])
                elif row[f"in{t}"] > gather_limit:
                    wide.append((i, j, group))
                else:
                    ready.setdefault((i, j), {})[group] = (low, high)
        if ready:
            gathered = []
            names = list(ready)
            late = [x for x in names if f"x{labels.index(x)}" not in next(iter(counts.values()))]
            for i, j in late:
                t = labels.index((i, j))
                low = _per_group(keys, {g: ready[i, j].get(g, (None, None))[0] for g in rows})
                high = _per_group(keys, {g: ready[i, j].get(g, (None, None))[1] for g in rows})
                value = F.col(f"v{i}")
                gathered.append(
                    F.sort_array(F.collect_list(F.when((value > low) & (value < high), value))).alias(f"x{t}")
                )
            values = {}
            if late:
                values = {tuple(r[k] for k in keys): r for r in source.groupBy(*keys).agg(*gathered).collect()}
            for i, j in names:
                place = labels.index((i, j))
                for group, (low, high) in ready[i, j].items():
                    row = counts[group]
                    inner = (values if (i, j) in late else counts)[group][f"x{place}"]
                    start = row[f"below{place}"] + row[f"low{place}"]

                    def at(rank: int) -> float:
                        if rank < start:
                            return low
                        return inner[rank - start] if rank - start < len(inner) else high

                    low_rank, high_rank, fraction = ranks[i, j, group]
                    a, b = at(low_rank), at(high_rank)
                    answer[group][columns[i]][j] = a + (b - a) * fraction
        if wide:
            narrower = _narrow(source, keys, rows, counts, labels, pending, ranks, wide, accuracy, narrower)
        pending = narrower
        accuracy *= 2  # a bracket that missed is drawn with a finer sketch, so this ends
    return answer


def _narrow(source, keys, rows, counts, labels, pending, ranks, wide, accuracy, narrower):
    """Tighten wide brackets with a sketch over their inside only."""
    aggregates = []
    for t, (i, j, group) in enumerate(wide):
        place = labels.index((i, j))
        low, high = pending[i, j][group]
        row = counts[group]
        inside = row[f"in{place}"]
        start = row[f"below{place}"] + row[f"low{place}"]
        low_rank, high_rank, _ = ranks[i, j, group]
        value = F.col(f"v{i}")
        condition = (value > low) & (value < high)
        if keys:
            condition = condition & _matches(keys, group)
        near = [
            min(1.0, max(0.0, (low_rank - start) / inside - 3.0 / accuracy)),
            min(1.0, max(0.0, (high_rank - start + 1) / inside + 3.0 / accuracy)),
        ]
        aggregates.append(F.percentile_approx(F.when(condition, value), near, accuracy).alias(f"w{t}"))
    row = source.agg(*aggregates).first()
    for t, (i, j, group) in enumerate(wide):
        place = labels.index((i, j))
        low, high = pending[i, j][group]
        start = counts[group][f"below{place}"] + counts[group][f"low{place}"]
        low_rank, high_rank, _ = ranks[i, j, group]
        new_low = low if low_rank < start else row[f"w{t}"][0]
        new_high = high if high_rank >= start + counts[group][f"in{place}"] else row[f"w{t}"][1]
        narrower.setdefault((i, j), {})[group] = (new_low, new_high)
    return narrower


def quantile_relation(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """One row per group and column with the quantiles as columns ``q0, q1, ...``."""
    found = exact_quantiles(df, columns, probabilities, keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["variable string"]
                       + [f"q{j} double" for j in range(len(probabilities))])
    rows = [(*group, c, *values) for group, per in found.items() for c, values in per.items()]
    return df.sparkSession.createDataFrame(rows, schema)


def approximate_quantiles(columns: Sequence[str], probabilities: Sequence[float], accuracy: int = ACCURACY) -> list[Column]:
    """Sketch-only variant for callers that accept a rank error of 1 / accuracy."""
    return [F.percentile_approx(c, list(probabilities), accuracy).alias(c) for c in columns]
