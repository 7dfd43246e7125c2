"""Declarative feature specs: a registry of operations and a runner."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame

from panelkit.functions import scalar as S

Builder = Callable[[dict[str, Any]], Column]

_operations: dict[str, Builder] = {}


def register_operation(name: str, builder: Builder) -> None:
    """Add an operation; the builder turns a parameter dict into a Column."""
    _operations[name] = builder


register_operation(
    "ratio_scaled",
    lambda p: S.divide(S.quoted(p["numerator"]), S.quoted(p["denominator"]), p.get("scale", 1)),
)
register_operation("ratio", lambda p: S.divide(S.quoted(p["numerator"]), S.quoted(p["denominator"])))
register_operation("log1p", lambda p: S.log1p(S.quoted(p["source"])))
register_operation("sum", lambda p: S.total([S.quoted(c) for c in p["columns"]]))
register_operation("difference", lambda p: S.quoted(p["minuend"]) - S.quoted(p["subtrahend"]))
register_operation("diversity", lambda p: S.diversity([S.quoted(c) for c in p["columns"]]))


def missing_dependencies(columns: Sequence[str], spec: dict[str, Any]) -> list[str]:
    return [d for d in spec.get("dependencies", []) if d not in columns]


def derive(df: DataFrame, specs: Sequence[dict[str, Any]]) -> tuple[DataFrame, list[str]]:
    """Add every feature whose dependencies exist; returns the frame and the names that were skipped.

    Specs run in order, so a later one may use an earlier result. Specs that do not depend on each other
    share one projection.
    """
    skipped: list[str] = []
    level: dict[str, Column] = {}
    for spec in specs:
        if spec["operation"] not in _operations and not missing_dependencies([*df.columns, *level], spec):
            raise ValueError(f"unknown operation: {spec['operation']}")
        if missing_dependencies(df.columns, spec):
            if missing_dependencies([*df.columns, *level], spec):
                skipped.append(spec["name"])
                continue
            df, level = df.withColumns(level), {}
        level[spec["name"]] = _operations[spec["operation"]](spec.get("parameters", {}))
    return (df.withColumns(level) if level else df), skipped
