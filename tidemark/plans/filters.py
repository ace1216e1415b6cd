"""Filters of an optimised query, scan by scan, as predicates that chunk statistics can answer."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..operators.predicates import All, Any_, Compare, In

#: Comparisons by the class that the optimizer has for them, and the same with the sides swapped.
COMPARISONS = {"EqualTo": ("=", "="), "EqualNullSafe": ("=", "="), "LessThan": ("<", ">"), "LessThanOrEqual": ("<=", ">="), "GreaterThan": (">", "<"), "GreaterThanOrEqual": (">=", "<=")}


def kind_of(node) -> str:
    return node.getClass().getSimpleName()


def each(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def value_of(node) -> Any:
    """A literal as a number or text; None for what no statistic is compared with."""
    if kind_of(node) != "Literal" or node.value() is None:
        return None
    kind = node.dataType().simpleString()
    if kind == "string":
        return node.value().toString()
    return node.value() if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else None


def predicate_of(node) -> Any:
    """The part of a condition that statistics can answer; None if there is none.

    A conjunction keeps the sides it can; a disjunction needs both.
    """
    kind = kind_of(node)
    if kind in ("And", "Or"):
        parts = [predicate_of(node.left()), predicate_of(node.right())]
        known = tuple(p for p in parts if p is not None)
        if kind == "Or":
            return Any_(known) if len(known) == 2 else None
        return All(known) if known else None
    if kind in COMPARISONS:
        op, swapped = COMPARISONS[kind]
        for column, value, sign in ((node.left(), node.right(), op), (node.right(), node.left(), swapped)):
            if kind_of(column) == "AttributeReference" and (v := value_of(value)) is not None:
                return Compare(column.name(), sign, v)
    if kind == "In" and kind_of(node.value()) == "AttributeReference":
        values = [value_of(x) for x in each(node.list())]
        return In(node.value().name(), tuple(values)) if all(v is not None for v in values) else None
    if kind == "InSet" and kind_of(node.child()) == "AttributeReference":
        text = node.child().dataType().simpleString() == "string"
        values = [x.toString() if text else x for x in each(node.hset().toSeq())]
        return In(node.child().name(), tuple(values)) if all(isinstance(v, (int, float, str)) for v in values) else None
    return None


def scans(df: DataFrame) -> dict[str, list]:
    """By the first path of a file scan: for each time the query reads it, the predicate above it, or None."""
    found: dict[str, list] = {}

    def walk(node, condition) -> None:
        kind = kind_of(node)
        if kind == "LogicalRelation":
            relation = node.relation()
            if kind_of(relation) == "HadoopFsRelation":
                paths = each(relation.location().rootPaths().toSeq())
                if paths:
                    found.setdefault(paths[0].toString(), []).append(condition)
            return
        for sub in each(node.subqueries()):
            walk(sub, None)
        for child in each(node.children()):
            walk(child, predicate_of(node.condition()) if kind == "Filter" else None)

    walk(df._jdf.queryExecution().optimizedPlan(), None)
    return found
