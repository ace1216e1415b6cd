"""Discovery of label names, label values and series."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..model import RESERVED, SECOND, label_columns, series_labels
from ..plans.promql import parse


def matched(metrics: DataFrame, match: list[str], start: float | None = None, end: float | None = None, compat: bool = True) -> DataFrame:
    """Rows that the selectors and the closed time range let through; ``compat`` asks for all selectors at once.

    A label that a selector names and the table lacks is null in every row.
    """
    conditions: list[Column] = []
    for text in match:
        q = parse(text)
        conditions.append(reduce(and_, [F.col("metric_name") == q.metric, *(m.column(metrics.columns) for m in q.matchers)]))
    if conditions:
        metrics = metrics.where(reduce(and_ if compat else or_, conditions))
    if start is not None:
        metrics = metrics.where(F.col("timestamp_ns") >= int(start * SECOND))
    if end is not None:
        metrics = metrics.where(F.col("timestamp_ns") <= int(end * SECOND))
    return metrics


def label_names(metrics: DataFrame, match: list[str] = (), start: float | None = None, end: float | None = None, compat: bool = True) -> DataFrame:
    """Sorted label names with ``__name__``.

    ``compat``: from the schema, if any row is in scope; else only labels that some row in scope has.
    """
    spark, filtered = metrics.sparkSession, bool(match) or start is not None or end is not None
    rows = matched(metrics, list(match), start, end, compat)
    if compat and not filtered:
        names = sorted({"__name__", *(c for c in metrics.columns if c not in RESERVED)})
        return spark.createDataFrame([(n,) for n in names], "label string")
    labels = label_columns(metrics)
    if compat:
        some = rows.limit(1).select(F.explode(F.array(*[F.lit(n) for n in sorted({"__name__", *labels})])).alias("label"))
        return some
    wide = rows.agg(F.max(F.lit("__name__")).alias("__name__"), *[F.max(F.when(F.col(f"`{n}`").isNotNull(), F.lit(n))).alias(n) for n in labels])
    return wide.select(F.explode(F.array(*[F.col(f"`{n}`") for n in wide.columns])).alias("label")).where("label is not null").orderBy("label")


def label_values(metrics: DataFrame, label: str, match: list[str] = (), start: float | None = None, end: float | None = None, compat: bool = True) -> DataFrame:
    """Sorted distinct values of a label; ``compat`` finds none for the metric's name, which is reserved."""
    column = "metric_name" if label == "__name__" else label
    if column not in metrics.columns or (column in RESERVED and (compat or column != "metric_name")):
        return metrics.sparkSession.createDataFrame([], "value string")
    rows = matched(metrics, list(match), start, end, compat)
    return rows.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct().orderBy("value")


def series(metrics: DataFrame, match: list[str] = (), start: float | None = None, end: float | None = None, compat: bool = True) -> DataFrame:
    """Distinct series as maps of their labels; without any filter there is none."""
    if not match and start is None and end is None:
        return metrics.sparkSession.createDataFrame([], "metric map<string,string>")
    rows = matched(metrics, list(match), start, end, compat)
    labels = label_columns(metrics)
    return rows.select("metric_name", *labels).distinct().select(series_labels(labels).alias("metric"))
