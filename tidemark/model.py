"""The metric data model: one wide table in which every label is a column.

``timestamp_ns`` is a BIGINT of nanoseconds since the epoch, the only time that
arithmetic uses; Spark's own timestamps hold microseconds.  A sample has one of
three value columns; a series is a metric name with its non-null labels.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: fixed values: columns that are never labels.
RESERVED = ("timestamp", "timestamp_ns", "metric_name", "value_f64", "value_i64", "value_u64", "value", "time_bucket")
#: fixed values: labels of the default schema.
DEFAULT_LABELS = ("host", "service", "env", "region", "instance", "pod", "trace_id")
#: fixed values: distinct values up to which a label is of low, and of medium cardinality.
LOW_CARDINALITY, MEDIUM_CARDINALITY = 1_000, 100_000
#: fixed values: nanoseconds in a second, and in the five minutes of a shard's time bucket.
SECOND, BUCKET = 1_000_000_000, 300_000_000_000

VALUE_TYPES = {"value_f64": T.DoubleType(), "value_i64": T.LongType(), "value_u64": T.DecimalType(20, 0)}


def metric_schema(labels: Iterable[str] = DEFAULT_LABELS, multi_value: bool = True) -> T.StructType:
    """Time and name, one column a label, and the value columns (all three, or the double alone)."""
    values = VALUE_TYPES if multi_value else {"value_f64": T.DoubleType()}
    return T.StructType(
        [T.StructField("timestamp_ns", T.LongType(), False), T.StructField("metric_name", T.StringType(), False)]
        + [T.StructField(n, T.StringType()) for n in labels]
        + [T.StructField(n, t) for n, t in values.items()]
    )


def empty_metrics(spark: SparkSession, labels: Iterable[str] = DEFAULT_LABELS) -> DataFrame:
    return spark.createDataFrame([], metric_schema(labels))


def value_column(df: DataFrame) -> Column:
    """The sample's value as a double: ``value``, else the double, signed and unsigned columns in this order."""
    names = [n for n in ("value", *VALUE_TYPES) if n in df.columns]
    return F.coalesce(*[F.col(n).cast("double") for n in names])


def label_columns(df: DataFrame) -> list[str]:
    """String columns that are not reserved, in the table's order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in RESERVED]


def series_labels(labels: Iterable[str], name: bool = True) -> Column:
    """The labels of a series as a map; a null label is no label."""
    pairs = [x for n in labels for x in (F.lit(n), F.col(f"`{n}`"))]
    if name:
        pairs = [F.lit("__name__"), F.col("metric_name"), *pairs]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.expr("map()")


def bucket_start(ns: Column, width: int) -> Column:
    """The bucket of a time by integer division, which rounds towards zero."""
    return (ns - ns % F.lit(width)).cast("long")


def floor_div(a: Column, n: int) -> Column:
    """Whole-number division rounded down; a double would lose the last digits of nanoseconds."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, 1000))


def cardinality_class(n: Column) -> Column:
    return F.when(n <= LOW_CARDINALITY, "low").when(n <= MEDIUM_CARDINALITY, "medium").otherwise("high")


def label_cardinalities(df: DataFrame, exact: bool = False) -> DataFrame:
    """label, distinct_values, class of every label; one pass, sketches unless exact."""
    count = F.count_distinct if exact else F.approx_count_distinct
    labels = label_columns(df)
    wide = df.agg(*[count(F.col(f"`{n}`")).alias(n) for n in labels])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"`{n}`").alias("distinct_values")) for n in labels])).alias("x")).select("x.*")
    return long.withColumn("cardinality", cardinality_class(F.col("distinct_values")))


def events_as_metrics(events: DataFrame) -> DataFrame:
    """The ``events`` table in the metric model; labels are the user and the property k."""
    return events.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        F.col("event_type").alias("metric_name"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("k"),
        F.col("value").alias("value_f64"),
    )
