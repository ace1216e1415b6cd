"""Tables by name, and queries whose one text both engines run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..model import events_as_metrics

Query = Callable[[SparkSession, str], DataFrame]
TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_metrics(table(spark, sf_dir, "events"))


def sql(text: str) -> Query:
    """A query of Spark SQL whose tables stand in braces."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in set(TABLE.findall(text))})

    return run


def plain(text: str) -> str:
    """The same text for an engine that knows the tables by name."""
    return TABLE.sub(r"\1", text)


#: The metric model for DuckDB.
M = "(SELECT epoch_us(ts) * 1000 AS timestamp_ns, event_type AS metric_name, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS k, value AS v FROM events)"
