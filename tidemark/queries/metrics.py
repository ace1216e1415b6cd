"""PromQL, discovery and dashboards over ``events`` as metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels as discovery
from ..model import label_cardinalities
from ..plans import promql
from .common import M, Query, metrics, plain, sql

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: 2024-01-05 and 2024-01-15, 00:00 UTC, in seconds; the step is one hour.
START, END, STEP = 1_704_412_800, 1_705_276_800, 3600
NS = 1_000_000_000
SCOPE = f"timestamp_ns BETWEEN {START * NS} AND {END * NS}"
BUCKET = f"(timestamp_ns // {STEP * NS}) * {STEP * NS}"


def add(name: str, run: Query, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Matchers: one query for each operator, through the parser.
for key, op, value, where in (
    ("match_eq", "=", "42", "user_id = '42'"),
    ("match_ne", "!=", "42", "user_id <> '42'"),
    ("match_re", "=~", "^1.*2$", "coalesce(regexp_matches(user_id, '^1.*2$'), false)"),
    ("match_nre", "!~", "1", "(user_id IS NULL OR NOT regexp_matches(user_id, '1'))"),
):
    q = promql.Query("purchase", promql.parse(f'purchase{{user_id{op}"{value}"}}').matchers)
    add(
        key,
        lambda s, d, q=q: promql.scoped(metrics(s, d), q, None, None).select("timestamp_ns", "metric_name", "user_id", "k", F.col("v").alias("value")),
        f"SELECT timestamp_ns, metric_name, user_id, k, v AS value FROM {M} WHERE metric_name = 'purchase' AND {where}",
    )

# Instant queries.
add("instant_selector", lambda s, d: promql.instant(metrics(s, d), 'purchase{k!="1"}', END), f"SELECT timestamp_ns, metric_name, k, v AS value FROM {M} WHERE metric_name = 'purchase' AND k <> '1' AND timestamp_ns <= {END * NS} ORDER BY timestamp_ns DESC, user_id, k, v LIMIT 1")
for agg, expr in {"sum": "sum(v)", "avg": "avg(v)", "count": "CAST(count(*) AS DOUBLE)", "min": "min(v)", "max": "max(v)", "stddev": "stddev_samp(v)", "stdvar": "avg(v)", "topk": "avg(v)", "bottomk": "avg(v)"}.items():
    add(
        f"instant_{agg}_by",
        lambda s, d, agg=agg: rounded(promql.instant(metrics(s, d), f"{agg} by (user_id) (view)", END), "value"),
        f"SELECT max(timestamp_ns) AS timestamp_ns, metric_name, user_id, round({expr}, 6) AS value FROM {M} WHERE metric_name = 'view' AND timestamp_ns <= {END * NS} GROUP BY metric_name, user_id",
    )
add("instant_literal_name", lambda s, d: promql.instant(metrics(s, d), "histogram_quantile(0.9, x)"), f"SELECT timestamp_ns, metric_name, v AS value FROM {M} WHERE metric_name = 'histogram_quantile(0.9, x)'")
add(
    "instant_latest_per_series",
    lambda s, d: promql.instant(metrics(s, d), "purchase", END, compat=False),
    f"SELECT timestamp_ns, metric_name, user_id, k, v AS value FROM {M} WHERE metric_name = 'purchase' AND timestamp_ns <= {END * NS} QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY timestamp_ns DESC, v DESC) = 1",
)
LATEST = f"(SELECT * FROM {M} WHERE metric_name = 'view' AND timestamp_ns <= {END * NS} QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY timestamp_ns DESC, v DESC) = 1)"
for agg, expr in {"sum": "sum(v)", "count": "CAST(count(*) AS DOUBLE)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    add(f"series_{agg}_by", lambda s, d, agg=agg: rounded(promql.instant(metrics(s, d), f"{agg} by (user_id) (view)", END, compat=False), "value"), f"SELECT user_id, round({expr}, 6) AS value FROM {LATEST} GROUP BY user_id")
for name, way in (("topk", "DESC"), ("bottomk", "ASC")):
    add(
        f"series_{name}",
        lambda s, d, name=name: promql.instant(metrics(s, d), f"{name}(5, view)", END, compat=False),
        f"SELECT metric_name, user_id, k, v AS value FROM {LATEST} ORDER BY v {way}, user_id, k LIMIT 5",
    )

# Range queries.
for key, text, expr in (
    ("range_avg", "purchase", "avg(v)"),
    ("range_sum", "sum(purchase)", "sum(v)"),
    ("range_count", "count(purchase)", "CAST(count(*) AS DOUBLE)"),
    ("range_min", "min(purchase)", "min(v)"),
    ("range_max", "max(purchase)", "max(v)"),
    ("range_stddev", "stddev(purchase)", "avg(v)"),
    ("range_rate", "rate(purchase[5m])", "(max(v) - min(v)) / 300"),
    ("range_irate", "irate(purchase[5m])", "(max(v) - min(v)) / 300"),
    ("range_increase", "increase(purchase[5m])", "max(v) - min(v)"),
    ("range_delta", "delta(purchase[5m])", "max(v) - min(v)"),
    ("range_idelta", "idelta(purchase[5m])", "avg(v)"),
    ("range_deriv", "deriv(purchase[5m])", "avg(v)"),
    ("range_sum_of_rate", "sum(rate(purchase[5m]))", "(max(v) - min(v)) / 300"),
):
    add(
        key,
        lambda s, d, text=text: rounded(promql.range_query(metrics(s, d), text, START, END, STEP), "value"),
        f"SELECT {BUCKET} AS time_bucket, metric_name, round({expr}, 6) AS value FROM {M} WHERE metric_name = 'purchase' AND {SCOPE} GROUP BY 1, 2",
    )
add(
    "range_sum_by",
    lambda s, d: rounded(promql.range_query(metrics(s, d), 'sum by (user_id) (view{k=~"^[1-4]"})', START, END, STEP), "value"),
    f"SELECT {BUCKET} AS time_bucket, metric_name, k, user_id, round(sum(v), 6) AS value FROM {M} WHERE metric_name = 'view' AND regexp_matches(k, '^[1-4]') AND {SCOPE} GROUP BY ALL",
)
DAY, SIX_HOURS = 86400 * NS, 21600 * NS
GRID = f"(SELECT {START * NS} + i * {SIX_HOURS} AS time_bucket FROM range(0, {(END - START) // 21600 + 1}) t(i))"
#: Samples by the windows that hold them, each with the sample before it in the same window.
IN_WINDOWS = f"""(SELECT *, lag(v) OVER w AS b, lag(timestamp_ns) OVER w AS bt, row_number() OVER (PARTITION BY time_bucket, user_id, k ORDER BY timestamp_ns DESC, v DESC) AS back,
  count(*) OVER (PARTITION BY time_bucket, user_id, k) AS n FROM (SELECT * FROM {M} WHERE metric_name = 'view') JOIN {GRID} ON timestamp_ns > time_bucket - {DAY} AND timestamp_ns <= time_bucket
  WINDOW w AS (PARTITION BY time_bucket, user_id, k ORDER BY timestamp_ns, v))"""
GAIN = "CASE WHEN v < b THEN v ELSE v - b END"
IN_SERIES = {
    "increase": f"sum({GAIN})",
    "rate": f"sum({GAIN}) / 86400",
    "delta": "max_by(v, (timestamp_ns, v)) - min_by(v, (timestamp_ns, v))",
    "idelta": "max(v - b) FILTER (WHERE back = 1)",
    "irate": f"max(({GAIN}) / nullif((timestamp_ns - bt) / 1e9, 0)) FILTER (WHERE back = 1)",
    "deriv": "regr_slope(v, (timestamp_ns - time_bucket) / 1e9)",
}
for fn, expr in IN_SERIES.items():
    digits = 9 if fn == "deriv" else 6
    add(
        f"series_range_{fn}",
        lambda s, d, fn=fn, digits=digits: promql.range_query(metrics(s, d), f"{fn}(view[1d])", START, END, 21600, compat=False).withColumn("value", F.round("value", digits)),
        f"SELECT time_bucket, metric_name, user_id, k, round({expr}, {digits}) AS value FROM {IN_WINDOWS} WHERE n > 1 GROUP BY ALL HAVING value IS NOT NULL",
    )
add(
    "series_instant_increase",
    lambda s, d: rounded(promql.instant(metrics(s, d), "increase(view[1d])", START, compat=False), "value"),
    f"SELECT max(timestamp_ns) AS timestamp_ns, metric_name, user_id, k, round(sum({GAIN}), 6) AS value FROM {IN_WINDOWS} WHERE n > 1 AND time_bucket = {START * NS} GROUP BY metric_name, user_id, k",
)
add(
    "series_range_selector",
    lambda s, d: promql.range_query(metrics(s, d), "view", START, END, 21600, compat=False),
    f"SELECT time_bucket, metric_name, user_id, k, max_by(v, (timestamp_ns, v)) AS value FROM (SELECT * FROM {M} WHERE metric_name = 'view') JOIN {GRID} ON timestamp_ns > time_bucket - {300 * NS} AND timestamp_ns <= time_bucket GROUP BY ALL",
)
add(
    "vector_json",
    lambda s, d: promql.vector(promql.instant(metrics(s, d), "count by (user_id) (view)", END)).select(F.to_json("metric").alias("metric"), F.col("value.time").alias("time"), F.col("value.value").cast("double").alias("value")),
    f"SELECT concat('{{\"__name__\":\"', metric_name, '\",\"user_id\":\"', user_id, '\"}}') AS metric, max(timestamp_ns) / 1e9 AS time, CAST(count(*) AS DOUBLE) AS value FROM {M} WHERE metric_name = 'view' AND timestamp_ns <= {END * NS} GROUP BY metric_name, user_id",
)
add(
    "matrix_points",
    lambda s, d: promql.matrix(promql.range_query(metrics(s, d), "count by (user_id) (view)", START, END, STEP)).select(F.element_at("metric", "user_id").alias("user_id"), F.posexplode("values").alias("place", "p")).select("user_id", F.col("place").cast("long").alias("place"), "p.time", F.col("p.value").cast("double").alias("value")),
    f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY b) - 1 AS place, b / 1e9 AS time, n AS value FROM (SELECT user_id, {BUCKET} AS b, CAST(count(*) AS DOUBLE) AS n FROM {M} WHERE metric_name = 'view' AND {SCOPE} GROUP BY 1, 2)",
)

# Discovery.
add("label_names", lambda s, d: discovery.label_names(metrics(s, d)), f"SELECT CASE column_name WHEN 'metric_name' THEN '__name__' ELSE column_name END AS label FROM (DESCRIBE SELECT * FROM {M}) WHERE column_name NOT IN ('timestamp_ns', 'v')")
add("label_names_present", lambda s, d: discovery.label_names(metrics(s, d), ['purchase{user_id="42"}'], compat=False), f"SELECT unnest(['__name__', 'k', 'user_id']) AS label WHERE EXISTS (SELECT 1 FROM {M} WHERE metric_name = 'purchase' AND user_id = '42')")
add("label_values", lambda s, d: discovery.label_values(metrics(s, d), "k"), f"SELECT DISTINCT k AS value FROM {M} WHERE k IS NOT NULL")
add("label_values_name", lambda s, d: discovery.label_values(metrics(s, d), "__name__", compat=False), f"SELECT DISTINCT metric_name AS value FROM {M}")
add("label_values_matched", lambda s, d: discovery.label_values(metrics(s, d), "user_id", ['view{k="7"}'], START, END), f"SELECT DISTINCT user_id AS value FROM {M} WHERE metric_name = 'view' AND k = '7' AND {SCOPE}")
add(
    "series",
    lambda s, d: discovery.series(metrics(s, d), ['error{k=~"^9"}']).select(F.element_at("metric", "__name__").alias("metric_name"), F.element_at("metric", "user_id").alias("user_id"), F.element_at("metric", "k").alias("k")),
    f"SELECT DISTINCT metric_name, user_id, k FROM {M} WHERE metric_name = 'error' AND regexp_matches(k, '^9')",
)
add("series_unknown_label", lambda s, d: discovery.series(metrics(s, d), ['error{nowhere!~"x",user_id="3"}']).select(F.element_at("metric", "user_id").alias("user_id"), F.element_at("metric", "k").alias("k")), f"SELECT DISTINCT user_id, k FROM {M} WHERE metric_name = 'error' AND user_id = '3'")
add(
    "series_any_match",
    lambda s, d: discovery.series(metrics(s, d), ['error{k="9"}', 'view{k="8"}'], compat=False).select(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metric")))).alias("metric")),
    f"SELECT DISTINCT concat('{{\"__name__\":\"', metric_name, '\",\"k\":\"', k, '\",\"user_id\":\"', user_id, '\"}}') AS metric FROM {M} WHERE (metric_name = 'error' AND k = '9') OR (metric_name = 'view' AND k = '8')",
)
add(
    "cardinality_class",
    lambda s, d: label_cardinalities(metrics(s, d), exact=True),
    f"SELECT label, n AS distinct_values, CASE WHEN n <= 1000 THEN 'low' WHEN n <= 100000 THEN 'medium' ELSE 'high' END AS cardinality FROM (SELECT 'user_id' AS label, count(DISTINCT user_id) AS n FROM {M} UNION ALL SELECT 'k', count(DISTINCT k) FROM {M})",
)

# Dashboards and time-series benchmarks, held to fixed times.
# fixed values: the query texts of the dashboards.
FROM = "TIMESTAMP_NTZ '2024-01-29 00:00:00'"
DASHBOARDS = {
    "recent_avg": "SELECT event_type AS metric_name, round(avg(value), 6) AS avg_value FROM {events} WHERE ts > @ GROUP BY event_type ORDER BY avg_value DESC, metric_name LIMIT 25",
    "recent_p95": "SELECT event_type AS metric_name, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95_value FROM {events} WHERE ts > @ GROUP BY event_type ORDER BY p95_value DESC, metric_name LIMIT 25",
    "error_like": "SELECT event_id, ts, event_type AS metric_name, value FROM {events} WHERE ts > @ AND event_type LIKE '%error%' ORDER BY ts DESC, event_id LIMIT 200",
    "peak_values": "SELECT event_type AS metric_name, max(value) AS max_value FROM {events} WHERE ts > @ GROUP BY event_type ORDER BY max_value DESC, metric_name LIMIT 50",
    "signal_presence": "SELECT event_type AS metric_name, count(*) AS samples FROM {events} WHERE ts > @ GROUP BY event_type ORDER BY samples DESC, metric_name LIMIT 100",
    "single_groupby": "SELECT user_id, round(avg(value), 6) AS avg_value FROM {events} WHERE ts BETWEEN TIMESTAMP_NTZ '2024-01-10 00:00:00' AND TIMESTAMP_NTZ '2024-01-10 12:00:00' AND user_id = 42 GROUP BY user_id",
    "high_cpu_all": "SELECT * FROM {events} WHERE value > 90.0 AND event_type = 'view' ORDER BY ts DESC, event_id LIMIT 10",
    "high_cpu_and_target": "SELECT event_id, ts, value FROM {events} WHERE value > 50.0 AND event_type = 'view' AND user_id BETWEEN 10 AND 20",
    "cpu_max_all": "SELECT user_id, max(value) AS max_value FROM {events} WHERE event_type = 'view' AND user_id IN (1, 2, 3, 4, 5, 6, 7, 8) GROUP BY user_id",
}
for key, text in DASHBOARDS.items():
    add(key, sql(text.replace("@", FROM)), plain(text.replace("@", FROM)).replace("TIMESTAMP_NTZ", "TIMESTAMP"))
for key, by, limit in (("minute_rollup", "minute", " ORDER BY minute DESC, metric_name LIMIT 1000"), ("double_groupby", "hour", "")):
    text = f"SELECT CAST(date_trunc('{by}', ts) AS #) AS {by}, event_type AS metric_name, round(avg(value), 6) AS avg_value FROM {{events}} WHERE ts > {FROM} GROUP BY 1, 2{limit}"
    add(key, sql(text.replace("#", "TIMESTAMP_NTZ")), plain(text.replace("#", "TIMESTAMP")).replace("TIMESTAMP_NTZ", "TIMESTAMP"))
text = "SELECT CAST(date_trunc('minute', ts) AS #) AS minute, max(value) AS max_value FROM {events} WHERE ts < TIMESTAMP_NTZ '2024-01-20 00:00:00' GROUP BY 1 ORDER BY minute DESC LIMIT 5"
add("groupby_orderby_limit", sql(text.replace("#", "TIMESTAMP_NTZ")), plain(text.replace("#", "TIMESTAMP")).replace("TIMESTAMP_NTZ", "TIMESTAMP"))


def lastpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir).withColumn("v", F.col("value_f64"))
    newest = F.max_by(F.struct("timestamp_ns", "metric_name", "v"), F.struct("timestamp_ns", "metric_name", "v"))
    return m.groupBy("user_id").agg(newest.alias("s")).select("user_id", "s.timestamp_ns", "s.metric_name", F.col("s.v").alias("value"))


add("lastpoint", lastpoint, f"SELECT user_id, timestamp_ns, metric_name, v AS value FROM {M} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp_ns DESC, metric_name DESC, v DESC) = 1")
