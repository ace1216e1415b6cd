"""Ingest, rows, lifecycle, streams and advice over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..model import BUCKET, bucket_start, floor_div, value_column
from ..operators import advisor, lifecycle, rows
from ..operators.predicates import All, Any_, Between, Compare, In, Not
from ..plans import promql
from ..plans.sqlfront import QueryNode
from ..sources import ingest
from ..sources.catalog import Catalog
from ..streaming import tail
from .common import M, Query, metrics, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NS = 1_000_000_000
CUT = 1_705_276_800 * NS
#: The value of ``v`` routed to three columns, for DuckDB.
ROUTES = "CASE WHEN v <> floor(v) THEN v END AS value_f64, CASE WHEN v = floor(v) AND v < 0 THEN CAST(v AS BIGINT) END AS value_i64, CASE WHEN v = floor(v) AND v >= 0 THEN CAST(v AS BIGINT) END AS value_u64"


def add(name: str, oracle: str | None = None):
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return run

    return keep


def shared(spark: SparkSession) -> str:
    """A new folder that all executors see: below the checkpoint folder; one of our own only if all runs on this machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics with ``v`` instead of their value column."""
    return metrics(spark, sf_dir).withColumnRenamed("value_f64", "v")


# -- rows ---------------------------------------------------------------------


@add("dedup_ts_metric", f"SELECT timestamp_ns, metric_name, user_id, k, v FROM {M} QUALIFY row_number() OVER (PARTITION BY timestamp_ns, metric_name ORDER BY user_id, k NULLS LAST, v) = 1")
def _(s, d):
    m = long(s, d)
    return rows.dedup(rows.concat(m, m), order=["user_id", "k", "v"])


@add("dedup_series", f"SELECT timestamp_ns, metric_name, user_id, k, min(v) AS v FROM {M} GROUP BY ALL")
def _(s, d):
    m = long(s, d)
    return rows.dedup(rows.concat(m, m), labels=True, order=["v"])


@add("dedup_any", f"SELECT DISTINCT timestamp_ns, metric_name FROM {M}")
def _(s, d):
    m = long(s, d)
    return rows.dedup_any(rows.concat(m, m)).select("timestamp_ns", "metric_name")


@add("time_split_counts", f"SELECT CASE WHEN timestamp_ns < {CUT} THEN 'left' ELSE 'right' END AS side, count(*) AS n, min(timestamp_ns) AS low, max(timestamp_ns) AS high FROM {M} GROUP BY 1")
def _(s, d):
    return rows.split_at(long(s, d), CUT).groupBy("side").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high"))


@add("five_minute_buckets", f"SELECT (timestamp_ns // {BUCKET}) * {BUCKET} AS bucket, count(*) AS n FROM {M} GROUP BY 1")
def _(s, d):
    return long(s, d).groupBy(bucket_start(F.col("timestamp_ns"), BUCKET).alias("bucket")).agg(F.count("*").alias("n"))


@add("extent", f"SELECT min(timestamp_ns) AS low, max(timestamp_ns) AS high, count(*) AS rows FROM {M}")
def _(s, d):
    return rows.extent(long(s, d))


@add("metric_names", f"SELECT DISTINCT metric_name FROM {M}")
def _(s, d):
    return rows.metric_names(long(s, d))


@add("time_sorted_shards", f"SELECT metric_name, (timestamp_ns // {BUCKET}) * {BUCKET} AS bucket, count(*) AS n, 1 AS shard_keys, 0::BIGINT AS out_of_order FROM {M} GROUP BY 1, 2")
def _(s, d):
    placed = rows.by_shard(long(s, d), 8).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    key = F.struct("shard_key", "timestamp_ns")
    late = F.coalesce(F.lag(key).over(Window.partitionBy("part").orderBy("place")) > key, F.lit(False))
    out = placed.withColumn("late", late).groupBy("metric_name", F.col("shard_key.bucket").alias("bucket"))
    return out.agg(F.count("*").alias("n"), F.count_distinct("shard_key").cast("int").alias("shard_keys"), F.count_if("late").alias("out_of_order"))


@add("live_comparisons", f"SELECT count(*) FILTER (WHERE v > 50) AS gt, count(*) FILTER (WHERE v <= 50) AS le, count(*) FILTER (WHERE user_id = '7') AS eq, count(*) FILTER (WHERE user_id <> '7') AS ne, count(*) AS unfit, count(*) AS unknown FROM {M}")
def _(s, d):
    m = long(s, d)
    count = lambda *x: F.count(F.when(rows.compat_filter(*x, m.schema), 1))
    return m.agg(count("v", ">", 50.0).alias("gt"), count("v", "<=", 50.0).alias("le"), count("user_id", "=", "7").alias("eq"), count("user_id", "!=", "7").alias("ne"), count("user_id", "<", 7).alias("unfit"), count("nowhere", "=", "x").alias("unknown"))


@add("predicate_filter", f"SELECT timestamp_ns, metric_name, user_id, v FROM {M} WHERE (metric_name IN ('view', 'error') AND v BETWEEN 20 AND 60 AND NOT user_id = '3') OR v > 150")
def _(s, d):
    p = Any_((All((In("metric_name", ("view", "error")), Between("v", 20.0, 60.0), Not(Compare("user_id", "=", "3")))), Compare("v", ">", 150.0)))
    return long(s, d).where(p.rows()).select("timestamp_ns", "metric_name", "user_id", "v")


# -- ingest -------------------------------------------------------------------


@add("value_routing", f"SELECT timestamp_ns, metric_name, {ROUTES} FROM (SELECT timestamp_ns, metric_name, CASE WHEN CAST(user_id AS BIGINT) % 3 = 0 THEN floor(v) WHEN CAST(user_id AS BIGINT) % 3 = 1 THEN -floor(v) - 1 ELSE v END AS v FROM {M})")
def _(s, d):
    m, v = long(s, d), F.col("v")
    k = F.col("user_id").cast("bigint") % 3
    v = F.when(k == 0, F.floor(v).cast("double")).when(k == 1, -F.floor(v).cast("double") - 1).otherwise(v)
    f64, i64, u64 = ingest.routed(v)
    return m.select("timestamp_ns", "metric_name", f64, i64, u64).withColumn("value_u64", F.col("value_u64").cast("bigint"))


@add("remote_write_rows", f"SELECT (timestamp_ns // 1000000) * 1000000 AS timestamp_ns, metric_name, user_id, k, v AS value FROM {M}")
def _(s, d):
    m = long(s, d)
    labels = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in (("__name__", "metric_name"), ("user_id", "user_id"), ("k", "k"))])
    sample = F.struct(floor_div(F.col("timestamp_ns"), 1_000_000).alias("timestamp_ms"), F.col("v").alias("value"))
    series = m.groupBy("metric_name", "user_id", "k").agg(F.collect_list(sample).alias("samples")).select(F.array(F.struct(labels.alias("labels"), "samples")).alias("series"))
    wide = ingest.widened(ingest.series_rows(series), ["user_id", "k"])
    return wide.select("timestamp_ns", "metric_name", "user_id", "k", value_column(wide).alias("value"))


@add("promoted_label", f"SELECT timestamp_ns, metric_name, user_id, 1 AS labels_left FROM {M}")
def _(s, d):
    m = long(s, d).select("timestamp_ns", "metric_name", F.create_map(F.lit("user_id"), "user_id", F.lit("k"), F.coalesce("k", F.lit(""))).alias("labels"))
    return ingest.promoted(m, "user_id").select("timestamp_ns", "metric_name", "user_id", F.size("labels").alias("labels_left"))


@add("schema_conform", f"SELECT timestamp_ns, metric_name, v AS value_f64, CAST(NULL AS BIGINT) AS value_i64, CAST(NULL AS VARCHAR) AS host FROM {M}")
def _(s, d):
    return ingest.conform(metrics(s, d)).select("timestamp_ns", "metric_name", "value_f64", "value_i64", "host")


@add("empty_table", "SELECT 0::BIGINT AS n, CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high")
def _(s, d):
    from ..model import empty_metrics

    return empty_metrics(s).agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high"))


@add("generated_workload", "SELECT 1700000000000000000 + i * 1000000000 AS timestamp_ns, 'host-' || h AS host, CASE WHEN h % 2 = 0 THEN 'east' ELSE 'west' END AS region, round(52.5 + 42.5 * sin(i * (2 * 3.141592653589793 / 300)), 6) AS value FROM range(1000) a(i), range(3) b(h)")
def _(s, d):
    return ingest.generated(s, 1000).where("metric_name = 'cpu_usage'").select("timestamp_ns", "host", "region", F.round("value_f64", 6).alias("value"))


@add("generated_shapes", "SELECT unnest(['cpu_usage', 'memory_bytes', 'requests_total', 'gc_pause']) AS metric_name, 3000 AS samples, 3 AS hosts, true AS falls_only_where_it_may, true AS in_range")
def _(s, d):
    m = ingest.generated(s, 1000)
    step = F.col("value_f64") - F.lag("value_f64").over(Window.partitionBy("metric_name", "host").orderBy("timestamp_ns"))
    name, v = F.col("metric_name"), F.col("value_f64")
    fits = F.when(name == "gc_pause", v.between(5, 6)).when(name == "requests_total", v >= 0).when(name == "memory_bytes", F.coalesce(F.abs(F.col("step")) <= 5e6, F.lit(True))).otherwise(v.between(10, 95))
    return m.withColumn("step", step).groupBy("metric_name").agg(F.count("*").cast("int").alias("samples"), F.count_distinct("host").cast("int").alias("hosts"), F.every((name != "requests_total") | F.coalesce(F.col("step") >= 0, F.lit(True))).alias("falls_only_where_it_may"), F.every(fits).alias("in_range"))


# -- chunks -------------------------------------------------------------------


def chunked(spark: SparkSession, sf_dir: str, files: int = 12) -> Catalog:
    catalog = Catalog(spark, shared(spark))
    catalog.append(metrics(spark, sf_dir), stats=("metric_name", "value_f64"), files=files)
    return catalog


WINDOW = f"timestamp_ns BETWEEN {CUT} AND {CUT + 86400 * NS}"


@add("chunk_overlap_prune", f"SELECT timestamp_ns, metric_name, user_id, k, v AS value_f64 FROM {M} WHERE {WINDOW} AND metric_name = 'view' AND v > 50")
def _(s, d):
    p = All((Between("timestamp_ns", CUT, CUT + 86400 * NS), Compare("metric_name", "=", "view"), Compare("value_f64", ">", 50.0)))
    return chunked(s, d).read(p)


#: The day of a row, in nanoseconds.
DAY = f"(timestamp_ns // {86400 * NS})"


def by_day(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog with one chunk for each day."""
    catalog = Catalog(spark, shared(spark))
    m = metrics(spark, sf_dir)
    catalog.append(m.repartitionByRange(128, floor_div(F.col("timestamp_ns"), 86400 * NS)), stats=("metric_name", "value_f64", "user_id"))
    return catalog


@add("chunk_catalog", f"SELECT min(timestamp_ns) AS low, max(timestamp_ns) AS high, count(*) AS rows, min(metric_name) AS least, max(metric_name) AS greatest, min(v) AS least_value, max(v) AS greatest_value, 0 AS level, 0 AS timeless FROM {M} GROUP BY {DAY}")
def _(s, d):
    chunks = by_day(s, d).snapshot().chunks
    rows_ = [(c.low, c.high, c.rows, *c.stats["metric_name"][:2], *c.stats["value_f64"][:2], c.level, c.timeless) for c in chunks]
    return s.createDataFrame(rows_, "low long, high long, rows long, least string, greatest string, least_value double, greatest_value double, level int, timeless int")


@add("chunks_rebuilt", f"SELECT 's 1/x' AS shard, 2 AS level, min(timestamp_ns) AS low, count(*) AS rows FROM {M} GROUP BY {DAY}")
def _(s, d):
    catalog, m = Catalog(s, shared(s)), metrics(s, d)
    catalog.write(m.repartitionByRange(128, floor_div(F.col("timestamp_ns"), 86400 * NS)), level=2, shard="s 1/x")
    catalog.rebuild()
    return catalog.as_frame().select("shard", "level", "low", "rows")


PRUNED = f"metric_name = 'view' AND timestamp_ns >= {CUT} AND timestamp_ns < {CUT + 5 * 86400 * NS} AND v > 20"
#: Rows that match, chunks that a query has read and chunks there are.
READ = f"SELECT * FROM (SELECT count(*) AS n, round(sum(v), 4) AS total FROM {M} WHERE {PRUNED}), (SELECT count(DISTINCT {DAY}) AS chunks, count(DISTINCT CASE WHEN timestamp_ns >= {CUT} AND timestamp_ns < {CUT + 5 * 86400 * NS} THEN {DAY} END) AS chunks_read FROM {M})"


@add("sql_pruned_chunks", READ)
def _(s, d):
    node = QueryNode(s, {"metrics": by_day(s, d)})
    out = node.query(f"SELECT count(*) AS n, round(sum(v), 4) AS total FROM (SELECT *, value_f64 AS v FROM metrics) WHERE {PRUNED}")
    read, there = node.chunks["metrics"]
    return out.withColumns({"chunks": F.lit(there).cast("long"), "chunks_read": F.lit(read).cast("long")})


@add("promql_pruned_chunks", f"SELECT *, (SELECT count(DISTINCT {DAY}) FROM {M} WHERE timestamp_ns BETWEEN {CUT} AND {CUT + 5 * 86400 * NS}) AS chunks_read FROM (SELECT (timestamp_ns // {3600 * NS}) * {3600 * NS} AS time_bucket, metric_name, round(sum(v), 6) AS value FROM {M} WHERE metric_name = 'view' AND timestamp_ns BETWEEN {CUT} AND {CUT + 5 * 86400 * NS} GROUP BY 1, 2)")
def _(s, d):
    catalog, lo, hi = by_day(s, d), CUT // NS, CUT // NS + 5 * 86400
    q = promql.parse("sum(view)")
    read = len(catalog.snapshot().prune(promql.predicate(q), lo * NS, hi * NS))
    return promql.range_query(catalog, q, lo, hi, 3600).withColumn("value", F.round("value", 6)).withColumn("chunks_read", F.lit(read).cast("long"))


def placed(catalog: Catalog) -> DataFrame:
    """All rows of a catalog with the shard and level of their chunks."""
    now = catalog.snapshot()
    parts = [catalog.rows_of(g, now).withColumns({"shard": F.lit(shard), "level": F.lit(level)}) for (shard, level), g in lifecycle.grouped(now.chunks, lambda c: (c.shard, c.level))]
    return rows.concat(*parts)


def sharded(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog of two shards, by user; the rows of every fifth user have no time."""
    catalog, m, u = Catalog(spark, shared(spark)), metrics(spark, sf_dir), F.col("user_id").cast("bigint")
    m = m.withColumn("timestamp_ns", F.when(u % 5 != 0, F.col("timestamp_ns")))
    for shard in ("even", "odd"):
        catalog.append(m.where(u % 2 == int(shard == "odd")), shard=shard, files=4)
    return catalog


TIMED = "CASE WHEN CAST(user_id AS BIGINT) % 5 <> 0 THEN timestamp_ns END"
PARITY = "CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END"
SHARDED = f"(SELECT {TIMED} AS timestamp_ns, metric_name, user_id, k, v AS value_f64, {PARITY} AS shard FROM {M})"


@add("compacted", f"SELECT *, CASE WHEN shard = 'even' THEN 1 ELSE 0 END AS level FROM {SHARDED}")
def _(s, d):
    catalog = sharded(s, d)
    lifecycle.compact(catalog, [c for c in catalog.snapshot().chunks if c.shard == "even"], files=2)
    return placed(catalog)


@add("compacted_by_level", f"SELECT {PARITY} AS shard, 2 AS level, count(*) AS rows FROM {M} GROUP BY 1")
def _(s, d):
    catalog, m, u = Catalog(s, shared(s)), metrics(s, d), F.col("user_id").cast("bigint")
    for k in range(3):  # each round's chunks become one of level 1, and these one of level 2
        for shard in ("even", "odd"):
            catalog.append(m.where((u % 2 == int(shard == "odd")) & (F.pmod(F.xxhash64("timestamp_ns"), F.lit(3)) == k)).withColumn("timestamp_ns", F.col("timestamp_ns") % (3600 * NS)), shard=shard, files=3)
        for g in lifecycle.fresh_groups(catalog.snapshot().chunks, 2):
            lifecycle.compact(catalog, g)
    lifecycle.compact_all(catalog, target=1 << 40)
    return catalog.as_frame().groupBy("shard", "level").agg(F.sum("rows").alias("rows"))


@add("retention_filter", f"SELECT *, 0 AS level FROM {SHARDED} WHERE timestamp_ns >= {CUT} OR timestamp_ns IS NULL")
def _(s, d):
    catalog = sharded(s, d)
    lifecycle.retain(catalog, CUT)
    return placed(catalog)


@add("shard_split", f"SELECT * REPLACE (CASE WHEN shard = 'odd' THEN shard WHEN timestamp_ns >= {CUT} THEN 'late' ELSE 'early' END AS shard), 0 AS level FROM {SHARDED}")
def _(s, d):
    catalog = sharded(s, d)
    lifecycle.split_shard(catalog, "even", "early", "late", CUT)
    return placed(catalog)


@add("partitioned_by_hour", f"SELECT timestamp_ns, metric_name, user_id, v AS value_f64, 'default' AS tenant, 15 AS day, CAST((timestamp_ns // {3600 * NS}) % 24 AS INT) AS hour FROM {M} WHERE timestamp_ns // {86400 * NS} = {CUT // (86400 * NS)}")
def _(s, d):
    path = shared(s)
    lifecycle.partitioned_write(metrics(s, d), path)
    return s.read.parquet(path).where("tenant = 'default' AND year = 2024 AND month = 1 AND day = 15").select("timestamp_ns", "metric_name", "user_id", "value_f64", "tenant", "day", "hour")


@add("downsample_1m", f"SELECT (timestamp_ns // {60 * NS}) * {60 * NS} AS bucket, metric_name, user_id, k, round(avg(v), 6) AS avg_value, min(v) AS min_value, max(v) AS max_value, max_by(v, (timestamp_ns, v)) AS last_value, count(v) AS samples FROM {M} GROUP BY ALL")
def _(s, d):
    return lifecycle.downsampled(metrics(s, d)).withColumn("avg_value", F.round("avg_value", 6))


# -- streams ------------------------------------------------------------------


def streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The metrics written as files and read back as a stream, and a folder for checkpoints."""
    folder = shared(spark)
    m = metrics(spark, sf_dir)
    m.repartition(3).write.parquet(f"{folder}/in")
    return tail.stream(spark, f"{folder}/in", m.schema), folder


def drained(out: DataFrame, folder: str, mode: str) -> DataFrame:
    """A stream run to its end into Parquet, and what it wrote."""
    return tail.drain(out, f"{folder}/out", mode).drop("batch")


@add("stream_filtered_tail", f"SELECT timestamp_ns, metric_name, user_id, v AS value_f64 FROM {M} WHERE metric_name IN ('view', 'error') AND v > 50 AND timestamp_ns >= {CUT}")
def _(s, d):
    source, folder = streamed(s, d)
    out = tail.live(source, F.col("value_f64") > 50, tail.Topic() & tail.Topic("metrics", ("view", "error")), CUT)
    return drained(out.select("timestamp_ns", "metric_name", "user_id", "value_f64"), folder, "append")


@add("stream_tumbling", f"SELECT (timestamp_ns // {3600 * NS}) * {3600 * NS} AS start_ns, metric_name, round(sum(v), 4) AS sum_value, round(avg(v), 6) AS avg_value, count(v) AS samples FROM {M} GROUP BY 1, 2")
def _(s, d):
    source, folder = streamed(s, d)
    out = drained(tail.windowed(source, "1 hour", late="60 days"), folder, "complete")
    return out.select((F.unix_micros("window_start") * 1000).alias("start_ns"), "metric_name", F.round("sum_value", 4).alias("sum_value"), F.round("avg_value", 6).alias("avg_value"), "samples")


@add("stream_sliding", f"SELECT w * {1800 * NS} AS start_ns, metric_name, count(v) AS samples FROM (SELECT *, unnest([timestamp_ns // {1800 * NS} - 1, timestamp_ns // {1800 * NS}]) AS w FROM {M}) GROUP BY 1, 2")
def _(s, d):
    source, folder = streamed(s, d)
    out = drained(tail.windowed(source, "1 hour", "30 minutes", late="60 days"), folder, "complete")
    return out.select((F.unix_micros("window_start") * 1000).alias("start_ns"), "metric_name", "samples")


@add("stream_buckets", f"SELECT (timestamp_ns // {3600 * NS}) * {3600 * NS} AS time_bucket, metric_name, round(avg(v), 6) AS value, count(*) AS samples FROM {M} GROUP BY 1, 2")
def _(s, d):
    source, folder = streamed(s, d)
    return drained(tail.buckets(source, 3600 * NS), folder, "complete").withColumn("value", F.round("value", 6))


@add("stream_to_chunks", f"SELECT timestamp_ns, metric_name, user_id, k, v AS value_f64 FROM {M}")
def _(s, d):
    source, folder = streamed(s, d)
    catalog = Catalog(s, f"{folder}/chunks")
    tail.to_chunks(source, catalog, f"{folder}/state", once=True).awaitTermination()
    return catalog.read()


@add("stream_replayed_batch", f"SELECT timestamp_ns, metric_name, user_id, k, v AS value_f64 FROM {M}")
def _(s, d):
    catalog, m = Catalog(s, shared(s)), metrics(s, d)
    for batch, part in ((0, "timestamp_ns % 2 = 0"), (0, "timestamp_ns % 2 = 0"), (1, "timestamp_ns % 2 <> 0"), (0, "true")):  # as after a crash before the checkpoint
        catalog.append(m.where(part), writer=("stream", batch))
    return catalog.read()


@add("stream_past_and_live", f"SELECT timestamp_ns, metric_name, user_id, v AS value_f64 FROM {M} WHERE metric_name = 'view' AND v > 30")
def _(s, d):
    folder, m = shared(s), metrics(s, d)
    catalog = Catalog(s, f"{folder}/chunks")

    def keep(kind, found, batch):
        if kind == "data":
            found.select("timestamp_ns", "metric_name", "user_id", "value_f64").write.mode("overwrite").parquet(f"{folder}/sent/{batch + 1}")

    def follow():
        tail.subscribe(catalog, keep, f"{folder}/state", "value_f64 > 30", tail.Topic("metrics", ("view",)), interval=None, count=False).wait()

    third = lambda k: m.where(F.pmod(F.xxhash64("timestamp_ns", "user_id"), F.lit(3)) == k)
    catalog.append(third(0), files=2)
    follow()
    catalog.append(third(1), files=2)
    lifecycle.compact(catalog, list(catalog.snapshot().chunks))  # sends nothing again
    follow()
    catalog.append(third(2), files=2)
    follow()
    return s.read.parquet(f"{folder}/sent/*")


# -- advice -------------------------------------------------------------------


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of filters: who filtered by which column, how selectively, with what gain."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("t").alias("tenant"), F.col("event_type").alias("column"), F.lit("filter").alias("kind"), (F.pmod("event_id", F.lit(100)) / 100).alias("selectivity"), F.col("value").alias("time_saved"), F.col("ts").cast("timestamp").alias("at"))


LOG = "(SELECT event_type AS c, (event_id % 100) / 100 AS s, value, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOURS)"
USAGE = f"(SELECT c, count(*) AS n, median(s) FILTER (WHERE rn <= 500) AS p50, quantile_cont(s, 0.99) FILTER (WHERE rn <= 500) AS p99, avg(value) AS saved FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ts DESC, s) AS rn FROM {LOG}) GROUP BY c)"


@add("usage_stats", f"SELECT c AS \"column\", n AS filter_count, round(p50, 6) AS selectivity_p50, round(p99, 6) AS selectivity_p99, round(saved, 6) AS query_time_saved FROM {USAGE}")
def _(s, d):
    u = advisor.usage(query_log(s, d))
    return u.select("column", "filter_count", *[F.round(c, 6).alias(c) for c in ("selectivity_p50", "selectivity_p99", "query_time_saved")])


def advised_cardinality():
    """A cardinality for each kind of event: of every index type, and on both sides of the limits between them."""
    c = F.col("column")
    return F.when(c == "view", 1000).when(c == "error", 1001).when(c == "purchase", 100_000).when(c == "signup", 100_001).otherwise(20)


CARD = "CASE c WHEN 'view' THEN 1000 WHEN 'error' THEN 1001 WHEN 'purchase' THEN 100000 WHEN 'signup' THEN 100001 ELSE 20 END"
SCORE = f"n * (1 - p50) * saved * 1e6 / (({CARD}) * 10 + 100 * 0.01)"


@add("index_score", f"SELECT c AS \"column\", round({SCORE}, 6) AS score, CASE WHEN {CARD} <= 1000 THEN 'inverted' WHEN {CARD} <= 100000 THEN 'range' ELSE 'bloom' END AS index_type, row_number() OVER (ORDER BY {SCORE} DESC, c) AS place FROM {USAGE} WHERE n >= 100 AND {SCORE} > 1 QUALIFY place <= 5")
def _(s, d):
    u = advisor.usage(query_log(s, d)).withColumns({"cardinality": advised_cardinality(), "write_rate": F.lit(100.0), "query_time_saved": F.col("query_time_saved") * 1e6})
    return advisor.recommend(u).select("column", F.round("score", 6).alias("score"), "index_type", "place")


@add("rolling_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 6) AS rolling_avg FROM events")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.col("event_type").alias("shard"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second"), "value")
    return advisor.rolling(e, "value", 3600).select("event_id", F.round("rolling_avg", 6).alias("rolling_avg"))


@add(
    "hot_shards",
    """WITH load AS (SELECT event_type AS shard, CAST(floor(epoch(ts)) AS BIGINT) AS second, max(value) AS v FROM events GROUP BY 1, 2),
flagged AS (SELECT *, sum(CASE WHEN v > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY shard ORDER BY second) AS br FROM load)
SELECT shard, min(since) AS hot_since FROM (SELECT shard, br, min(second) AS since, max(second) AS until FROM flagged WHERE v > 20 GROUP BY 1, 2) WHERE until - since >= 60 GROUP BY shard""",
)
def _(s, d):
    e = table(s, d, "events").groupBy(F.col("event_type").alias("shard"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("second")).agg(F.max("value").alias("latency_ms"))
    return advisor.hot_shards(e, {"latency_ms": 20.0})


@add("node_balance", "SELECT c_mktsegment AS node, CAST(count(*) AS BIGINT) AS load, CASE WHEN count(*) / avg(count(*)) OVER () - 1 > 0.2 THEN 'give' WHEN count(*) / avg(count(*)) OVER () - 1 < -0.2 THEN 'take' ELSE 'stay' END AS move FROM customer GROUP BY 1")
def _(s, d):
    return advisor.imbalance(table(s, d, "customer").select(F.col("c_mktsegment").alias("node"), F.lit(1).alias("load"))).select("node", "load", "move")
