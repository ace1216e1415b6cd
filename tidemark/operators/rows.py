"""Row-level operators: deduplication, time splits, buckets, as-of and range joins, series distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructType

from ..model import BUCKET, bucket_start, label_columns


def dedup(metrics: DataFrame, labels: bool = False, order: list[str] = ()) -> DataFrame:
    """One row for each (time, metric): the first by ``order``, else by all columns.

    Rows without a time all stay; a null metric equals the empty one; a table
    without either column passes as it is.  With ``labels`` the key is the whole series.
    """
    if not {"timestamp_ns", "metric_name"} <= set(metrics.columns):
        return metrics
    key = [F.col("timestamp_ns"), F.coalesce("metric_name", F.lit("")), *[F.col(f"`{x}`") for x in (label_columns(metrics) if labels else [])]]
    by = [F.col(f"`{c}`").asc_nulls_last() for c in (order or [c for c, t in metrics.dtypes if not t.startswith("map")])]
    timed = metrics.where("timestamp_ns is not null").withColumn("first", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("first = 1").drop("first")
    return timed.unionByName(metrics.where("timestamp_ns is null"))


def dedup_any(metrics: DataFrame) -> DataFrame:
    """As ``dedup`` where any row of a key will do: a hash aggregation with map-side combine, no sort."""
    timed = metrics.where("timestamp_ns is not null").withColumn("name_", F.coalesce("metric_name", F.lit(""))).dropDuplicates(["timestamp_ns", "name_"]).drop("name_")
    return timed.unionByName(metrics.where("timestamp_ns is null"))


def split_at(rows: DataFrame, at: int, column: str = "timestamp_ns") -> DataFrame:
    """Rows with ``side``: ``left`` before the time, ``right`` from it on; rows without a time are in neither."""
    return rows.withColumn("side", F.when(F.col(column) < at, "left").when(F.col(column) >= at, "right"))


def split_point(low: int, high: int) -> int:
    """The middle of a time range, down to five minutes."""
    middle = low + (high - low) // 2
    return middle - middle % BUCKET


def extent(rows: DataFrame) -> DataFrame:
    """low, high, rows of a table's times."""
    return rows.agg(F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high"), F.count("*").alias("rows"))


def metric_names(rows: DataFrame) -> DataFrame:
    return rows.select("metric_name").where("metric_name is not null").distinct()


def shard_key(tenant: Column | int = 0) -> Column:
    """Tenant, metric hash and five-minute bucket of a row: sorts by tenant, then metric, then time."""
    tenant = F.lit(tenant) if isinstance(tenant, int) else tenant
    return F.struct(tenant.cast("int").alias("tenant"), F.pmod(F.xxhash64("metric_name"), F.lit(1 << 16)).cast("int").alias("metric_hash"), bucket_start(F.col("timestamp_ns"), BUCKET).alias("bucket"))


def by_shard(rows: DataFrame, shards: int, tenant: int = 0) -> DataFrame:
    """Rows range-partitioned by shard key, in time order inside a partition."""
    return rows.withColumn("shard_key", shard_key(tenant)).repartitionByRange(shards, "shard_key", "timestamp_ns").sortWithinPartitions("shard_key", "timestamp_ns")


def concat(*tables: DataFrame) -> DataFrame:
    """All rows of tables whose columns may differ."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], bucket: int | None = None) -> DataFrame:
    """Each left row with the ``values`` of the newest right row of its key at or before it.

    One union and one window over the key: a single shuffle, no pairs.  With
    ``bucket`` (a width of ``on``) a hot key is cut into buckets: inside a
    bucket the window fills forward, and what a bucket's rows cannot see comes
    from the last right row of earlier buckets, one row for each key and bucket.
    """
    tag = [F.lit(1).alias("is_left"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"r_{v}") for v in values], F.lit(None).cast("boolean").alias("r_hit")]
    l = left.select("*", *tag)  # noqa: E741
    r = right.select(*[F.col(c) for c in [*by, on]], F.lit(0).alias("is_left"), *[F.col(v).alias(f"r_{v}") for v in values], F.lit(True).alias("r_hit"))
    rows = l.unionByName(r, allowMissingColumns=True).withColumn("r_row", F.when(F.col("r_hit"), F.struct(*[F.col(f"r_{v}") for v in values])))
    parts = list(by)
    if bucket:
        rows = rows.withColumn("bucket_", F.floor(F.col(on) / F.lit(bucket)))
        parts.append("bucket_")
    w = Window.partitionBy(*parts).orderBy(on, "is_left").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seen", F.last("r_row", ignorenulls=True).over(w))
    if bucket:
        ends = rows.groupBy(*parts).agg(F.max_by("r_row", F.when(F.col("r_hit"), F.struct(on))).alias("end"))
        earlier = Window.partitionBy(*by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*parts, F.last("end", ignorenulls=True).over(earlier).alias("carried"))
        rows = rows.join(ends, parts).withColumn("seen", F.coalesce("seen", "carried"))
    return rows.where("is_left = 1").select(*left.columns, *[F.col("seen")[f"r_{v}"].alias(v) for v in values])


#: Rows of a key that the joins below take from each side at a time; spans that ``range_join`` packs, and its slices of a width at most.
TILE, PACK, SLICES = 1024, 128, 16


def tiles(df: DataFrame, keys: list[str], name: str, tile: int) -> DataFrame:
    """Number of tiles of the keys that need more than one: fewer than one row for ``tile`` rows, to be broadcast."""
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).alias(name))
    return F.broadcast(counts.where(f"{keys[0]} IS NOT NULL AND {name} > 1"))


def own_tile(df: DataFrame, name: str) -> Column:
    return F.pmod(F.xxhash64(*df.columns), F.coalesce(name, F.lit(1)))


def all_tiles(name: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(name, F.lit(1)) - 1))


def places(df: DataFrame) -> int:
    """Partitions of pairs, set by number: Spark would judge them by the bytes read, which say nothing of the pairs."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the spans that hold them (closed), by equal buckets of ``width`` instead of a nested loop.

    A span goes to every bucket it touches; pick a width near the usual span.
    For an inner join, the spans of a bucket are packed, in a crowded bucket
    those that end near one another, and a pack passes by the points of its
    bucket, of which crowded buckets have several tiles, each in a place of its
    own.  So nearly all spans of such a pack hold a point or none does, only
    packs whose extent holds the point are opened, and the pairs come as the
    same short list of spans again and again, which a written result stores in
    a fraction of a byte a row.  Rows equal in all columns stay in one pack or
    tile.
    """
    p = points.withColumn("bucket_", F.floor(F.col(point) / F.lit(width)))
    s = spans.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(low) / F.lit(width)), F.floor(F.col(high) / F.lit(width)))))
    inside = F.col(point).between(F.col(low), F.col(high))
    if how != "inner":
        return p.join(s, (p["bucket_"] == s["bucket_"]) & inside, how).drop("bucket_")
    n, crowds = places(points), tiles(p, ["bucket_"], "i_n", TILE)
    s = s.join(tiles(s, ["bucket_"], "s_n", PACK), "bucket_", "left").withColumn("slice_", F.when(F.col("s_n").isNotNull(), F.floor(F.col(high) / F.lit(width) * F.least("s_n", F.lit(SLICES)))))
    s = s.withColumn("slice_", F.coalesce("slice_", F.lit(0).cast("long"))).drop("s_n")
    s = s.join(tiles(s, ["bucket_", "slice_"], "k_n", PACK), ["bucket_", "slice_"], "left").withColumn("k_", own_tile(spans, "k_n"))
    packs = s.groupBy("bucket_", "slice_", "k_").agg(F.collect_list(F.struct(*spans.columns)).alias("pack_"), F.min(low).alias("from_"), F.max(high).alias("to_"))
    packs = packs.join(crowds, "bucket_", "left").select("bucket_", all_tiles("i_n").alias("i_"), "pack_", "from_", "to_").repartition(n, "bucket_", "i_")
    p = p.join(crowds, "bucket_", "left").withColumn("i_", own_tile(points, "i_n")).drop("i_n").repartition(n, "bucket_", "i_")
    met = packs.hint("merge").join(p, ["bucket_", "i_"]).where(F.col(point).between(F.col("from_"), F.col("to_")))
    return met.select(*points.columns, F.explode("pack_").alias("span_")).select(*points.columns, "span_.*").where(inside)


def full_join(left: DataFrame, right: DataFrame, on: tuple[str, str], tile: int = TILE) -> DataFrame:
    """Full outer equi-join on one column of each side (of one type); no column name may be on both sides.

    Spark's full outer join makes all pairs of a key before it hands one on, in
    one task for each key.  Here the rows of a frequent key are parted into
    tiles by a hash of the row; each two tiles of a key meet in a place of
    their own, as an inner merge join that hands pairs on as they come, and
    rows whose key the other side lacks (null keys too) are added.  Tiles are
    numbered from exact counts.  Rows equal in all columns stay in one tile.
    """
    a, b = on
    counts = [tiles(df.withColumn("key_", F.col(k)), ["key_"], name, tile) for df, k, name in ((left, a, "i_n"), (right, b, "j_n"))]

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).withColumn("key_", F.col(key)).join(counts[0], "key_", "left").join(counts[1], "key_", "left")
        rows = rows.withColumn(f"{own}_", own_tile(df, f"{own}_n")).withColumn(f"{other}_", all_tiles(f"{other}_n"))
        return rows.drop("i_n", "j_n").repartition(places(left), "key_", "i_", "j_")

    pairs = dealt(left, a, "i", "j").join(dealt(right, b, "j", "i").hint("merge"), ["key_", "i_", "j_"]).select(*left.columns, *right.columns)
    alone = left.join(right.select(b).distinct(), F.col(a) == F.col(b), "left_anti"), right.join(left.select(a).distinct(), F.col(a) == F.col(b), "left_anti")
    return concat(pairs, *alone)


def salted_join(hot: DataFrame, other: DataFrame, on: list[str], salts: int) -> DataFrame:
    """Inner join in which each key of ``other`` meets the key's rows of ``hot`` in ``salts`` places."""
    a = hot.withColumn("salt_", F.pmod(F.xxhash64(*[c for c in hot.columns]), F.lit(salts)).cast("int"))
    b = other.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "salt_"]).drop("salt_")


def compat_filter(column: str, op: str, value, schema: StructType) -> Column:
    """A live filter's comparison: null is false, floats equal within an epsilon.

    A column that the rows lack, or whose type the value does not fit, lets every row pass.
    """
    kind = schema[column].dataType if column in schema.names else None
    fits = isinstance(kind, StringType) if isinstance(value, str) else isinstance(kind, BooleanType) if isinstance(value, bool) else isinstance(kind, NumericType)
    if not fits:
        return F.lit(True)
    c, v = F.col(f"`{column}`"), F.lit(value)
    if isinstance(value, float) and op in ("=", "!="):
        near = F.abs(c - v) < F.lit(2.220446049250313e-16)
        return F.coalesce(near if op == "=" else ~near, F.lit(False))
    return F.coalesce({"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op], F.lit(False))
