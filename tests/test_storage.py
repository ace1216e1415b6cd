import json
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.model import SECOND
from tidemark.operators import advisor, lifecycle, rows
from tidemark.operators.predicates import All, Any_, Between, Compare, In, Not, Stats, time_range
from tidemark.plans import promql, sqlfront
from tidemark.sources import ingest
from tidemark.sources.cache import ReadCache
from tidemark.sources.catalog import HOUR, Catalog, Chunk, Conflict, Snapshot
from tidemark.streaming.tail import Topic

BASE = 10**18


def chunk(i, metric="cpu", lo=0.0, hi=1.0, level=0, size=1):
    return Chunk(f"{metric}{i}-{level}", BASE + i * HOUR, BASE + (i + 1) * HOUR - 1, 10, size, level, "", {"metric_name": [metric, metric, False], "v": [lo, hi, False]})


def test_prune_by_name_and_value():
    s = Snapshot(1, tuple([chunk(i) for i in range(5)] + [chunk(i, "memory") for i in range(5)]))
    assert len(s.prune()) == 10
    assert len(s.prune(Compare("metric_name", "=", "cpu"))) == 5
    s = Snapshot(1, tuple(chunk(i, "cpu", 100.0 * i, 100.0 * (i + 1)) for i in range(3)))
    n = lambda p: len(s.prune(p))
    assert n(Compare("v", ">", 150.0)) == 2 and n(Compare("v", "<", 50.0)) == 1
    assert n(Compare("v", "<=", 0.0)) == 1 and n(Compare("v", ">=", 300.0)) == 1  # bounds are kept
    assert n(All((Compare("v", ">", 150.0), Compare("v", "<", 180.0)))) == 1
    assert n(Any_((Compare("v", "<", 50.0), Compare("v", ">", 150.0)))) == 3
    assert n(In("v", (50.0, 250.0))) == 2 and n(Between("v", 120.0, 220.0)) == 2
    assert n(Compare("v", ">", 1e9)) == 0 and n(Not(Compare("v", ">", -1.0))) == 3
    assert n(Compare("v", "=", "text")) == 3 and n(Compare("other", "=", 1)) == 3
    many = Snapshot(1, tuple(chunk(i) for i in range(100)))
    assert len(many.prune(Between("timestamp_ns", BASE, BASE + 10 * HOUR - 1))) == 10


numbers = st.integers(-5, 5)
leaf = st.one_of(
    st.builds(Compare, st.just("v"), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), numbers),
    st.builds(In, st.just("v"), st.lists(numbers, min_size=1, max_size=3).map(tuple), st.booleans()),
    st.builds(Between, st.just("v"), numbers, numbers),
)
tree = st.recursive(leaf, lambda x: st.one_of(st.builds(All, st.lists(x, min_size=1, max_size=3).map(tuple)), st.builds(Any_, st.lists(x, min_size=1, max_size=3).map(tuple)), st.builds(Not, x)), max_leaves=6)


def holds(p, v):
    if isinstance(p, Compare):
        return {"=": v == p.value, "!=": v != p.value, "<": v < p.value, "<=": v <= p.value, ">": v > p.value, ">=": v >= p.value}[p.op]
    if isinstance(p, In):
        return (v in p.values) != p.negated
    if isinstance(p, Between):
        return p.low <= v <= p.high
    if isinstance(p, All):
        return all(holds(x, v) for x in p.parts)
    return any(holds(x, v) for x in p.parts) if isinstance(p, Any_) else not holds(p.part, v)


@settings(max_examples=300, deadline=None)
@given(tree, st.lists(numbers, min_size=1, max_size=6))
def test_pruning_never_drops_a_match(p, values):
    if any(holds(p, v) for v in values):
        assert p.may_match({"v": Stats(min(values), max(values))})


def test_time_range():
    t = "timestamp_ns"
    assert time_range(All((Compare(t, ">", 5), Compare(t, "<=", 9), Compare("v", "=", 1)))) == (6, 9)
    assert time_range(Any_((Between(t, 1, 3), Between(t, 7, 9)))) == (1, 9)
    assert time_range(Any_((Between(t, 1, 3), Compare("v", "=", 1)))) == (None, None)
    c = Chunk("x", 10, 20, 1)
    assert c.overlaps(20, 30) and c.overlaps(0, 10) and not c.overlaps(21, 30) and c.overlaps(None, None)


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame([(BASE + i * SECOND, ("cpu", "mem")[i % 2], f"h{i % 3}", float(i)) for i in range(120)], "timestamp_ns long, metric_name string, host string, value_f64 double")


def test_catalog_round_trip(spark, metrics, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert c.read().count() == 0
    c.append(metrics, files=4, stats=("metric_name", "value_f64"))
    assert c.read().count() == 120 and sum(x.rows for x in c.snapshot().chunks) == 120
    p = All((Compare("metric_name", "=", "cpu"), Compare("value_f64", ">=", 60.0)))
    assert len(c.snapshot().prune(p)) < len(c.snapshot().chunks)
    assert c.read(p).count() == 30
    before = c.snapshot()
    lifecycle.compact(c, list(before.chunks))
    assert [x.level for x in c.snapshot().chunks] == [1] and c.read().exceptAll(metrics).count() == 0
    assert c.read(snapshot=before).count() == 120  # an older version stays readable
    with pytest.raises(Conflict):
        c.swap(list(before.chunks), [])
    lifecycle.retain(c, BASE + 100 * SECOND)
    assert c.read().count() == 20
    assert c.vacuum(keep_versions=1, grace_seconds=0) and c.read().count() == 20
    assert c.vacuum(keep_versions=1, grace_seconds=1e6) == []


def test_rebuild_and_cache(spark, metrics, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.append(metrics, files=2)
    c.append(metrics.withColumn("zone", F.lit("z")), files=1)
    before = {x.path: x.rows for x in c.snapshot().chunks}
    assert {x.path: x.rows for x in c.rebuild().chunks} == before
    chunks = list(c.snapshot().chunks)
    cache = ReadCache(c, limit_bytes=sum(x.bytes for x in chunks))
    assert cache.get(chunks).where("zone = 'z'").count() == 120 and cache.get(chunks).count() == 240
    cache.get(chunks[:1])
    assert (cache.hits, cache.misses, len(cache.held)) == (1, 2, 1)
    cache.clear()
    assert c.chunk_table(chunks[0]).isidentifier()


def test_two_writers(spark, metrics, tmp_path):
    a, b = Catalog(spark, str(tmp_path)), Catalog(spark, str(tmp_path))
    x, y = a.write(metrics, files=1), b.write(metrics, files=1)
    first = a.register(x)
    second = b.register(y)
    assert (first.version, second.version) == (1, 2) and len(second.chunks) == 2


def test_split_and_partitions(spark, metrics, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.append(metrics, shard="s", files=2)
    lifecycle.split_shard(c, "s", "l", "r", BASE + 40 * SECOND)
    assert {r.shard: r["sum(rows)"] for r in c.as_frame().groupBy("shard").sum("rows").collect()} == {"l": 40, "r": 80}
    lifecycle.partitioned_write(metrics, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("year = 2001").count() == 120
    assert lifecycle.downsampled(metrics).agg(F.sum("samples")).first()[0] == 120


def shards_of(catalog):
    out = {}
    for c in catalog.snapshot().chunks:
        out[c.shard, c.level] = out.get((c.shard, c.level), 0) + c.rows
    return out


def test_rewrites_keep_rows_shards_and_levels(spark, metrics, tmp_path):
    c = Catalog(spark, str(tmp_path))
    timeless = metrics.limit(5).withColumn("timestamp_ns", F.lit(None).cast("long"))
    stats = ("metric_name", "value_f64")
    c.append(metrics.unionByName(timeless), shard="A", files=2, stats=stats)
    c.append(timeless, shard="A", files=1, stats=stats)
    c.append(metrics, shard="B", files=2, stats=stats)
    assert sum(x.timeless for x in c.snapshot().chunks) == 10 and c.read().count() == 250
    assert c.read(low=BASE).count() == 240 and c.read(Between("timestamp_ns", BASE, BASE)).count() == 2
    with pytest.raises(ValueError):
        lifecycle.compact(c, list(c.snapshot().chunks))
    lifecycle.compact(c, [x for x in c.snapshot().chunks if x.shard == "A"])
    assert shards_of(c) == {("A", 1): 130, ("B", 0): 120}
    lifecycle.retain(c, BASE + 100 * SECOND)
    assert shards_of(c) == {("A", 1): 30, ("B", 0): 20} and c.read().where("timestamp_ns IS NULL").count() == 10
    lifecycle.split_shard(c, "A", "l", "r", BASE + 110 * SECOND)
    assert shards_of(c) == {("l", 1): 20, ("r", 1): 10, ("B", 0): 20}
    assert all(set(x.stats) == set(stats) for x in c.snapshot().chunks)
    lifecycle.retain(c, BASE + 10_000 * SECOND)
    assert c.read().count() == 10 and c.read().where("timestamp_ns IS NOT NULL").count() == 0
    assert [r.kind for r in c.jobs().orderBy("began").collect()] == ["compact", "retain", "split", "retain"]
    assert c.expire_jobs(2**40) == 4 and c.jobs().count() == 0
    with pytest.raises(ValueError):
        c.swap(list(c.snapshot().chunks), [], keeps_rows=True)
    assert {(x.shard, x.level) for x in Catalog(spark, str(tmp_path)).rebuild().chunks} >= {("l", 1), ("B", 0)}


def test_versions_and_writers(spark, metrics, tmp_path):
    c = Catalog(spark, str(tmp_path))
    chunk_ = c.write(metrics, files=1)[0]
    for i in range(40):
        c.register([Chunk(f"p{i}", i, i, 1)])
    assert len(c.snapshot().chunks) == 40 and len(c.snapshot(17).chunks) == 17 and c.versions()[-1] == 40
    assert not c.put("_catalog/v40", [{}]) and c.put("_catalog/other", [{"a": 1}]) and c.load("_catalog/other") == [{"a": 1}]
    c.unregister({f"p{i}" for i in range(40)})
    c.register([chunk_], metrics.schema)
    assert c.snapshot().schema == metrics.schema
    with pytest.raises(ValueError):
        c.append(metrics.withColumn("host", F.lit(1)))
    now = c.snapshot()
    for _ in range(2):
        c.append(metrics, writer=("w", 3))
    assert c.read().count() == 240 and c.snapshot().version == now.version + 1
    c.vacuum(keep_versions=1, grace_seconds=0)
    assert len(c.versions()) == 1 and c.read().count() == 240


def test_footers_tell_what_the_rows_do(spark, tmp_path):
    rows_ = spark.createDataFrame([(5, "b", None, float("nan")), (None, "é", None, 2.0), (-3, None, None, 1.0)], "timestamp_ns long, metric_name string, none string, v double")
    c = Catalog(spark, str(tmp_path))
    (x,) = c.write(rows_.coalesce(1), stats=("metric_name", "none", "v", "nowhere"))
    assert (x.low, x.high, x.rows, x.timeless) == (-3, 5, 3, 1)
    assert x.stats["metric_name"] == ["b", "é", True] and x.stats["none"] == [None, None, True] and "nowhere" not in x.stats
    assert Snapshot(1, (x,)).prune(Compare("v", ">", 100.0)) == [x] or x.stats["v"][1] == 2.0
    assert c.write(rows_.limit(0)) == []


def test_leases(spark, tmp_path):
    from tidemark.sources.leases import Leases

    a = Leases(Catalog(spark, str(tmp_path)), seconds=10)
    one = a.acquire("x/1", "me", now=100)
    assert one and a.acquire("x/1", "you", now=105) is None and a.acquire("y", "you", now=105)
    two = a.renew(one, now=108)
    assert two.until == 118 and a.renew(one, now=109) is None and a.acquire("x/1", "you", now=112) is None
    assert a.finish(two, "done").state == "done" and a.finish(two, "done") is None
    three = a.acquire("x/1", "you", now=113)
    assert three.owner == "you" and [x.name for x in a.scavenge(now=200)] == ["x/1", "y"] and a.scavenge(now=201) == []
    assert a.acquire("x/1", "me", now=202).number == three.number + 2


def test_compaction_under_leases(spark, metrics, tmp_path):
    from tidemark.sources.leases import Leases

    c = Catalog(spark, str(tmp_path))
    for _ in range(3):
        c.append(metrics, files=1)
    name = f"compact-{sorted(c.snapshot().chunks, key=lambda x: x.order)[0].path.rpartition('/')[2]}"
    held = Leases(c).acquire(name, "other")
    assert lifecycle.compact_all(c, least=3, owner="me") == 0
    Leases(c).finish(held, "failed")
    assert lifecycle.compact_all(c, least=3, owner="me") == 1 and Leases(c).newest(name).state == "done"


def test_promql_prunes_chunks(spark, metrics, tmp_path):
    c = Catalog(spark, str(tmp_path))
    for m in ("cpu", "mem"):
        c.append(metrics.where(F.col("metric_name") == m), files=4, stats=("metric_name", "host"))
    q = promql.parse('cpu{host="h0"}')
    assert len(c.snapshot().prune(promql.predicate(q), BASE, BASE + 10 * SECOND)) == 1
    for compat in (True, False):
        a, b = (promql.range_query(x, 'sum(cpu{host="h0"})', BASE // SECOND, BASE // SECOND + 20, 5, compat).collect() for x in (c, metrics))
        assert sorted(map(str, a)) == sorted(map(str, b))
        assert [r.value for r in promql.instant(c, "cpu", BASE // SECOND + 9, compat).collect()] == [r.value for r in promql.instant(metrics, "cpu", BASE // SECOND + 9, compat).collect()] or not compat


def test_compaction_groups():
    chunks = tuple(Chunk(f"a{i}", BASE // HOUR * HOUR + i, BASE + i, 1, 10) for i in range(15)) + (Chunk("b", BASE + 5 * HOUR, BASE + 6 * HOUR, 1, 10),)
    assert [len(g) for g in lifecycle.fresh_groups(chunks)] == [15]
    assert lifecycle.fresh_groups(chunks[:14]) == []
    assert [len(g) for g in lifecycle.level_groups(chunks, 0, 40)] == [4, 4, 4, 4]
    assert [len(g) for g in lifecycle.level_groups(chunks[:5], 0, 40)] == [4]
    assert lifecycle.target_bytes(3) == 5 * lifecycle.target_bytes(2)
    apart = tuple(Chunk(f"{s}{i}", BASE // HOUR * HOUR + i, BASE + i, 1, 10, 0, s) for i in range(9) for s in "xy")
    assert [{c.shard for c in g} for g in lifecycle.fresh_groups(apart, 9)] == [{"x"}, {"y"}]
    assert [(len(g), g[0].shard) for g in lifecycle.level_groups(apart, 0, 50)] == [(5, "x"), (4, "x"), (5, "y"), (4, "y")]


def test_dedup(spark):
    df = spark.createDataFrame([(100, "cpu", 1.0), (200, "mem", 2.0), (300, "cpu", 3.0), (100, "cpu", 4.0), (400, "disk", 5.0), (None, "cpu", 6.0), (None, "cpu", 6.0), (7, None, 1.0), (7, "", 2.0)], "timestamp_ns long, metric_name string, v double")
    got = rows.dedup(df, order=["v"])
    assert got.count() == 7 and got.where("timestamp_ns = 100").first().v == 1.0
    assert rows.dedup_any(df).count() == 7
    assert rows.dedup(df.drop("metric_name")).count() == 9


def test_asof_bucketed_equals_plain(spark):
    import random

    r = random.Random(1)
    left = spark.createDataFrame([(i, r.choice("ab"), r.randrange(1000)) for i in range(200)], "id long, k string, t long")
    right = spark.createDataFrame([("a", t, t * 1.0) for t in range(5, 1000, 37)] + [("b", 500, None)], "k string, t long, v double")
    a = rows.asof_join(left, right, "t", ["k"], ["v"])
    b = rows.asof_join(left, right, "t", ["k"], ["v"], bucket=50)
    assert a.count() == 200 and a.exceptAll(b).count() == 0
    assert all(x.v == max((t * 1.0 for t in range(5, 1000, 37) if t <= x.t), default=None) for x in a.where("k = 'a'").collect())


def test_range_join_packed_equals_plain(spark, monkeypatch):
    import random
    from collections import Counter

    r = random.Random(3)
    starts = [r.choice([5, 5, 5, r.randrange(-300, 300), None]) for _ in range(200)]
    spans = spark.createDataFrame([(i, lo, None if lo is None else lo + r.choice([-20, 0, 7, 40, 90])) for i, lo in enumerate(starts)], "s long, lo long, hi long")
    points = spark.createDataFrame([(i, r.choice([9, 9, 9, r.randrange(-300, 400), None])) for i in range(200)], "p long, t long")
    plain = Counter(map(tuple, points.join(spans, F.expr("t BETWEEN lo AND hi")).collect()))
    for tile, pack, width in ((1024, 128, 40), (16, 4, 40), (1, 1, 100)):
        monkeypatch.setattr(rows, "TILE", tile)
        monkeypatch.setattr(rows, "PACK", pack)
        got = rows.range_join(points, spans, "t", "lo", "hi", width)
        assert got.columns == ["p", "t", "s", "lo", "hi"] and Counter(map(tuple, got.collect())) == plain
    left = rows.range_join(points, spans, "t", "lo", "hi", 40, "left")
    assert Counter(map(tuple, left.collect())) == Counter(map(tuple, points.join(spans, F.expr("t BETWEEN lo AND hi"), "left").collect()))


def test_interval_pairs_are_stored_small(spark, tmp_path):
    from tidemark.queries import ORACLE_SQL, QUERIES

    kind = "IF(id % 2 = 0, 'error', 'purchase') AS event_type"
    spark.range(6000).selectExpr("id AS event_id", kind, "timestamp_micros((id * 7919) % 6000 * 1000000) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    QUERIES["join_interval"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    spark.read.parquet(f"{tmp_path}/events.parquet").createOrReplaceTempView("events")
    sums = ["count(1)", "count(error_id)", "count(event_id)", "sum(xxhash64(error_id, event_id) % 1000003)"]
    got, want = spark.read.parquet(f"{tmp_path}/out").selectExpr(*sums).first(), spark.sql(ORACLE_SQL["join_interval"].replace("epoch_us(", "unix_micros(")).selectExpr(*sums).first()
    assert got == want and got[0] > 3_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.5 * got[0]


def test_full_join_in_tiles(spark):
    import random
    from collections import Counter

    r = random.Random(2)
    left = spark.createDataFrame([(i, r.choice([1, 1, 1, 2, 3, None])) for i in range(150)] + [(7, 1), (900, 8)], "l long, a int")
    right = spark.createDataFrame([(i, r.choice([1, 1, 3, 4, None])) for i in range(90)] + [(901, 9)], "r long, b int")
    plain = Counter(map(tuple, left.join(right, F.expr("a = b"), "full").collect()))
    for tile in (1, 7, 1024):
        assert Counter(map(tuple, rows.full_join(left, right, ("a", "b"), tile).collect())) == plain
    assert Counter(map(tuple, rows.full_join(left, right.where("false"), ("a", "b"), 7).collect())) == Counter((*x, None, None) for x in map(tuple, left.collect()))


def test_join_full_parts_a_key(spark, tmp_path):
    from tidemark.queries import ORACLE_SQL, QUERIES

    spark.range(6000).selectExpr("id AS c_custkey", "int(id % 2) + 10 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).selectExpr("id AS s_suppkey", "int(id % 2) * 5 + 10 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["join_full"](spark, str(tmp_path))
    for t in ("customer", "supplier"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").createOrReplaceTempView(t)
    sums = ["count(1)", "count(c_custkey)", "count(s_suppkey)", "sum(xxhash64(c_custkey, s_suppkey) % 1000003)"]
    assert got.selectExpr(*sums).first() == spark.sql(ORACLE_SQL["join_full"]).selectExpr(*sums).first()
    places = got.select("*", F.spark_partition_id().alias("at")).where("c_custkey IS NOT NULL AND s_suppkey IS NOT NULL").select("at").distinct().count()
    assert places > 1  # one key: 3,000 customers by 1,500 suppliers


def test_split_edges(spark):
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "timestamp_ns long")
    assert [r.side for r in rows.split_at(df, 5).collect()] == ["left", "right", "right", None]
    assert rows.split_point(0, 1_200_000_000_000) == 600_000_000_000


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def block(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def request(labels, samples):
    return block(1, b"".join(block(1, block(1, k.encode()) + block(2, v.encode())) for k, v in labels) + b"".join(block(2, b"\x09" + struct.pack("<d", v) + b"\x10" + varint(t)) for v, t in samples))


def snappy(data):
    out = varint(len(data))
    for i in range(0, len(data), 60):
        part = data[i : i + 60]
        out += bytes([(len(part) - 1) << 2]) + part
    return out


def test_remote_write(spark):
    body = request([("__name__", "up"), ("job", "x")], [(3.0, 1000), (-2.0, -5), (1.5, 7), (float("nan"), 8), (float("inf"), 9), (0.0, 10)]) + request([("job", "y")], [(1.0, 1)])
    assert ingest.unsnappy(snappy(body)) == body
    assert ingest.unsnappy(b"\x06\x04ab\x01\x02") == b"ababab"
    df = spark.createDataFrame([(bytearray(snappy(body)),), (None,), (bytearray(b"\xff"),), (bytearray(snappy(body)[:-3]),)], "body binary")
    assert ingest.remote_write(df).where("error IS NOT NULL AND size(series) = 0").count() == 2
    got = ingest.widened(ingest.series_rows(ingest.remote_write(df))).collect()
    by = {(r.metric_name, r.timestamp_ns): r for r in got}
    assert len(got) == 7 and by["", 1_000_000].job == "y"
    assert by["up", 1_000_000_000].value_u64 == 3 and by["up", -5_000_000].value_i64 == -2 and by["up", 7_000_000].value_f64 == 1.5
    assert by["up", 9_000_000].value_f64 == float("inf") and by["up", 10_000_000].value_u64 == 0
    for bad in (b"\xff", snappy(body)[:-3], b"\x05\x01\x01"):
        with pytest.raises((ValueError, IndexError)):
            ingest.unsnappy(bad)


def test_otlp(spark):
    point = lambda **x: {"timeUnixNano": "5", "attributes": [{"key": "a", "value": {"stringValue": "point"}}], **x}
    req = {"resourceMetrics": [{"resource": {"attributes": [{"key": "a", "value": {"stringValue": "res"}}, {"key": "b", "value": {"intValue": "3"}}]}, "scopeMetrics": [{"metrics": [
        {"name": "g", "gauge": {"dataPoints": [point(asDouble=1.5), point(asInt="7"), point()]}},
        {"name": "h", "histogram": {"dataPoints": [point(sum=9.0, count="2"), point(count="4")]}},
        {"name": "s", "summary": {"dataPoints": [point(sum=2.5)]}},
    ]}]}]}
    got = ingest.otlp_rows(spark, [req]).collect()
    assert [r.metric_name for r in got] == ["g", "g", "g", "h", "h", "s"]
    assert [r.value_f64 for r in got[:2]] == [1.5, 7.0] and got[2].value_f64 != got[2].value_f64 and [r.value_f64 for r in got[3:]] == [9.0, 4.0, 2.5]
    assert got[0].labels == {"a": "point", "b": "3"}
    with pytest.raises(ValueError):
        ingest.otlp_rows(spark, [{}])
    bodies = spark.createDataFrame([(json.dumps(req),), ("{",), ("[1]",), (None,)], "body string")
    assert ingest.otlp(bodies).count() == 6 and ingest.otlp_decoded(bodies).where("error IS NOT NULL").count() == 2
    assert ingest.any_value({"bytesValue": b"hi"}) == "aGk="


def test_otlp_protobuf(spark):
    fixed = lambda n, x: varint(n << 3 | 1) + x
    text = lambda n, x: block(n, x.encode())
    number = lambda n, x: varint(n << 3) + varint(x)
    pair = lambda k, v: text(1, k) + block(2, v)
    at = fixed(3, struct.pack("<Q", 77))
    gauge = block(5, block(1, at + fixed(4, struct.pack("<d", 1.5)) + block(7, pair("a", text(1, "point")))) + block(1, at + fixed(6, struct.pack("<q", -7))))
    histogram = block(9, block(1, at + fixed(4, struct.pack("<Q", 2)) + fixed(5, struct.pack("<d", 9.0))) + block(1, at + fixed(4, struct.pack("<Q", 4))))
    wide = block(10, block(1, block(1, pair("e", number(2, 1))) + at + fixed(4, struct.pack("<Q", 3))))
    summary = block(11, block(1, at + fixed(5, struct.pack("<d", 2.5)) + block(7, pair("l", block(5, block(1, number(3, 1)) + block(1, text(1, "x")))))))
    metrics = b"".join(block(2, text(1, n) + text(3, "unit") + body) for n, body in (("g", gauge), ("h", histogram), ("w", wide), ("s", summary)))
    resource = block(1, block(1, pair("a", text(1, "res"))) + block(1, pair("b", number(3, (1 << 64) - 3))) + block(1, pair("m", block(6, block(1, pair("k", number(2, 0)))))))
    body = block(1, resource + block(2, block(1, text(1, "scope")) + metrics))
    rows_ = [(bytearray(body),), (bytearray(body[:-1]),), (None,), (bytearray(b""),)]
    df = spark.createDataFrame(rows_, "body binary")
    got = ingest.otlp(df).collect()
    assert [(r.metric_name, r.value_f64) for r in got] == [("g", 1.5), ("g", -7.0), ("h", 9.0), ("h", 4.0), ("w", 3.0), ("s", 2.5)]
    assert {r.timestamp_ns for r in got} == {77} and got[0].labels == {"a": "point", "b": "-3", "m": "{k:false}"}
    assert got[4].labels["e"] == "true" and got[5].labels["l"] == "[1,x]"
    assert ingest.otlp_decoded(df).where("error IS NOT NULL").count() == 1


def test_arrow(spark):
    t = pa.table({"timestamp": pa.array([1, 2], pa.timestamp("ns", "UTC")), "metric_name": pa.array(["a", "b"]).dictionary_encode(), "value_u64": pa.array([1, 2**63], pa.uint64())})
    got = ingest.from_arrow(spark, t).orderBy("timestamp_ns").collect()
    assert [r.timestamp_ns for r in got] == [1, 2] and int(got[1].value_u64) == 2**63
    with pytest.raises(ValueError):
        ingest.from_arrow(spark, pa.table({"timestamp": pa.array([1], pa.uint64())}))


def test_generated_is_stable(spark):
    a, b = ingest.generated(spark, 50, partitions=1), ingest.generated(spark, 50, partitions=7)
    assert a.count() == 600 and a.exceptAll(b).count() == 0


def test_topics(spark):
    df = spark.createDataFrame([("s1", 1, "cpu"), ("s2", 2, "mem"), ("s1", 2, "disk")], "shard_id string, tenant_id int, metric_name string")
    n = lambda t: df.where(t.column()).count()
    a, b, c = Topic("shard", "s1"), Topic("tenant", 2), Topic("metrics", ("cpu", "mem"))
    assert n(Topic()) == 3 and n(a) == 2 and n(a & b) == 1 and n(a | b) == 3 and n(a & c) == 1
    assert len((a & b & c).parts) == 3 and (Topic() & a) == a


def test_advisor(spark):
    stats = spark.createDataFrame([("t", "a", 200, 0.1, 100.0, 100, 10.0), ("t", "b", 99, 0.1, 1e9, 100, 10.0), ("t", "c", 500, 0.5, 100.0, 5000, 10.0)], "tenant string, column string, filter_count long, selectivity_p50 double, query_time_saved double, cardinality long, write_rate double")
    got = advisor.recommend(stats).collect()
    assert [(r.column, r.index_type) for r in got] == [("a", "inverted")]
    assert advisor.recommend(stats, existing=50).count() == 0
    load = spark.createDataFrame([("x", s, 60000.0) for s in range(61)] + [("y", s, 60000.0 if s % 30 else 1.0) for s in range(200)], "shard string, second long, writes_per_second double")
    assert [r.shard for r in advisor.hot_shards(load).collect()] == ["x"]
    states = spark.createDataFrame([("invisible", 100, "2024-01-01", None), ("invisible", 1, "2024-01-01", None), ("invisible", 1, "2024-02-29", None), ("visible", 0, "2024-01-01", "2024-02-28"), ("visible", 0, "2024-01-01", None)], "state string, would_have_helped int, created_at string, last_used string")
    states = states.withColumns({c: F.to_timestamp(c) for c in ("created_at", "last_used")})
    assert [r.next_state for r in advisor.next_state(states, F.to_timestamp(F.lit("2024-03-01"))).collect()] == ["visible", "removed", "invisible", "visible", "deprecated"]
    b = advisor.TokenBucket(1.0, 2.0)
    assert [b.admit(t) for t in (0, 0, 0, 1, 1)] == [True, True, False, True, False]
    assert advisor.Assignment((("b", 1), ("a", 1))).place()[0] == "a"
