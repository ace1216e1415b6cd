import time

import pytest
from pyspark.sql import functions as F

from tidemark.model import SECOND
from tidemark.operators import lifecycle
from tidemark.sources.catalog import Catalog
from tidemark.streaming import tail

BASE = 10**18


@pytest.fixture
def source(spark, tmp_path):
    rows = spark.createDataFrame([(BASE + i * SECOND, ("cpu", "mem")[i % 2], float(i)) for i in range(100)], "timestamp_ns long, metric_name string, value_f64 double")
    rows.coalesce(2).write.parquet(str(tmp_path / "in"))
    return tail.stream(spark, str(tmp_path / "in"), rows.schema), rows


def test_sessions_and_dedup(spark, source, tmp_path):
    stream, rows = source
    got = tail.drain(tail.sessions(stream, "5 seconds", ["metric_name"], late="1 hour"), str(tmp_path / "sessions"), mode="complete")
    assert {r.metric_name: r.samples for r in got.collect()} == {"cpu": 50, "mem": 50}
    assert tail.drain(tail.deduplicated(stream.unionByName(stream)), str(tmp_path / "unique")).count() == 100


def test_own_state(spark, source, tmp_path):
    stream, _ = source
    got = {r.metric_name: r for r in tail.drain(tail.last_seen(stream), str(tmp_path / "seen"), mode="update").orderBy("samples").collect()}
    assert got["cpu"].samples == 50 and got["mem"].newest_ns == BASE + 99 * SECOND


def test_past_then_live(spark, source, tmp_path):
    stream, rows = source
    told = []
    query = tail.past_and_live(rows.limit(10), stream, F.col("metric_name") == "cpu", lambda kind, df: told.append((kind, df.count() if kind == "data" else None)), str(tmp_path / "state"))
    assert told[0][0] == "data" and told[-1] == ("end", None) and sum(n for k, n in told[1:-1]) == 50
    assert tail.receipts(query)["received"] == 100


def test_restart_appends_once(spark, source, tmp_path):
    stream, _ = source
    catalog = Catalog(spark, str(tmp_path / "chunks"))
    for _ in range(2):
        tail.to_chunks(stream, catalog, str(tmp_path / "state"), once=True).awaitTermination()
    assert catalog.read().count() == 100


def test_replayed_batch_after_a_crash(spark, source, tmp_path, monkeypatch):
    stream, _ = source
    catalog = Catalog(spark, str(tmp_path / "chunks"))
    append = catalog.append

    def crash(*a, **k):
        append(*a, **k)
        raise RuntimeError("after the commit, before the checkpoint")

    monkeypatch.setattr(catalog, "append", crash)
    with pytest.raises(Exception):
        tail.to_chunks(stream, catalog, str(tmp_path / "state"), once=True).awaitTermination()
    monkeypatch.setattr(catalog, "append", append)
    assert catalog.read().count() == 100
    tail.to_chunks(stream, catalog, str(tmp_path / "state"), once=True).awaitTermination()
    assert catalog.read().count() == 100 and list(catalog.snapshot().writers.values()) == [0]


def test_tail_stays_live(spark, source, tmp_path):
    _, rows = source
    catalog = Catalog(spark, str(tmp_path / "chunks"))
    catalog.append(rows.where("value_f64 < 40"), files=3)
    told = []
    hear = lambda kind, df, batch: told.append((kind, sorted(r.value_f64 for r in df.collect()) if kind == "data" else df))
    sub = tail.subscribe(catalog, hear, str(tmp_path / "tail"), topic=tail.Topic("metrics", ("cpu",)), interval="200 milliseconds")

    def until(n):
        end = time.time() + 60
        while sum(len(x) for k, x in told if k == "data") < n and time.time() < end:
            time.sleep(0.1)
        return sorted(v for k, x in told if k == "data" for v in x)

    assert until(20) == [float(i) for i in range(0, 40, 2)]
    catalog.append(rows.where("value_f64 >= 40 AND value_f64 < 60"))
    assert until(30) == [float(i) for i in range(0, 60, 2)]
    lifecycle.compact(catalog, list(catalog.snapshot().chunks))
    catalog.append(rows.where("value_f64 >= 60"))
    assert until(50) == [float(i) for i in range(0, 100, 2)]
    end = time.time() + 30
    while sub.counts["delivered"] < 30 and time.time() < end:
        time.sleep(0.1)
    assert sub.counts["delivered"] == sub.counts["filtered"] == 30
    sub.stop()
    sub.stop()
    assert [k for k, _ in told].count("end") == 1
    again = []  # a restart from the same place sends neither past nor seen rows
    tail.subscribe(catalog, lambda kind, df, batch: again.append(kind), str(tmp_path / "tail"), interval=None).wait()
    assert again == ["end"]


def test_a_failing_subscriber_is_told(spark, source, tmp_path):
    _, rows = source
    catalog = Catalog(spark, str(tmp_path / "chunks"))
    told = []

    def hear(kind, df, batch):
        told.append(kind)
        if kind == "data" and batch >= 0:
            raise ValueError("no")

    catalog.append(rows)
    sub = tail.subscribe(catalog, hear, str(tmp_path / "tail"), interval=None)
    sub.wait()
    catalog.append(rows)
    with pytest.raises(Exception):
        tail.subscribe(catalog, hear, str(tmp_path / "tail"), interval=None).wait()
    assert told == ["data", "end", "data", "error"]
