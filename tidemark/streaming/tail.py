"""Live data: tails, topics, windows and sinks over Structured Streaming.

The boundary of past and live is a catalog version, never a clock: a tail
delivers what versions after it have appended, so compaction, retention and
splits send nothing again.  A batch that is written a second time after a
failure is recognised by its stream and number and changes nothing.
``deliver`` itself is called at least once for each batch, with the batch's
number, by which a subscriber knows a repeated one.  Nothing is dropped for
slow readers.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..model import bucket_start, to_timestamp
from ..sources.catalog import Catalog


@dataclass(frozen=True)
class Topic:
    """Which rows a subscriber gets."""

    kind: str = "all"
    value: object = None
    parts: tuple[Topic, ...] = ()

    def __and__(self, other: Topic) -> Topic:
        """Both; ``all`` adds nothing, and nested conjunctions become one."""
        parts = tuple(p for t in (self, other) for p in (t.parts if t.kind == "and" else () if t.kind == "all" else (t,)))
        return parts[0] if len(parts) == 1 else Topic("and", None, parts) if parts else Topic()

    def __or__(self, other: Topic) -> Topic:
        return Topic("or", None, (self, other))

    def column(self) -> Column:
        if self.kind == "shard":
            return F.col("shard_id") == self.value
        if self.kind == "tenant":
            return F.col("tenant_id") == self.value
        if self.kind == "metrics":
            return F.col("metric_name").isin(*self.value)
        if self.kind in ("and", "or"):
            return reduce(and_ if self.kind == "and" else or_, [p.column() for p in self.parts])
        return F.lit(True)


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New chunks of a folder as they appear; the files per micro-batch bound its work."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(path)


def live(source: DataFrame, where: str | Column | None = None, topic: Topic = Topic(), since: int | None = None) -> DataFrame:
    """Rows of a topic that pass a condition, from a time on."""
    rows = source.where(topic.column())
    if since is not None:
        rows = rows.where(F.col("timestamp_ns") >= since)
    return rows if where is None else rows.where(where)


def timed(rows: DataFrame, late: str = "1 minute") -> DataFrame:
    """Rows with the column ``time`` under a watermark."""
    return rows.withColumn("time", to_timestamp(F.col("timestamp_ns"))).withWatermark("time", late)


def windowed(rows: DataFrame, width: str, slide: str | None = None, by: list[str] = ("metric_name",), value: str = "value_f64", late: str = "1 minute") -> DataFrame:
    """Sums, means and counts in tumbling windows, or sliding ones; rows later than the watermark are dropped."""
    w = F.window("time", width, slide) if slide else F.window("time", width)
    out = timed(rows, late).groupBy(w.alias("w"), *by).agg(F.sum(value).alias("sum_value"), F.avg(value).alias("avg_value"), F.count(value).alias("samples"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "sum_value", "avg_value", "samples")


def sessions(rows: DataFrame, gap: str, by: list[str], late: str = "1 minute") -> DataFrame:
    """Runs of rows of a key without a pause of ``gap``."""
    out = timed(rows, late).groupBy(F.session_window("time", gap).alias("w"), *by).agg(F.count("*").alias("samples"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "samples")


def buckets(rows: DataFrame, width: int, value: str = "value_f64") -> DataFrame:
    """Step buckets of a range query on a stream."""
    return rows.groupBy(bucket_start(F.col("timestamp_ns"), width).alias("time_bucket"), "metric_name").agg(F.avg(value).alias("value"), F.count("*").alias("samples"))


def deduplicated(rows: DataFrame, keys: list[str] = ("timestamp_ns", "metric_name"), late: str = "10 minutes") -> DataFrame:
    """First row of a key within the watermark; state older than it goes."""
    return timed(rows, late).dropDuplicatesWithinWatermark(list(keys))


def last_seen(rows: DataFrame, late: str = "1 minute") -> DataFrame:
    """Per metric the rows, sum and newest time so far: state kept by a function of our own."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        import pandas as pd

        n, total, newest = state.get if state.exists else (0, 0.0, 0)
        for b in batches:
            n, total, newest = n + len(b), total + float(b["value_f64"].sum()), max(newest, int(b["timestamp_ns"].max()))
        state.update((n, total, newest))
        yield pd.DataFrame({"metric_name": [key[0]], "samples": [n], "sum_value": [total], "newest_ns": [newest]})

    return rows.groupBy("metric_name").applyInPandasWithState(step, "metric_name string, samples long, sum_value double, newest_ns long", "samples long, sum_value double, newest long", "update", GroupStateTimeout.NoTimeout)


def trigger(writer, interval: str | None):
    """All that is there and then an end, or a batch each interval until it is stopped."""
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def drain(rows: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs all that is there into storage, a folder for each batch; the rows written.

    In complete mode a batch holds the whole result, so the newest folder is read; in the
    others all are, and in update mode the later rows of a key replace the earlier ones.
    """
    spark = rows.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/{batch_id}")

    rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*rows.schema.fields, StructField("batch", IntegerType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []
    if not done:
        return spark.createDataFrame([], schema)
    wanted = done[-1:] if mode == "complete" else done
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{n}" for n in wanted])


def to_chunks(rows: DataFrame, catalog: Catalog, checkpoint: str, interval: str = "5 minutes", once: bool = False) -> StreamingQuery:
    """Appends each micro-batch to a catalog: the flush of a buffer, with offsets kept by the checkpoint.

    The commit holds the batch's number, so a batch that is replayed after a crash is appended once.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        catalog.append(batch, writer=(checkpoint, batch_id))

    writer = rows.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return trigger(writer, None if once else interval).start()


def appended(catalog: Catalog, after: int) -> DataFrame:
    """A stream of the chunks (version, path) that versions after one have appended; rewrites are not among them."""
    line = F.from_json("value", "version long, live boolean, add struct<path string>").alias("x")
    log = catalog.spark.readStream.schema("value string").option("pathGlobFilter", "v*").text(f"{catalog.root}/_catalog").select(line)
    return log.where((F.col("x.version") > after) & F.col("x.live") & F.col("x.add.path").isNotNull()).select("x.version", F.col("x.add.path").alias("path"))


@dataclass
class Subscription:
    """A live tail and what it has sent so far."""

    query: StreamingQuery
    deliver: Callable
    counts: dict[str, int] = field(default_factory=lambda: {"batches": 0, "delivered": 0, "filtered": 0})
    open: bool = True

    def stop(self) -> None:
        """Ends the tail and says so."""
        self.query.stop()
        self.end()

    def wait(self, seconds: float | None = None) -> bool:
        """Waits for the end of a tail that takes what is there; True if it came."""
        over = self.query.awaitTermination(seconds) if seconds is not None else (self.query.awaitTermination(), True)[1]
        if over:
            self.end()
        return over

    def end(self) -> None:
        if self.open:
            self.open = False
            self.deliver("end", None, -1)


def boundary(catalog: Catalog, checkpoint: str) -> tuple[int, bool]:
    """The version where a tail's past ends, and whether it has just been set; the same at every start from its checkpoint."""
    spark = catalog.spark
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/boundary")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place):
        stream = fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()))["version"], False
        finally:
            stream.close()
    version = catalog.snapshot().version
    stream = fs.create(place, False)
    stream.write(bytearray(json.dumps({"version": version}).encode()))
    stream.close()
    return version, True


def subscribe(catalog: Catalog, deliver: Callable, checkpoint: str, where: str | Column | None = None, topic: Topic = Topic(), interval: str | None = "1 second", count: bool = True) -> Subscription:
    """Delivers the rows of a catalog's version, then what later versions append, for as long as it runs.

    ``deliver(kind, rows, batch)`` gets ``data``, ``error`` and ``end``.  Without an interval the
    tail takes what is there and ends.  Vacuum must keep versions that no tail has seen yet.
    """
    spark = catalog.spark
    after, new = boundary(catalog, checkpoint)
    if new:
        deliver("data", live(catalog.rows_of(list(catalog.snapshot(after).chunks), catalog.snapshot(after)), where, topic), -1)
    sub: Subscription

    def send(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r.path for r in batch.select("path").collect())
        if not paths:
            return
        now = catalog.snapshot()
        rows = spark.read.schema(now.schema).parquet(*paths)
        wanted = live(rows, where, topic)
        try:
            deliver("data", wanted, batch_id)
        except Exception as e:  # a subscriber's failure is told to it, and stops its stream
            deliver("error", str(e), batch_id)
            raise
        if count:
            n, every = wanted.count(), rows.count()
            sub.counts = {"batches": sub.counts["batches"] + 1, "delivered": sub.counts["delivered"] + n, "filtered": sub.counts["filtered"] + every - n}

    writer = appended(catalog, after).writeStream.foreachBatch(send).option("checkpointLocation", f"{checkpoint}/state")
    sub = Subscription(None, deliver)
    sub.query = trigger(writer, interval).start()
    return sub


def past_and_live(past: DataFrame, source: DataFrame, where: str | Column, deliver, checkpoint: str) -> StreamingQuery:
    """Delivers past rows, then each micro-batch that a stream has, as messages ``data``, ``error`` and ``end``; for sources without a catalog.

    ``past`` is a snapshot and ``source`` a stream that starts after it; ``subscribe`` keeps the two apart by itself.
    """
    deliver("data", past.where(where))

    def send(batch: DataFrame, batch_id: int) -> None:
        try:
            deliver("data", batch)
        except Exception as e:  # a subscriber's failure is told to it, and stops its stream
            deliver("error", str(e))
            raise

    query = trigger(source.where(where).writeStream.foreachBatch(send).option("checkpointLocation", checkpoint), None).start()
    query.awaitTermination()
    deliver("end", None)
    return query


def receipts(query: StreamingQuery) -> dict[str, int]:
    """Rows read and written so far, as the stream reports them."""
    progress = query.recentProgress
    return {"batches": len(progress), "received": sum(p["numInputRows"] for p in progress)}
