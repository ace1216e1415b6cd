"""Operator 7, sharding by sampled splitters, in DataFrame operations alone.

The key of a record is a hash of its text, so equal texts are neighbours in key
order.  A sample of keys, drawn with chances in proportion to size, gives the
quantiles that cut the key space into ranges; a record finds its range by a
binary search of the bounds.  Ranges far above their share are subdivided: by a
hash of the key, so that equal texts stay together, and only the records of a
key that is by itself above the limit by a hash of the record (or, where even
equal records are too many, one after the other).  Ranges, and the
subdivisions of overfull ones, go to shards in key order by the sums of bytes
before them, so that shards differ by at most about one range: the law is
``bytes``.

Slots are numbered inside the pieces of a range and then shifted by the counts
of the pieces before, so no task ever sorts a shard.

Defined cases: a null text is an empty one with size 1; a very long text is a
range or a piece of its own; repeated rows are sharded one by one, and so are
ties of the key, in order of doc_id; a null doc_id is a value like any other;
an empty table gives no rows; extra columns, whatever their names, are ignored
(``shard``) or kept inside ``record`` (``sharded``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import named, written

#: Ranges a shard is made of, and sampled keys a range.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 64, 64
#: An overfull range holds this many times its share.
OVERFULL = 2.0
#: Rows in a piece at most, about: what one task numbers.
PIECE_ROWS = 1 << 16
#: Bits of a key: what a double holds exactly.
KEY_BITS = 52


def key_of(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)


def chance(*of: Column) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*of, F.lit("sample")), 11) / F.lit(float(1 << 53))


def splitters(sizes: DataFrame, total: int, ranges: int) -> list[int]:
    """Bounds of ranges with near equal sizes; ``sizes`` has one row (key, size) for each key.

    A key enters the sample size * rate times, rounded up or down by chance.
    The sample has a fixed expected size, and so has the list of bounds.
    """
    rate = ranges * SAMPLES_PER_RANGE / max(1, total)
    drawn = sizes.select("key", F.floor(F.col("size") * F.lit(rate) + chance(F.col("key"))).alias("n")).where("n > 0")
    at = ", ".join(repr(i / ranges) for i in range(1, ranges))
    row = drawn.agg(F.expr(f"percentile(key, array({at}), n)").alias("bounds")).first()
    return sorted({int(x) for x in row.bounds or []})


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key: a binary search, one step for each bit of the answer."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at))


def numbered(rows: DataFrame, large: Column) -> DataFrame:
    """Rows with ``nth``, the number of a record among its equals where these are by themselves above the limit, else null.

    Numbers are counted inside partitions and shifted by the counts of those before, so no task holds all equals.
    """
    record = ["key", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none")]
    same = written(rows.where("split_key").groupBy(*record).agg(large.alias("split_record")).where("split_record"), "records")
    if same.isEmpty():
        return rows.withColumn("nth", F.lit(None).cast("long"))
    told = rows.withColumns({"id": F.coalesce("doc_id", F.lit(-1)), "none": F.col("doc_id").isNull()}).join(F.broadcast(same), ["key", "id", "none"], "left")
    parts = told.where("split_record").withColumn("from", F.shiftright("place", 33))
    before = Window.partitionBy("key", "id", "none").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("key", "id", "none", "from").agg(F.count("*").alias("n"))
    counts = counts.select("key", "id", "none", "from", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("key", "id", "none", "from").orderBy("place"))
    parts = parts.withColumn("inside", inside).join(counts, ["key", "id", "none", "from"])
    kept = [named(c) for c in rows.columns]
    return told.where("split_record IS NULL").select(*kept, F.lit(None).cast("long").alias("nth")).unionAll(parts.select(*kept, (F.col("base") + F.col("inside")).cast("long").alias("nth")))


def assigned(rows: DataFrame, shards: int) -> DataFrame:
    """Rows (doc_id, size, text_crc32, key, others kept) with shard and slot."""
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "sizes")
    sizes = rows.groupBy("key").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size").alias("n")).first().n or 0
    ranges = shards * RANGES_PER_SHARD
    rows = rows.withColumn("range", range_of(F.col("key"), splitters(sizes, total, ranges)))
    share = max(1.0, total / ranges)
    # Keys, and records, that are above the limit alone: there are fewer than ranges / OVERFULL, whatever the table's size.
    large = F.sum("size") > F.lit(OVERFULL * share)
    split_keys = written(rows.groupBy("key").agg(large.alias("split_key")).where("split_key"), "keys")
    rows = rows.join(F.broadcast(split_keys), "key", "left")
    rows = numbered(rows, large)
    held = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    over = F.col("bytes") > F.lit(OVERFULL * share)
    parts = F.greatest(F.when(over, F.ceil(F.col("bytes") / F.lit(share))).otherwise(1), F.ceil(F.col("rows") / F.lit(PIECE_ROWS)))
    held = written(held.select("range", "bytes", over.alias("over"), parts.cast("int").alias("parts")), "ranges")
    by = F.when(F.col("nth").isNotNull(), F.col("nth")).when(F.col("split_key"), F.xxhash64("doc_id", "key")).otherwise(F.xxhash64("key"))
    rows = rows.join(held.select("range", "parts"), "range").withColumn("part", F.pmod(by, F.col("parts")).cast("int")).drop("parts", "place", "split_key", "nth")

    # Bytes before each range (their number is fixed), then before each piece inside its range.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("range", "bytes", "over", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("from"))
    pieces = rows.groupBy("range", "part").agg(F.sum("size").alias("own"), F.count("*").alias("n")).join(held, "range")
    inside = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.when(F.col("over"), F.col("from") + F.coalesce(F.sum("own").over(inside), F.lit(0)) + F.col("own") / 2).otherwise(F.col("from") + F.col("bytes") / 2)
    pieces = pieces.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(float(max(1, total))))).cast("int"))

    # Rows before each piece in its shard: by range of the shard first, then by piece.
    in_range = Window.partitionBy("shard", "range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_range = pieces.groupBy("shard", "range").agg(F.sum("n").alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.select("shard", "range", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("first"))
    pieces = pieces.join(by_range, ["shard", "range"]).select("range", "part", "shard", (F.col("first") + F.coalesce(F.sum("n").over(in_range), F.lit(0))).alias("base"))
    number = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id", "text_crc32", "size"))
    return rows.withColumn("number", number).join(written(pieces, "pieces"), ["range", "part"]).withColumn("slot", F.col("base") + F.col("number") - 1)


def sized(docs: DataFrame, *keep: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        *keep,
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        key_of(text).alias("key"),
    )


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    return assigned(sized(docs), shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 16, path: str | None = None) -> DataFrame:
    """The documents, all columns kept, as ``record`` with shard and slot; the texts move into the ranges.

    With a path, the shards are written there as Parquet, a folder ``shard=k`` for each, and read again.
    """
    rows = assigned(sized(docs, F.struct(*[named(c) for c in docs.columns]).alias("record")), shards)
    rows = rows.select("record", "shard", F.col("slot").cast("long").alias("slot"))
    if path is None:
        return rows
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
