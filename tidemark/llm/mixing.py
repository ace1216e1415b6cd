"""Operator 8, mixing sources to target weights, in DataFrame operations alone.

The documents of a source stand one after the other and are cut into blocks of
a fixed number of words.  A source's target is its weight's share of the words
wanted, at most ``epochs`` times its own words.  The target in blocks is the
source's number of slots; each slot falls on one of the output shards by
chance, so the counts of a source over the shards are a multinomial draw.  Slot
j of a source with n blocks maps to block permutation(j mod n) of epoch j div n,
the permutation being a pseudorandom one of [0, n) for each source and epoch
(swap-or-not rounds).  Blocks and slots join by source and block number.

Slots are spread by chunks and blocks by number, so a source with a third of
all rows is no hot key; the position of a document in its source comes from
sums over buckets of documents, dealt by doc_id and text, and running sums
inside a bucket.

Three results of the same draw: ``packed`` gives the blocks themselves by shard
and slot; ``mixed`` the words that the blocks take of each document; ``mixture``
whole documents as often as the mix takes their words, none half.

Defined cases: null and empty texts have no words and nothing is taken of them;
a very long text fills many blocks; a null source is a source, the last in
order; sources without words get target 0; rows of the same doc_id, null ones
included, count one by one, those of the same text and source by their number;
ties of size are broken by doc_id, then by the text's hash; an empty table
gives no rows; extra columns, whatever their names, are ignored (``mixed``,
``packed``) or kept (``mixture``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import named, written

#: Words in a block, output shards, documents in a bucket and slots in a chunk.
BLOCK_WORDS, OUTPUT_SHARDS = 128, 64
BUCKET_DOCS, CHUNK_SLOTS = 2048, 4096
#: Rounds of a permutation.
ROUNDS = 24


def hashed(*of: Column) -> Column:
    """A value in [0, 2^48) that the columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*of), 16)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x under a pseudorandom permutation of [0, n) that the key names: swap-or-not rounds."""

    def swap(at: Column, r: Column) -> Column:
        mirror = F.pmod(hashed(r, *key) - at, n)
        return F.when(F.pmod(hashed(F.greatest(at, mirror), r + ROUNDS, *key), F.lit(2)) == 1, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), x.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """Sources (source, source_size) with rank and target.

    With sources in order of cap over weight, those before a point take their
    caps and the rest share what is left by weight; the point is the first at
    which no share is above its cap.  One row for each source, in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier, later = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.lit(float(share)) * F.sum("source_size").over(every)
    ranked = ranked.withColumn("rate", (wanted - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    fits = F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by_cap).alias("at"), "rate"))
    ranked = ranked.withColumn("fits", fits).withColumn("level", F.min("fits").over(every)["rate"])
    return ranked.select("source", "source_size", "rank", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sized(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, source, digest of the text and size in words of every document, and what else is to be kept."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(*identity(), words.cast("long").alias("size"), *keep)


def identity() -> list[Column]:
    """What tells rows apart: doc_id, source and a digest of the text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("digest")]


def positions(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with rank, source_size, target and ``start``, the words of the source before them."""
    rows = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(BUCKET_DOCS)))
    rows = rows.withColumn("bucket", F.pmod(hashed(F.coalesce("doc_id", F.lit(-1)), F.col("digest")), buckets))
    held = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("rank", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(held, ["rank", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner", "docs")


def slots(sources: DataFrame, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """rank, slot, shard and block of every slot of the mix."""
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS)).cast("long")
    plan = sources.where("source_size > 0").withColumn("blocks", blocks)
    plan = plan.withColumn("slots", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")).where("slots > 0")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.lit(CHUNK_SLOTS)).cast("long")))
    # A fixed number of partitions: by bytes the chunks are nothing, by the slots they stand for they are all the work.
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = plan.select("rank", "blocks", "slots", chunk.alias("chunk")).repartition(parts, "rank", "chunk")
    first = F.col("chunk") * CHUNK_SLOTS
    made = chunks.select("rank", "blocks", F.explode(F.sequence(first, F.least(first + CHUNK_SLOTS, F.col("slots")) - 1)).alias("slot"))
    epoch, place = F.floor(F.col("slot") / F.col("blocks")).cast("long"), F.pmod("slot", "blocks")
    return made.select("rank", "slot", F.pmod(hashed(F.col("rank"), F.col("slot"), F.lit(7)), F.lit(output_shards)).alias("shard"), permuted(place, F.col("blocks"), F.col("rank"), epoch).alias("block"))


def draws(sources: DataFrame, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """shard, rank and the multinomial number of blocks that the shard draws of the source."""
    return slots(sources, output_shards).groupBy("shard", "rank").agg(F.count("*").alias("blocks"))


def sources_of(rows: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    return written(targets(sizes, weights, share, epochs).join(sizes.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "sources")


def drawn(docs: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """Rows of ``sized`` with source_size, target and taken."""
    rows = written(sized(docs), "words")
    sources = sources_of(rows, weights, share, epochs)
    placed = positions(rows, sources)
    own = ["rank", "bucket", "start", "doc_id", "source", "digest", "size", "source_size", "target"]
    spans = placed.where("size > 0")
    pieces = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS))))
    times = slots(sources).groupBy("rank", "block").agg(F.count("*").alias("times"))
    first = F.col("block") * BLOCK_WORDS
    part = F.least(F.col("start") + F.col("size"), first + BLOCK_WORDS) - F.greatest(F.col("start"), first)
    # The planner takes the few rows that slots are exploded from for their size; they must not be broadcast.
    taken = pieces.join(times.hint("merge"), ["rank", "block"], "left").groupBy(*own).agg(F.sum(part * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    none = placed.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).withColumn("source_size", F.col("source_size").cast("long"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every document."""
    return drawn(docs, weights, share, epochs).select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2) -> DataFrame:
    """The documents, all columns kept, as often as the mix takes them.

    A document's copies are its words taken over its size, rounded so that the sums keep up with each
    other: in a bucket of a source, with documents in order of size, the copies of the first k are the
    sum of their shares, rounded down from a start that a hash gives.  Neighbours are of like size, so a
    bucket is off by less than its longest document, and the words of a source meet its target.  Row k
    of equal ones (doc_id, source and text) gets its part of their copies.
    """
    equal = drawn(docs, weights, share, epochs).groupBy("rank", "bucket", "doc_id", "source", "digest")
    equal = equal.agg(F.max("size").alias("size"), F.count("*").alias("n"), (F.sum("taken") / F.nullif(F.max("size"), F.lit(0))).alias("share")).where("share > 0")
    in_size = Window.partitionBy("rank", "bucket").orderBy("size", "doc_id", "digest")
    start = hashed(F.col("rank"), F.col("bucket"), F.lit("copies")) / F.lit(float(1 << 48))
    reached = F.floor(F.round(F.sum("share").over(in_size.rowsBetween(Window.unboundedPreceding, 0)), 9) + start)
    equal = equal.withColumn("reached", reached).withColumn(COPIES, F.col("reached") - F.coalesce(F.lag("reached").over(in_size), F.lit(0)))
    decided = equal.where(F.col(COPIES) > 0).select(F.struct("doc_id", "source", "digest").alias(KEY), COPIES, F.col("n").alias(EQUAL))
    others = [named(f.name) for f in docs.schema if f.name not in ("doc_id", "source", "text") and "map<" not in f.dataType.simpleString()]
    number = F.row_number().over(Window.partitionBy(KEY).orderBy(F.xxhash64(F.lit(0), *others)))
    rows = docs.withColumn(KEY, F.struct(*identity())).withColumn(NUMBER, number).join(decided, KEY)
    upto = lambda k: F.call_function("div", k * F.col(COPIES), F.col(EQUAL))
    rows = rows.withColumn(TIMES, (upto(F.col(NUMBER)) - upto(F.col(NUMBER) - 1)).cast("int")).where(F.col(TIMES) > 0)
    return rows.withColumn(TIMES, F.explode(F.sequence(F.lit(1), F.col(TIMES)))).select(*[named(c) for c in docs.columns])


def packed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2, output_shards: int = OUTPUT_SHARDS) -> DataFrame:
    """shard, slot, source, block and text (the block's words, joined by blanks): the mix itself, a row for each slot.

    Documents are cut at block bounds, the pieces of a block, ``BLOCK_WORDS`` at most, meet and are
    joined in order, and blocks and slots join by number.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(sized(docs, text.alias("text")), "words")
    sources = sources_of(rows, weights, share, epochs)
    spans = positions(rows.where("size > 0"), sources).withColumn("words", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    first = F.call_function("div", F.col("start"), F.lit(BLOCK_WORDS))
    last = F.call_function("div", F.col("start") + F.col("size") - 1, F.lit(BLOCK_WORDS))

    def piece(block: Column) -> Column:
        at = F.greatest(F.col("start"), block * BLOCK_WORDS)
        n = F.least(F.col("start") + F.col("size"), (block + 1) * BLOCK_WORDS) - at
        return F.struct(block.alias("block"), at.alias("at"), F.array_join(F.slice("words", (at - F.col("start") + 1).cast("int"), n.cast("int")), " ").alias("part"))

    pieces = spans.select("rank", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("rank", "p.*")
    blocks = pieces.groupBy("rank", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), " ").alias("text"))
    names = sources.select(F.col("rank").alias("r"), "source")
    out = slots(sources, output_shards).hint("merge").join(blocks, ["rank", "block"])
    return out.join(F.broadcast(names), F.col("rank") == F.col("r")).select(F.col("shard").cast("int").alias("shard"), "slot", "source", "block", "text")


#: Column names that no table uses.
KEY, TIMES, COPIES, EQUAL, NUMBER = (f"tidemark mixing {x}" for x in ("key", "times", "copies", "equal", "number"))
