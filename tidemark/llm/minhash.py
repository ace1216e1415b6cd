"""Operator 2, near-duplicates: BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its five-word shingles.  Weights are discretised at
the powers of two: a shingle of count w owns the levels [0, 1), [1, 2), [2, 4),
... below w, and each of these blocks runs one Poisson process over time whose
rate is its width times the number of components.  A point names a component
and a level; points above w are thinned out.  A component's value is the time
of the first point it gets.  Two texts agree in a component with probability
equal to their weighted Jaccard similarity, without bias, at a cost that does
not follow the counts and stays near the number of shingles.

Links.  Equal word sequences are one node.  Nodes that agree in a whole band of
components meet in a bucket.

1. In each bucket the node that meets most others leads; every member is held
   against its leader by exact multiset overlap, and verified links make
   components.
2. Buckets that still hold several components are compared tile by tile; of
   buckets with the very same members one is compared.  The members of the
   largest component and all others are dealt into tiles of bounded size; a
   group is two tiles, of which one at least holds others, so a large group of
   copies that one leader has joined is never held against itself again.

   First the sketches are compared, one byte of each component: members that
   agree with none of another component in ``LEAST_AGREE`` of the 128 need no
   text.  Then one matrix product gives the exact overlaps of a group's texts.
   Tasks return only members, or links that join components, fewer than they
   have nodes, so no pair is ever emitted for being in the same bucket, and no
   bucket is capped.

The chance to miss a pair at the threshold is (1 - 0.8^4)^32 < 1e-7 for the bands
and below 1e-9 for the sketches.

Texts are known by 128-bit digests: nodes by one of their words, and the texts
that a comparison needs by one of the whole text.

Defined cases: a null text is in a class of its own; texts without words are in
a class with the very same texts only; a text of fewer than five words has one
shingle, all its words; a very long text is signed and compared whole and fills
a tile alone; rows with the same doc_id are judged by their texts, and the
least doc_id of a class names it, so ties need no order; a null doc_id is kept
and never names a class unless all members lack an id; an empty table gives no
rows; extra columns are ignored (``near_duplicates``) or kept
(``deduplicate``), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import chunks, folded_words, release, spread, stored, texts, tidied, written
from .components import components
from .substring import GOLDEN, MASK, mixed, window_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
COMPONENTS = BANDS * ROWS
#: Nodes and words in a tile at most, about.  The work arrays of two tiles stay below 100 MB.
TILE, TILE_WORDS = 256, 250_000
#: Sketches in a tile at most, about, and components in which nodes of 0.8 agree but for a chance below 1e-9.
SKETCHES, LEAST_AGREE = 2048, 73
#: Members, and their words, that are verified against a leader in one group.
STAR, STAR_WORDS = 256, 500_000
#: Columns of shingles that a matrix product takes at a time, and text bytes signed together.
COLUMNS, SIGNED_BYTES = 4096, 1 << 20
#: A column name that no table uses.
KEY = "tidemark near duplicate key"


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles of a text, ascending."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = window_hashes(word_hashes(words), min(SHINGLE, len(words)))
    return np.unique(h, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    total = int(a[1].sum()) + int(b[1].sum())
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return both / (total - both)


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of different multisets.

    The j-th occurrence of a shingle is an element of its own, so the overlap
    of two multisets is the product of two rows of noughts and ones.  Elements
    that only one multiset has take no column.
    """
    n = len(bags)
    size = np.array([int(c.sum()) for _, c in bags])
    of = np.repeat(np.arange(n), size)
    counts = np.concatenate([c for _, c in bags]).astype(np.int64)
    first = np.cumsum(counts) - counts
    nth = np.arange(int(counts.sum())) - np.repeat(first, counts)
    unit = mixed(np.repeat(np.concatenate([h for h, _ in bags]), counts) + nth.astype(np.uint64) * GOLDEN)
    _, at, held = np.unique(unit, return_inverse=True, return_counts=True)
    column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[at]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        x = np.zeros((n, int(column[b - 1]) - low + 1), np.float32)
        x[of[a:b], column[a:b] - low] = 1
        both += x @ x.T
    both = both.astype(np.float64)
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def signatures(of: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash values, n x m, of n multisets given as (multiset, hash, count) in parallel arrays.

    Points are made up to a horizon that fills all components of a multiset
    with high chance; multisets with an empty component get twice the horizon.
    """
    total = np.bincount(of, counts, n)
    horizon = (np.log(m) + 4) / np.maximum(total, 1)
    out = np.full((n, m), np.inf)
    todo = total > 0
    while todo.any():
        out[todo] = np.inf
        pick = todo[of]
        fill(out.reshape(-1), of[pick], hashes[pick], counts[pick], horizon, m)
        todo &= np.isinf(out).any(1)
        horizon[todo] *= 2
    return out


def fill(out: np.ndarray, of: np.ndarray, hashes: np.ndarray, counts: np.ndarray, horizon: np.ndarray, m: int) -> None:
    level = 0
    while len(of):
        low = 0 if level == 0 else 1 << (level - 1)
        width = max(1, low)
        here = counts > low if level else counts > 0
        of, hashes, counts = of[here], hashes[here], counts[here]
        d, w = of, counts
        seed = mixed(hashes + np.uint64((level + 1) * int(GOLDEN) & MASK))
        time = np.zeros(len(d))
        step = 0
        while len(d):
            step += 1
            r = mixed(seed + np.uint64(step * int(GOLDEN) & MASK))
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
            live = time <= horizon[d]
            d, w, seed, time, r = d[live], w[live], seed[live], time[live], r[live]
            if not len(d):
                break
            r = mixed(r ^ GOLDEN)
            component = (r % np.uint64(m)).astype(np.int64)
            if width == 1:
                np.minimum.at(out, d * m + component, time)
            else:
                kept = low + width * ((r >> np.uint64(24)).astype(np.float64) * 2.0**-40) < w
                np.minimum.at(out, (d * m + component)[kept], time[kept])
        level += 1


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is in the key."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, bits.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key ^ bits[:, :, r]) + GOLDEN
    return key.view(np.int64)


def sign(words: list[list[bytes]]) -> np.ndarray:
    """Signatures of texts given as words; rows of texts without words stay infinite."""
    bags = [shingles(w) for w in words]
    of = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    return signatures(of, np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags]).astype(np.int64), len(bags))


def node_of(text: bytes, words: list[bytes]) -> bytes:
    """Equal for equal word sequences; for texts without words, equal for equal texts."""
    return xxhash.xxh3_128_digest(b" ".join(words) if words else b"\0" + text)


def digest(text: str = "text"):
    """128 bits by which a text is found again."""
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node, words (their number), bands, sketch (a byte of each component) and th (the digest of the text) of every document."""

    def run(batches):
        for b in chunks(batches, SIGNED_BYTES):
            raw = texts(b)
            words = [folded_words(t) for t in raw]
            signature = sign(words)
            keys = band_keys(signature)
            bytes_ = (mixed(signature.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
            valid = b.column("text").is_valid().to_pylist()
            node = [node_of(t, w) if ok else None for t, w, ok in zip(raw, words, valid)]
            bands = [k if w else None for k, w in zip(keys, words)]
            sketch = [x.tobytes() if w else None for x, w in zip(bytes_, words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node, pa.binary()), pa.array([len(w) for w in words], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), b.column("th")], ["doc_id", "node", "words", "bands", "sketch", "th"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, node binary, words long, bands array<long>, sketch binary, th binary")


class Links:
    """Union-find over the nodes of one task."""

    def __init__(self, labels: list):
        self.parent: dict = {x: x for x in labels}

    def root(self, x):
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def star_links(table: pa.Table) -> pa.Table:
    """Links of a leader with those members it overlaps; one member's words are held at a time."""
    nodes = table.column("node").to_pylist()
    text = table.column("text").cast(pa.binary())
    leader = table.column("leader")[0].as_py()
    bag = lambda i: shingles(folded_words(text[i].as_py() or b""))
    own = bag(nodes.index(leader)) if leader in nodes else None
    found = [] if own is None else [n for i, n in enumerate(nodes) if n != leader and overlap(own, bag(i)) >= THRESHOLD]
    return pa.table({"a": pa.array([leader] * len(found), pa.binary()), "b": pa.array(found, pa.binary())})


def sketch_members(table: pa.Table) -> pa.Table:
    """Members of a pair of tiles whose sketch agrees with one of another component; the largest component is not held against itself."""
    key, comp = table.column("key")[0].as_py(), table.column("comp").to_pylist()
    nodes = table.column("node").to_pylist()
    number = {c: i for i, c in enumerate(dict.fromkeys(comp))}
    of = np.array([number[c] for c in comp])
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(comp), COMPONENTS).T.copy()
    rest = np.flatnonzero(of != np.bincount(of).argmax())
    near = np.zeros(len(comp), np.bool_)
    for lo in range(0, len(rest), 512):
        some = rest[lo : lo + 512]
        agree = np.zeros((len(some), len(comp)), np.uint8)
        for component in sketch:
            agree += component[some][:, None] == component[None, :]
        hit = (agree >= LEAST_AGREE) & (of[some][:, None] != of[None, :])
        near[some] |= hit.any(1)
        near |= hit.any(0)
    found = np.flatnonzero(near).tolist()
    return pa.table({"key": pa.array([key] * len(found), pa.int64()), "node": pa.array([nodes[i] for i in found], pa.binary())})


def tile_links(table: pa.Table) -> pa.Table:
    """Pairs of components that a link joins, of nodes that share a bucket and stand in a pair of tiles."""
    comp = table.column("comp").to_pylist()
    found = []
    if len(set(comp)) > 1:
        alike = overlaps([shingles(folded_words(t or b"")) for t in table.column("text").cast(pa.binary()).to_pylist()]) >= THRESHOLD
        joined = Links(comp)
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike, 1)))):
            if joined.join(comp[i], comp[j]):
                found.append((comp[i], comp[j]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def tile_pairs(placed: DataFrame, size: int, total: int) -> DataFrame:
    """key, t1, t2, node, comp: the members of open buckets, once for each pair of tiles that needs them.

    A tile has ``size`` members and ``total`` of their words at most, about.

    ``placed`` has the members (key, node, words, comp) of all buckets.  The
    members of a bucket's largest component stand in the tiles before all others.
    """
    by_comp = placed.groupBy("key", "comp").agg(
        F.count("*").alias("n"), F.sum("words").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("again"), "node")).alias("x2")
    )
    largest = F.max(F.struct("n", "comp", "w")).alias("main")
    buckets = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), largest)
    # Nodes that agree in several bands make buckets of the same members; one of them is enough.
    buckets = buckets.where("comps > 1").groupBy("n", "w", "x1", "x2").agg(F.min(F.struct("key", "main")).alias("first")).select("n", "w", "first.key", "first.main")
    tiles = lambda n, w: F.greatest(F.ceil(n / F.lit(size)), F.ceil(w / F.lit(total))).cast("int")
    one = (F.col("n") <= size) & (F.col("w") <= total)
    buckets = buckets.select(
        "key",
        F.col("main.comp").alias("main"),
        F.when(one, 0).otherwise(tiles(F.col("main.n"), F.col("main.w"))).alias("m"),
        F.when(one, 1).otherwise(tiles(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w"))).alias("o"),
    )
    rows = placed.join(buckets, "key").withColumn("of_main", (F.col("comp") == F.col("main")) & (F.col("m") > 0))
    at = F.xxhash64("node")
    rows = rows.withColumn("tile", F.when(F.col("of_main"), F.pmod(at, F.greatest("m", F.lit(1)))).otherwise(F.col("m") + F.pmod(at, F.col("o"))).cast("int"))
    every = F.sequence(F.when(F.col("of_main"), F.col("m")).otherwise(0), F.col("m") + F.col("o") - 1)
    alone = (F.col("m") + F.col("o")) == 1
    rows = rows.withColumn("other", F.explode(F.when(alone, F.array(F.lit(0))).otherwise(F.array_remove(every, F.col("tile")))))
    return rows.select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "node", "comp")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, th and comp, the same for all documents of a class; null for null texts."""
    spark = docs.sparkSession
    rows = written(signed(spread(docs)), "signed")
    nodes = rows.where("bands is not null").groupBy("node").agg(F.min(F.struct("th", "doc_id")).alias("at"), F.max("words").alias("words"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    bands = nodes.select("node", "words", F.explode("bands").alias("key"))
    # Buckets of two nodes at least; how often a node meets others says how central it is.
    size = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members, members_path = stored(bands.join(size, "key"), "members")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    leaders = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("lead")).select("key", F.col("lead.node").alias("leader"))
    stars = members.join(leaders, "key").where("node <> leader").select("leader", "node", "words").distinct()
    # By text and id, so that the copies of one text, however many, do not meet to give it.
    by_text = docs.select(F.struct(digest().alias("th"), F.col("doc_id").cast("long").alias("doc_id")).alias("at"), F.col("text").cast("string").alias("text"))

    def with_texts(wanted: DataFrame) -> DataFrame:
        """The wanted rows with the texts of their nodes; each text is looked up once, in one document that has it."""
        need = wanted.select("node").distinct().join(nodes.select("node", "at"), "node")
        found = by_text.join(need.select("at"), "at", "left_semi").dropDuplicates(["at"]).join(need, "at")
        return wanted.join(found.select("node", "text"), "node")

    stars, stars_path = stored(stars, "stars")
    shares = F.greatest(F.count("*") / F.lit(STAR), F.sum("words") / F.lit(STAR_WORDS))
    parts = stars.groupBy("leader").agg(F.ceil(shares).cast("int").alias("parts"))
    dealt = stars.join(parts, "leader").select("leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node")
    heads = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("node"))
    links, links_path = stored(with_texts(dealt.unionByName(heads)).groupBy("leader", "part").applyInArrow(star_links, "a binary, b binary"), "links")

    comp = components(links)
    placed = members.join(comp, "node", "left").select("key", "node", "words", F.coalesce("comp", "node").alias("comp"))
    placed, placed_path = stored(placed, "placed")
    sketches = nodes.select("node", "sketch")
    tiled, tiled_path = stored(tile_pairs(placed, SKETCHES, 1 << 62), "tiles")
    close = tiled.join(sketches, "node").groupBy("key", "t1", "t2").applyInArrow(sketch_members, "key long, node binary").distinct()
    again, again_path = stored(tile_pairs(placed.join(close, ["key", "node"], "left_semi"), TILE, TILE_WORDS), "tiles")
    more, more_path = stored(with_texts(again).groupBy("key", "t1", "t2").applyInArrow(tile_links, "a binary, b binary"), "links")
    # The components that are left to join are nodes of a graph of their own, far smaller than the first.
    joined = components(more).select(F.col("node").alias("found"), F.col("comp").alias("whole"))
    for path in (members_path, stars_path, links_path, placed_path, tiled_path, again_path, more_path):
        release(spark, path)
    named = rows.join(comp, "node", "left").select("doc_id", "th", F.coalesce("comp", "node").alias("found"))
    return named.join(joined, "found", "left").select("doc_id", "th", F.coalesce("whole", "found").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, of every document."""
    named = classes(docs)
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "comp", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept: one of each class stays, that of least doc_id, then of least text hash.

    A document without id gives way to one with an id.  Null texts all stay,
    but for rows that repeat one doc_id.
    """
    named = written(classes(docs), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    kept = named.where("comp is not null").groupBy("comp").agg(first).select("first.doc_id", "first.th")
    kept = kept.unionByName(named.where("comp is null").select("doc_id", "th")).distinct()
    keyed = docs.withColumn(KEY, F.struct(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("th")))
    if named.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates([KEY])
    # A struct that holds a null is itself no null, so rows without id find their key.
    return keyed.join(kept.select(F.struct("doc_id", "th").alias(KEY)), KEY, "left_semi").drop(KEY)
