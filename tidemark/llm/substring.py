"""Operator 9, substring deduplication: Rabin-Karp hashes of every fixed-length word window.

1. Documents are dealt into parts, ascending ranges of (doc_id, text hash) with
   near equal bytes.  Each part hashes all its windows, drops repeats inside
   the part and sends the sorted hashes, packed, to the buckets of their ranges.
2. A bucket counts each hash over the parts.  The first part that has a hash
   keeps it; every later one gets the hash back.
3. Parts and answers meet.  A window is repeated if its hash came back or the
   same hash starts earlier in the part; repeated windows merge into maximal
   intervals, whose words are removed.

A part's hashes are distinct, so a passage that stands in a third of all
documents sends one hash from each part: no bucket is hot.  Parts are cut by
the doc_id and then by the text, so rows without id, or with one id, are no
hot part either.  The shuffles carry the texts once and about ten bytes for
each distinct window of a part.  Parts and buckets are of fixed size until
their messages would fall below ``MESSAGE_BYTES``; from there (1 TB) they grow
with the square root of the input, so messages follow the bytes, not their square.

Hashes are two polynomials over 64-bit word hashes, of 64 and 32 bits: two
different windows agree with a chance of about 2^-90, 10^-9 for all pairs of
30 GB of text.

Defined cases: null and empty texts have no words, and texts of fewer words
than a window lose none; a very long text is a part of its own, if it is larger
than one; rows with the same doc_id stand in the order of a hash of their
texts, equal texts in any order (their results differ only in which one comes
first); a null doc_id stands before all others; an empty table gives no rows;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import CACHED_LENGTH, give_back, text_rows, texts

#: Entries of a worker's cache of word hashes before it is emptied.
CACHE_ENTRIES = 1 << 17
#: UTF-8 bytes of text in a part and of hashes in a bucket, about; the least bytes of a part in a small table.
PART_BYTES, BUCKET_BYTES, LEAST_PART = 16 << 20, 24 << 20, 2 << 20
#: Bytes of hashes for a byte of text, about, and the least bytes of a message from a part to a bucket.
HASH_SHARE, MESSAGE_BYTES = 2, 512
#: Sampled rows for each part bound, by size.
SAMPLES = 24
#: The polynomials' bases, 5 modulo 8: their powers differ in as many low bits as odd bases can.
BASE, SECOND_BASE = 0x9E3779B97F4A7C15 & ~7 | 5, 0xD1B54A32D192ED03 & ~7 | 5
#: Text bytes whose words are held at a time.
WORDS_BYTES = 4 << 20
GOLDEN, MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_LENGTH:
            self[word] = h
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """The Rabin-Karp hash of each run of ``width`` words: sum of h[i + k] * base ** (width - 1 - k).

    Runs of doubled length are put together by the binary digits of the width.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    out, done, part, size = None, 0, hashes, 1
    while True:
        if width & size:
            out = part if out is None else part[: len(part) - done] * power(done) + out[size:][: len(part) - done]
            done += size
        if done == width:
            return mixed(out[:n])
        part = part[:-size] * power(size) + part[size:]
        size *= 2


def packed(values: np.ndarray, extra: np.ndarray) -> bytes:
    """Sorted 64-bit values as their differences, the low bytes of all first, and 32 more bits of each."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() + extra.astype("<u4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = data[0]
    n = (len(data) - 1) // (width + 4)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, width * n, 1).reshape(width, n).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64), np.frombuffer(data, "<u4", n, 1 + width * n)


def hash_order(hashes: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the windows by both hashes, equal ones as they stand; the first hashes in order; which equal the one before.

    Sorted by the first hash alone; only where that is shared by different windows, which hardly ever
    happens, the second one orders too.
    """
    order = np.argsort(hashes, kind="stable")
    ascending, more = hashes[order], extra[order]
    same = np.r_[False, ascending[1:] == ascending[:-1]] if len(order) else np.zeros(0, np.bool_)
    if (same & np.r_[False, more[1:] != more[:-1]]).any() if len(order) else False:
        order = np.lexsort((extra, hashes))
        ascending, more = hashes[order], extra[order]
        same = np.r_[False, (ascending[1:] == ascending[:-1]) & (more[1:] == more[:-1])]
    return order, ascending, same


def part_windows(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of all windows of a part's documents, how many each document has, and its number of words.

    Words are held for a few megabytes of text at a time, their hashes for all of it.
    """
    first, second, size = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], []
    at = 0
    while at < len(raw):
        to, held = at, 0
        while to < len(raw) and (to == at or held + len(raw[to]) <= WORDS_BYTES):
            held += len(raw[to])
            to += 1
        words = [t.split() for t in raw[at:to]]
        n = np.array([len(w) for w in words], np.int64)
        hashes = word_hashes(list(chain.from_iterable(words)))
        left = np.repeat(np.cumsum(n), n)[: max(0, len(hashes) - width + 1)] - np.arange(max(0, len(hashes) - width + 1))  # words to the end of the document
        inside = left >= width
        first.append(window_hashes(hashes, width)[inside])
        second.append((window_hashes(hashes, width, SECOND_BASE)[inside] >> np.uint64(32)).astype(np.uint32))
        size.append(n)
        at = to
    size = np.concatenate([np.empty(0, np.int64), *size])
    return np.concatenate(first), np.concatenate(second), np.maximum(size - width + 1, 0), size


def in_order(table: pa.Table) -> pa.Table:
    """Documents by doc_id, null first, then by a hash of the text, then by the text."""
    return table.sort_by([("key", "ascending"), ("h", "ascending"), ("text", "ascending")])


def raw_texts(table: pa.Table) -> list[bytes]:
    return texts(table.combine_chunks().to_batches()[0]) if table.num_rows else []


def repeated_intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal word intervals covered by windows at the given ascending starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + width).tolist()))


def places(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Pairs of 64-bit numbers as 16 bytes that sort as the pairs do."""
    wide = np.empty((len(key), 2), ">u8")
    wide[:, 0], wide[:, 1] = (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for x in (key, h))
    return wide.view("S16").ravel()


def layout(total: int, cores: int, part_bytes: int | None = None) -> tuple[int, int]:
    """Numbers of parts and of buckets for so many bytes of text."""
    grown = isqrt(total * MESSAGE_BYTES)
    small = max(LEAST_PART, total // cores + 1)
    parts = -(-total // (part_bytes or min(max(PART_BYTES, grown), small)))
    return max(1, parts), max(1, min(parts, 3 * cores), -(-total * HASH_SHARE // max(BUCKET_BYTES, grown)))


def part_bounds(rows: DataFrame, total: int, parts: int) -> np.ndarray:
    """Bounds that cut (key, h) into parts of near equal bytes, from a sample by size.

    The driver gets about ``SAMPLES`` rows for each part, as Arrow columns.
    """
    rate = SAMPLES * parts / max(1, total)
    chance = F.shiftrightunsigned(F.xxhash64("key", "h", F.lit("sample")), 11) / F.lit(float(1 << 53))
    drawn = rows.select("key", "h", F.floor(F.col("size") * F.lit(rate) + chance).alias("n")).where("n > 0").toArrow()
    at = places(drawn.column("key").to_numpy(), drawn.column("h").to_numpy())
    order = np.argsort(at)
    weight = np.cumsum(drawn.column("n").to_numpy()[order])
    if not len(weight):
        return at
    return np.unique(at[order[np.minimum(np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts), len(order) - 1)]])


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions a number that Spark's hash deals to it, so that n keys fill n partitions."""
    tried = 16 * n + 64
    while True:
        found = spark.range(tried).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("to")).groupBy("to").agg(F.min("id").alias("id")).collect()
        if len(found) == n:
            return np.array([r.id for r in sorted(found, key=lambda r: r.to)], np.int32)
        tried *= 2


def repeated(docs: DataFrame, width: int = 20, part_bytes: int | None = None, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the words kept, joined by blanks) of every document."""
    spark = docs.sparkSession
    rows = text_rows(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("h"), "text")
    sized = rows.select("key", "h", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts, buckets = layout(total, spark.sparkContext.defaultParallelism, part_bytes)
    bounds = part_bounds(sized, total, parts) if parts > 1 else np.empty(0, "S16")
    parts = len(bounds) + 1
    part_keys, bucket_keys = even_keys(spark, parts), even_keys(spark, buckets)
    step = (1 << 64) // buckets + 1
    cuts_at = np.array([min(i * step, (1 << 64) - 1) for i in range(1, buckets)], np.uint64)

    @F.arrow_udf("int")
    def part_of(key: pa.Array, h: pa.Array) -> pa.Array:
        rank = np.searchsorted(bounds, places(key.to_numpy(), h.to_numpy()), "right") if len(bounds) else np.zeros(len(key), np.int64)
        return pa.array(part_keys[rank], pa.int32())

    rank_of = {int(k): i for i, k in enumerate(part_keys)}
    rows = rows.withColumn("part", part_of("key", "h")).repartition(parts, "part")

    def send(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        first, second, _, _ = part_windows(raw_texts(table), width)
        order, ascending, same = hash_order(first, second)
        ascending, more = ascending[~same], second[order[~same]]
        cuts = [0, *np.searchsorted(ascending, cuts_at).tolist(), len(ascending)]
        full = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        out = pa.table({"bucket": pa.array([int(bucket_keys[i]) for i, _, _ in full], pa.int32()), "part": pa.array([part] * len(full), pa.int32()), "hashes": pa.array([packed(ascending[a:b], more[a:b]) for _, a, b in full], pa.binary())})
        del first, second, order, ascending, more
        give_back()
        return out

    def count(table: pa.Table) -> pa.Table:
        keys, data = table.column("part").to_pylist(), table.column("hashes").to_pylist()
        at = sorted(range(len(keys)), key=lambda i: rank_of[keys[i]])
        got = [unpacked(data[i]) for i in at]
        owner = np.repeat(np.array(at, np.int32), [len(h) for h, _ in got])
        first, second = (np.concatenate([x[k] for x in got]) for k in (0, 1))
        del got
        order, ascending, same = hash_order(first, second)  # equal hashes stay in the order of their parts
        order, ascending = order[same], ascending[same]
        owner, second = owner[order], second[order]
        by = np.argsort(owner, kind="stable")
        edge = np.flatnonzero(np.diff(owner[by], prepend=-1))
        out = [(keys[int(owner[by[a]])], by[a:b]) for a, b in zip(edge, [*edge[1:], len(by)])]
        answer = pa.table({"part": pa.array([k for k, _ in out], pa.int32()), "hashes": pa.array([packed(ascending[x], second[x]) for _, x in out], pa.binary())})
        give_back()
        return answer

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = in_order(docs)
        raw = raw_texts(docs)
        first, second, n, n_words = part_windows(raw, width)
        order, ascending, same = hash_order(first, second)
        gone = np.zeros(len(first), np.bool_)
        gone[order[same]] = True  # all but the first of equal hashes
        for data in answers.column("hashes").to_pylist():
            known, more = unpacked(data)
            lo, hi = np.searchsorted(ascending, known), np.searchsorted(ascending, known, "right")
            one = hi - lo == 1
            hit = order[lo[one]]
            gone[hit[second[hit] == more[one]]] = True
            for a, b, x in zip(lo[~one].tolist(), hi[~one].tolist(), more[~one].tolist()):
                hit = order[a:b]
                gone[hit[second[hit] == x]] = True
        del first, second, order, ascending
        ends = np.cumsum(n)
        out = []
        for t, lo, hi, words in zip(raw, (ends - n).tolist(), ends.tolist(), n_words.tolist()):
            spans = repeated_intervals(np.flatnonzero(gone[lo:hi]), width)
            w = t.split()
            kept = w if not spans else list(chain(*(w[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(w)]))))
            data = b" ".join(kept)
            out.append((words, words - len(kept), hashlib.sha256(data).hexdigest(), data if keep_text else None))
        columns = list(zip(*out)) or [()] * 4
        found = {"doc_id": docs.column("doc_id").cast(pa.int64()), "n_words": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "kept_sha256": pa.array(columns[2], pa.string())}
        give_back()
        return pa.table(found | {"kept": pa.array(columns[3], pa.binary()).cast(pa.string())} if keep_text else found)

    sent = rows.groupBy("part").applyInArrow(send, "bucket int, part int, hashes binary")
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, "part int, hashes binary")
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
