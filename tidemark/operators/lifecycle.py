"""Chunk lifecycle: compaction, retention, splitting and downsampling over a catalog.

Whatever is rewritten keeps its shard, its level and the columns that have
statistics; what must keep all its rows is held against the row counts before
one commit replaces the old chunks by the new.
"""

from __future__ import annotations

import time
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate, groupby

from pyspark.sql import DataFrame, functions as F

from ..model import bucket_start, label_columns, to_timestamp, value_column
from ..sources.catalog import HOUR, Catalog, Chunk, Snapshot
from ..sources.leases import Leases
from .rows import split_at, split_point

#: fixed values: small chunks of an hour that are worth merging, and target bytes by level.
LEAST_FILES = 15
TARGET_BYTES = (2 << 30, 10 << 30)
GROWTH = 5
#: Bytes of a file that a rewrite makes, about, and the last level that is merged by itself.
FILE_BYTES, LAST_LEVEL = 512 << 20, 4


def target_bytes(level: int) -> int:
    """Bytes that a group of chunks of a level is gathered to; each further level takes five times more."""
    return TARGET_BYTES[level - 1] if 1 <= level <= 2 else TARGET_BYTES[-1] * GROWTH ** max(0, level - 2)


def grouped(chunks: Iterable[Chunk], key) -> list[tuple]:
    """(key, its chunks in time order), by key."""
    return [(k, list(g)) for k, g in groupby(sorted(chunks, key=lambda c: (key(c), c.order)), key)]


def fresh_groups(chunks: tuple[Chunk, ...], least: int = LEAST_FILES) -> list[list[Chunk]]:
    """Level-0 chunks of a shard that start in the same hour, where there are enough of them."""
    return [g for _, g in grouped((c for c in chunks if c.level == 0), lambda c: (c.shard, (c.low or 0) // HOUR)) if len(g) >= least]


def level_groups(chunks: tuple[Chunk, ...], level: int, target: int | None = None) -> list[list[Chunk]]:
    """Chunks of a level and shard in time order, cut where their bytes reach the target; single ones stay alone."""
    target, out = target_bytes(level) if target is None else target, []
    for _, held in grouped((c for c in chunks if c.level == level), lambda c: c.shard):
        sums, start = [0, *accumulate(c.bytes for c in held)], 0
        while start < len(held):
            stop = bisect_left(sums, sums[start] + target, start + 1)
            out.append(held[start:stop])
            start = stop
    return [g for g in out if len(g) > 1]


def files_for(chunks: list[Chunk]) -> int:
    return max(1, -(-sum(c.bytes for c in chunks) // FILE_BYTES))


def rewritten(catalog: Catalog, group: list[Chunk], rows: DataFrame, level: int, shard: str, files: int | None = None) -> list[Chunk]:
    """The rows as new chunks with the statistics that the group had, in files by bytes."""
    stats = tuple(sorted({c for x in group for c in x.stats})) or ("metric_name",)
    return catalog.write(rows, stats=stats, level=level, shard=shard, files=files or files_for(group))


def compact(catalog: Catalog, group: list[Chunk], files: int | None = None) -> Snapshot:
    """Merges a shard's chunks into time-sorted ones one level up; one commit replaces the old by the new."""
    shards = {c.shard for c in group}
    if len(shards) != 1:
        raise ValueError("a group is of one shard")
    began = time.time()
    new = rewritten(catalog, group, catalog.rows_of(group), max(c.level for c in group) + 1, shards.pop(), files)
    done = catalog.swap(group, new, keeps_rows=True)
    catalog.record("compact", group, new, began)
    return done


def compact_all(catalog: Catalog, least: int = LEAST_FILES, target: int | None = None, owner: str | None = None) -> int:
    """Merges fresh chunks by hour, then each level from the first on; the number of groups merged.

    With an ``owner``, a group is merged under a lease, and one that another owner holds is left to it.
    """
    done, leases = 0, Leases(catalog)
    for level in range(LAST_LEVEL + 1):
        chunks = catalog.snapshot().chunks
        for g in level_groups(chunks, level, target) if level else fresh_groups(chunks, least):
            lease = leases.acquire(f"compact-{g[0].path.rpartition('/')[2]}", owner) if owner else None
            if owner and lease is None:
                continue
            try:
                compact(catalog, g)
            except Exception:
                if lease:
                    leases.finish(lease, "failed")
                raise
            if lease:
                leases.finish(lease, "done")
            done += 1
    return done


def retain(catalog: Catalog, cutoff: int) -> Snapshot:
    """Drops rows before the cutoff: whole chunks by the catalog, the rest of straddling chunks by a rewrite.

    Rows without a time are not before it and stay.
    """
    began, now = time.time(), catalog.snapshot()
    early = [c for c in now.chunks if c.low is not None and c.low < cutoff]
    dead = [c for c in early if c.high < cutoff and not c.timeless]
    cut = [c for c in early if c.high >= cutoff or c.timeless]
    if not early:
        return now
    new = []
    for (level, shard), group in grouped(cut, lambda c: (c.level, c.shard)):
        rows = catalog.rows_of(group, now).where((F.col("timestamp_ns") >= cutoff) | F.col("timestamp_ns").isNull())
        new += rewritten(catalog, group, rows, level, shard)
    done = catalog.swap(dead + cut, new)
    catalog.record("retain", dead + cut, new, began)
    return done


def split_shard(catalog: Catalog, shard: str, left: str, right: str, at: int | None = None) -> Snapshot:
    """Splits a shard at a time into two, in one commit; readers see either all old or all new chunks.

    Rows without a time go to the left; chunks keep their levels.
    """
    began, now = time.time(), catalog.snapshot()
    old = [c for c in now.chunks if c.shard == shard]
    if not old:
        raise ValueError(f"no chunk of shard {shard}")
    timed = [c for c in old if c.low is not None]
    if at is None:
        at = split_point(min(c.low for c in timed), max(c.high for c in timed)) if timed else 0
    new = []
    for level, group in grouped(old, lambda c: c.level):
        sides = split_at(catalog.rows_of(group, now), at)
        for side, name in (("left", left), ("right", right)):
            rows = sides.where(F.coalesce("side", F.lit("left")) == side).drop("side")
            new += rewritten(catalog, group, rows, level, name)
    done = catalog.swap(old, new, keeps_rows=True)
    catalog.record("split", old, new, began)
    return done


def downsampled(metrics: DataFrame, width: int = 60_000_000_000) -> DataFrame:
    """One row for each series and bucket: mean, least, greatest, newest value and count."""
    labels = label_columns(metrics)
    v = value_column(metrics)
    rows = metrics.select(bucket_start(F.col("timestamp_ns"), width).alias("bucket"), "timestamp_ns", "metric_name", *labels, v.alias("v"))
    return rows.groupBy("bucket", "metric_name", *labels).agg(
        F.avg("v").alias("avg_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.max_by("v", F.struct("timestamp_ns", "v")).alias("last_value"), F.count("v").alias("samples")
    )


def partitioned_write(metrics: DataFrame, path: str, tenant: str = "default", files_per_hour: int = 1) -> None:
    """Appends rows under tenant/year/month/day/hour of the event, so that time filters prune folders.

    Rows are spread by hour and a hash, so a busy hour goes to ``files_per_hour`` writers.
    """
    at = to_timestamp(F.col("timestamp_ns"))
    parts = {"tenant": F.lit(tenant), "year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at)}
    salt = F.pmod(F.xxhash64("timestamp_ns", "metric_name"), F.lit(files_per_hour))
    rows = metrics.withColumns(parts)
    rows.repartition(F.col("year"), F.col("month"), F.col("day"), F.col("hour"), salt).sortWithinPartitions("timestamp_ns").write.mode("append").option("compression", "zstd").partitionBy(*parts).parquet(path)
