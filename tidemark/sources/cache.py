"""A read cache of chunk sets: kept in memory, spilled to disk, the least recently used go first."""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .catalog import Catalog, Chunk


class ReadCache:
    """Frames by chunk set, up to ``limit_bytes`` of Parquet; larger sets are read through."""

    def __init__(self, catalog: Catalog, limit_bytes: int = 1 << 30):
        self.catalog, self.limit = catalog, limit_bytes
        self.held: OrderedDict[tuple[str, ...], tuple[DataFrame, int]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, chunks: list[Chunk]) -> DataFrame:
        key = tuple(sorted(c.path for c in chunks))
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][0]
        self.misses += 1
        size = sum(c.bytes for c in chunks)
        rows = self.catalog.rows_of(chunks)
        if size > self.limit:
            return rows
        while self.held and sum(n for _, n in self.held.values()) + size > self.limit:
            self.held.popitem(last=False)[1][0].unpersist()
        self.held[key] = (rows.persist(StorageLevel.MEMORY_AND_DISK), size)
        return rows

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1][0].unpersist()
