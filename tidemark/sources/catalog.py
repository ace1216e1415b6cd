"""The chunk catalog: a small versioned table of immutable Parquet chunks.

A version is one file ``_catalog/v<number>`` of JSON lines that holds what the
version changed: chunks added and removed, the schema, and the last batch of
each stream that wrote.  Every ``CHECKPOINT`` versions the whole list is
written beside it as ``c<number>``, so a commit costs its own changes and a
reader a few small files.  A version is published by an operation that creates
a file with all its bytes or fails if the file is there, so of two writers one
retries and none is lost.  A reader holds one version: chunks it lists stay
until ``vacuum`` finds that no kept version lists them, which is what pinning
is for elsewhere.  Entries are bounded by the number of chunks, not of rows.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..model import SECOND, empty_metrics
from ..operators.predicates import Stats, time_range

HOUR = 3600 * SECOND
#: fixed values: attempts of a commit, and seconds before the second one (doubling).
ATTEMPTS, BACKOFF = 5, 0.1
#: Versions between two full lists.
CHECKPOINT = 16
#: Schemes of stores that publish a file by one conditional put.
OBJECT_STORES = ("s3a", "s3", "gs", "abfs", "abfss", "oss", "cosn")


class Conflict(RuntimeError):
    """Another writer committed first, again and again."""


@dataclass(frozen=True)
class Chunk:
    """A file with the range of its times (None if no row has one) and how many rows have none."""

    path: str
    low: int | None
    high: int | None
    rows: int
    bytes: int = 0
    level: int = 0
    shard: str = ""
    stats: dict[str, list] = field(default_factory=dict)
    timeless: int = 0

    @property
    def order(self) -> tuple:
        return self.low is None, self.low or 0, self.path

    def overlaps(self, low: int | None, high: int | None) -> bool:
        """Closed ranges that share a time; rows without one are in the range without bounds only."""
        if self.low is None:
            return low is None and high is None
        return (high is None or self.low <= high) and (low is None or self.high >= low)

    def may_match(self, predicate: Any) -> bool:
        known = {c: Stats(*s) for c, s in self.stats.items()} | {"timestamp_ns": Stats(self.low, self.high, self.timeless > 0)}
        return predicate is None or predicate.may_match(known)


@dataclass(frozen=True)
class Snapshot:
    version: int
    chunks: tuple[Chunk, ...]
    schema: StructType | None = None
    #: The last batch of each stream that appended.
    writers: dict[str, int] = field(default_factory=dict)

    def prune(self, predicate: Any = None, low: int | None = None, high: int | None = None) -> list[Chunk]:
        """Chunks that can hold matching rows, by least time."""
        if predicate is not None:
            a, b = time_range(predicate)
            low = a if low is None else low if a is None else max(a, low)
            high = b if high is None else high if b is None else min(b, high)
        return sorted((c for c in self.chunks if c.overlaps(low, high) and c.may_match(predicate)), key=lambda c: c.order)

    def lines(self) -> Iterable[dict]:
        yield {"version": self.version, "schema": self.schema and json.loads(self.schema.json()), "writers": self.writers}
        yield from ({"version": self.version, "add": asdict(c)} for c in self.chunks)

    def after(self, lines: Iterable[dict]) -> Snapshot:
        """The snapshot that the lines of the next version make of this one."""
        chunks, schema, writers, version = {c.path: c for c in self.chunks}, self.schema, self.writers, self.version
        for x in lines:
            version = x.get("version", version)
            if x.get("schema"):
                schema = StructType.fromJson(x["schema"])
            writers = writers | (x.get("writers") or {})
            if "add" in x:
                chunks[x["add"]["path"]] = Chunk(**x["add"])
            chunks.pop(x.get("remove"), None)
        return Snapshot(version, tuple(chunks.values()), schema, writers)


def united(a: StructType | None, b: StructType | None) -> StructType | None:
    """The columns of both schemas, all nullable; a column has one type."""
    out = {f.name: f for f in (a.fields if a else [])}
    for f in b.fields if b else []:
        if f.name in out and out[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {out[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        out.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType(list(out.values())) if out else None


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- files ------------------------------------------------------------------

    def listed(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def load(self, name: str) -> list[dict]:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return [json.loads(x) for x in text.splitlines() if x]

    def put(self, name: str, lines: Iterable[dict]) -> bool:
        """Creates a file with all its bytes; False, and no change, if there is one of that name."""
        target, body = self._path(f"{self.root}/{name}"), "".join(json.dumps(x) + "\n" for x in lines).encode()
        scheme, jvm = self._fs.getUri().getScheme(), self.spark._jvm
        if self._fs.exists(target):
            return False
        store = scheme in OBJECT_STORES
        held = target if store else self._path(f"{self.root}/_catalog/.{uuid.uuid4().hex}")
        try:
            # ``must``: a store without conditional puts refuses instead of losing a commit.
            stream = self._fs.createFile(held).overwrite(False).must("fs.option.create.conditional.overwrite", True).build() if store else self._fs.create(held, False)
            stream.write(bytearray(body))
            stream.close()
            if scheme == "file":
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                self._fs.mkdirs(target.getParent())
                jvm.java.nio.file.Files.createLink(local(target), local(held))
            elif not store:
                never = self.spark.sparkContext._gateway.new_array(kind := getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
                never[0] = kind.NONE
                self._fs.mkdirs(target.getParent())
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(held, target, never)
            return True
        except Py4JJavaError:
            if self._fs.exists(target):
                return False
            raise
        finally:
            if not store:
                self._fs.delete(held, False)

    # -- versions -------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted({int(n[1:]) for n in self.listed("_catalog") if n[:1] in "vc" and n[1:].isdigit()})

    def snapshot(self, version: int | None = None) -> Snapshot:
        names = self.listed("_catalog")
        numbers = lambda kind: {int(n[1:]) for n in names if n[:1] == kind and n[1:].isdigit()}
        full, changes = numbers("c"), numbers("v")
        if not full and not changes:
            return Snapshot(0, ())
        version = max(full | changes) if version is None else version
        base = max((n for n in full if n <= version), default=0)
        now = Snapshot(0, ()).after(self.load(f"_catalog/c{base}")) if base else Snapshot(0, ())
        for n in range(base + 1, version + 1):
            now = now.after(self.load(f"_catalog/v{n}"))
        return now

    def commit(self, change: Callable[[tuple[Chunk, ...]], Iterable[Chunk]], schema: StructType | None = None, writer: tuple[str, int] | None = None, live: bool = False) -> Snapshot:
        """Applies ``change(chunks) -> chunks`` to the newest version; retried if another writer was first.

        A batch of a writer that has been committed before changes nothing.
        ``live``: what is added are new rows, which tails deliver.
        """
        for attempt in range(ATTEMPTS):
            now = self.snapshot()
            if writer and now.writers.get(writer[0], -1) >= writer[1]:
                return now
            chunks = tuple(change(now.chunks))
            new = Snapshot(now.version + 1, chunks, united(now.schema, schema), now.writers | ({writer[0]: writer[1]} if writer else {}))
            have, kept = {c.path: c for c in now.chunks}, {c.path for c in chunks}
            lines = [next(iter(new.lines()))]
            lines += [{"version": new.version, "add": asdict(c), "live": live} for c in chunks if have.get(c.path) != c]
            lines += [{"version": new.version, "remove": p} for p in have if p not in kept]
            if self.put(f"_catalog/v{new.version}", lines):
                if new.version % CHECKPOINT == 0:
                    self.put(f"_catalog/c{new.version}", new.lines())
                return new
            time.sleep(BACKOFF * 2**attempt)
        raise Conflict(f"no commit after {ATTEMPTS} attempts")

    # -- data -----------------------------------------------------------------

    def write(self, rows: DataFrame, stats: tuple[str, ...] = ("metric_name",), level: int = 0, shard: str = "", files: int | None = None, codec: str = "zstd") -> list[Chunk]:
        """Writes rows as chunks sorted by time, and returns them unregistered, with statistics from the files' footers.

        Rows without a time are written like all others; their number is kept with the chunk.
        """
        folder = f"{self.root}/data/{level}-{urllib.parse.quote(shard, safe='')}/{uuid.uuid4().hex}"
        rows = rows.repartitionByRange(files, "timestamp_ns") if files else rows
        rows.sortWithinPartitions("timestamp_ns").write.option("compression", codec).parquet(folder)
        return self.scan(folder, stats, level, shard)

    def scan(self, folder: str, stats: tuple[str, ...] = ("metric_name",), level: int = 0, shard: str = "") -> list[Chunk]:
        """Chunks for the Parquet files of a folder, from the footers alone: no row is read again."""
        jvm, statuses = self.spark._jvm, self.spark._jvm.java.util.ArrayList()
        files = self._fs.listFiles(self._path(folder), True)
        sizes = {}
        while files.hasNext():
            status = files.next()
            if status.getPath().getName().endswith(".parquet"):
                statuses.add(status)
                sizes[status.getPath().toString()] = status.getLen()
        out = []
        for footer in jvm.org.apache.parquet.hadoop.ParquetFileReader.readAllFootersInParallel(self._conf, statuses):
            rows, bounds = 0, {}
            for block in footer.getParquetMetadata().getBlocks():
                rows += block.getRowCount()
                for column in block.getColumns():
                    name = column.getPath().toDotString()
                    if name == "timestamp_ns" or name in stats:
                        bounds.setdefault(name, []).append(block_bounds(column))
            if not rows:
                continue
            low, high, _, timeless = gathered(bounds.pop("timestamp_ns", [(None, None, rows, rows)]))
            path = footer.getFile().toString()
            out.append(Chunk(path, low, high, rows, sizes[path], level, shard, {c: [lo, hi, nulls > 0] for c, parts in bounds.items() for lo, hi, _, nulls in [gathered(parts)]}, timeless))
        return sorted(out, key=lambda c: c.order)

    def rebuild(self, stats: tuple[str, ...] = ("metric_name",)) -> Snapshot:
        """A version made from the data files alone, for a catalog that is lost.

        Levels and shards come from the folders' names.  Files that a swap has replaced come back
        if ``vacuum`` has not deleted them.
        """
        found = []
        for place in self.listed("data"):
            level, _, shard = place.partition("-")
            found += self.scan(f"{self.root}/data/{place}", stats, int(level), urllib.parse.unquote(shard))
        schema = self.spark.read.option("mergeSchema", True).parquet(*[c.path for c in found]).schema if found else None
        return self.commit(lambda _: found, schema)

    def register(self, chunks: list[Chunk], schema: StructType | None = None, writer: tuple[str, int] | None = None) -> Snapshot:
        return self.commit(lambda have: [*have, *chunks], schema, writer, live=True)

    def append(self, rows: DataFrame, writer: tuple[str, int] | None = None, **options) -> Snapshot:
        """Writes and registers rows; ``writer`` names a stream and its batch, which is appended once however often it comes."""
        now = self.snapshot()
        if writer and now.writers.get(writer[0], -1) >= writer[1]:
            return now
        united(now.schema, rows.schema)  # a type that does not fit fails before anything is written
        return self.register(self.write(rows, **options), rows.schema, writer)

    def unregister(self, paths: set[str]) -> Snapshot:
        return self.commit(lambda have: [c for c in have if c.path not in paths])

    def swap(self, old: list[Chunk], new: list[Chunk], keeps_rows: bool = False) -> Snapshot:
        """Replaces chunks in one commit; fails if one of them is gone, or if rows that must stay are missing."""
        gone = {c.path for c in old}
        before, after = sum(c.rows for c in old), sum(c.rows for c in new)
        if keeps_rows and before != after or after > before:
            raise ValueError(f"{before} rows became {after}; nothing is replaced")

        def change(have):
            if len(gone & {c.path for c in have}) < len(gone):
                raise Conflict("a chunk to replace is gone")
            return [*(c for c in have if c.path not in gone), *new]

        return self.commit(change)

    # -- reading ----------------------------------------------------------------

    def schema(self) -> StructType:
        return self.probe().schema

    def rows_of(self, chunks: list[Chunk], snapshot: Snapshot | None = None) -> DataFrame:
        """All rows of some chunks, under the table's schema."""
        schema = (snapshot or self.snapshot()).schema
        if not chunks:
            return self.spark.createDataFrame([], schema) if schema else empty_metrics(self.spark)
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", True)
        return reader.parquet(*[c.path for c in chunks])

    def probe(self) -> DataFrame:
        """A frame over one chunk, to plan a query with before it is known which chunks it needs."""
        now = self.snapshot()
        return self.rows_of(list(now.chunks[:1]), now)

    def probe_path(self, snapshot: Snapshot) -> str | None:
        return self._path(snapshot.chunks[0].path).toString() if snapshot.chunks else None

    def read(self, predicate: Any = None, snapshot: Snapshot | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
        """Rows of the chunks that may match, filtered; Parquet prunes row groups by the same filter."""
        now = snapshot or self.snapshot()
        rows = self.rows_of(now.prune(predicate, low, high), now)
        if low is not None:
            rows = rows.where(F.col("timestamp_ns") >= low)
        if high is not None:
            rows = rows.where(F.col("timestamp_ns") <= high)
        return rows if predicate is None else rows.where(predicate.rows())

    def chunk_table(self, name_of: Chunk) -> str:
        """A temporary view of one chunk, named after its path."""
        name = "t" + "".join(c if c.isalnum() else "_" for c in name_of.path)
        self.spark.read.parquet(name_of.path).createOrReplaceTempView(name)
        return name

    def as_frame(self) -> DataFrame:
        rows = [(c.path, c.low, c.high, c.rows, c.bytes, c.level, c.shard, c.timeless) for c in self.snapshot().chunks]
        return self.spark.createDataFrame(rows, "path string, low long, high long, rows long, bytes long, level int, shard string, timeless long")

    def vacuum(self, keep_versions: int = 2, grace_seconds: float = 300) -> list[str]:
        """Deletes data files that no kept version lists and that are older than the grace time."""
        found = self.versions()
        if not found:
            return []
        oldest = found[-keep_versions:][0]
        self.put(f"_catalog/c{oldest}", self.snapshot(oldest).lines())
        plain = lambda p: self._path(p).toUri().getPath()
        kept = {plain(c.path) for v in found[-keep_versions:] for c in self.snapshot(v).chunks}
        out, root = [], self._path(f"{self.root}/data")
        if not self._fs.exists(root):
            return out
        files = self._fs.listFiles(root, True)
        while files.hasNext():
            status = files.next()
            path = status.getPath().toString()
            old = time.time() - status.getModificationTime() / 1000 >= grace_seconds
            if path.endswith(".parquet") and old and plain(path) not in kept:
                self._fs.delete(status.getPath(), False)
                out.append(path)
        for name in self.listed("_catalog"):
            if name[:1] in "vc" and name[1:].isdigit() and int(name[1:]) < oldest:
                self._fs.delete(self._path(f"{self.root}/_catalog/{name}"), False)
        return out

    # -- jobs -------------------------------------------------------------------

    def record(self, kind: str, old: list[Chunk], new: list[Chunk], began: float, status: str = "done") -> None:
        """Logs a job of the lifecycle."""
        entry = {"job": uuid.uuid4().hex, "kind": kind, "sources": len(old), "targets": len(new), "rows": sum(c.rows for c in old), "shards": sorted({c.shard for c in old}), "began": began, "ended": time.time(), "status": status}
        self.put(f"_catalog/jobs/{entry['job']}", [entry])

    def jobs(self) -> DataFrame:
        rows = [x for n in self.listed("_catalog/jobs") for x in self.load(f"_catalog/jobs/{n}")]
        return self.spark.createDataFrame(rows, "job string, kind string, sources long, targets long, rows long, shards array<string>, began double, ended double, status string")

    def expire_jobs(self, older_than: float) -> int:
        """Deletes entries of jobs that ended before a time."""
        gone = [n for n in self.listed("_catalog/jobs") if all(x["ended"] < older_than for x in self.load(f"_catalog/jobs/{n}"))]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/_catalog/jobs/{n}"), False)
        return len(gone)


def block_bounds(column) -> tuple[Any, Any, int, int | None]:
    """Least and greatest value, number of values and of nulls of a column in a row group; None if unknown."""
    s, n = column.getStatistics(), column.getValueCount()
    nulls = s.getNumNulls() if s is not None and s.isNumNullsSet() else None
    if s is None or not s.hasNonNullValue():
        return None, None, n, nulls
    return plain_value(s.genericGetMin()), plain_value(s.genericGetMax()), n, nulls


def plain_value(v: Any) -> Any:
    return v if isinstance(v, (int, float, str)) else v.toStringUsingUTF8() if hasattr(v, "toStringUsingUTF8") else None


def gathered(parts: list[tuple]) -> tuple[Any, Any, int, int]:
    """The bounds of all row groups; unknown if those of one are, unless it holds nulls only."""
    known = [p for p in parts if not (p[0] is None and p[3] == p[2])]
    n, nulls = sum(p[2] for p in parts), sum(p[2] if p[3] is None else p[3] for p in parts)
    if not known or any(p[0] is None for p in known):
        return None, None, n, nulls
    return min(p[0] for p in known), max(p[1] for p in known), n, nulls


def with_level(chunks: list[Chunk], level: int) -> list[Chunk]:
    return [replace(c, level=level) for c in chunks]
