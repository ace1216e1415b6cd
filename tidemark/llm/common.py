"""Helpers shared by the corpus operators: shared folders, bounded batches, words.

Every operator reads its rows through Spark and hands Python at most
``CHUNK_BYTES`` of text at a time, so memory does not follow the size of a
partition.  Python workers keep bounded caches only.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes handed to one step of a Python operator.
CHUNK_BYTES = 4 << 20

#: Longer words are not kept in caches, so that entries bound the memory.
CACHED_LENGTH = 64

#: Lower-cases A-Z, keeps 0-9 and a-z and every byte from 0x80, turns the rest into a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def folded_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(FOLD).split()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def spread(df: DataFrame) -> DataFrame:
    """A partition for each core at least: a table in a few row groups would leave the others idle.

    Only tables smaller than the cluster move; larger ones pass as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(root)
    return root


#: Folders made inside each open ``scratch`` block, the innermost last.
_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the folders that operators make inside the block, but for those that the caller takes out of the list.

    What an operator returns may still read its folders: write the result before the block ends.
    """
    _MADE.append(made := [])
    try:
        yield made
    finally:
        _MADE.remove(made)
        for path in made:
            release(spark, path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared folder."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written to the shared folder and read again, and where: lineage ends there.

    Spark deletes shuffle files when the driver has collected the plans that wrote them, so the plans of
    steps that are over are collected before the next one writes its own.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def release(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator wrote and no plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def chunks(batches, limit: int = CHUNK_BYTES, column: str = "text"):
    """Slices of record batches that hold at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def by_text(of: Callable[[list[bytes]], pa.Array], kind: str) -> Callable:
    """A Column function of a text column; ``of`` gets at most ``CHUNK_BYTES`` of texts at a time, null as empty.

    Only the text travels to Python, whatever else the rows hold.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [of(texts(b)) for b in chunks([batch])]
            yield pa.concat_arrays(parts) if parts else of([])
        give_back()

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Not so, but an expression that the optimizer takes for deterministic is computed again for each use.
    return lambda column: F.arrow_udf(run, kind).asNondeterministic()(column.cast("string"))


def give_back() -> None:
    """Hands memory that this worker has freed to the system: workers outlive their tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable) -> Callable:
    """A function of batches that gives its memory back at the end of the task."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def text_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Only the columns an operator reads, under their own names: other columns never reach Python."""
    return df.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("text"))
