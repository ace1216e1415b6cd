"""Operator 3, binary token output: flat unsigned integers and 64-bit document offsets.

A part is three files, all little-endian.  ``*.bin`` holds the token ids of its
documents one after the other, 16 bits wide if the vocabulary fits, else 32.
``*.off`` holds n + 1 offsets in tokens and ``*.ids`` the n document ids, as
64-bit integers; n follows from the files' sizes, so all three are written as
the tokens come.  Parts hold ascending ranges of doc_id; the manifest lists the
parts that committed with the prefix sums of their token counts, so a part's
base is known without reading others.

Parts follow the table's size, not the session's partitions.  A task writes
under a name of its own attempt; only the names that successful tasks return
enter the manifest, so a lost executor leaves unread files at most.

Defined cases: null and empty texts hold the end id only; very long texts are
encoded whole; a null doc_id comes first and is stored as the least 64-bit
integer; documents of one doc_id stand in the order of a hash of their texts,
equal ones as they come, and may fill several parts; an empty table gives no
parts; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import CACHED_LENGTH, chunks, shared_folder, text_rows, tidied

#: Entries of a worker's word cache before it is emptied.
CACHE_ENTRIES = 700_000
#: Bytes of the table in a part, about, and parts at most.
PART_BYTES, MOST_PARTS = 16 << 20, 1 << 18
#: Token bytes gathered before they go to the file.
WRITE_BYTES = 4 << 20
NULL_ID = -(1 << 63)
#: Marks that end a word and that the pre-tokenizer always parts from letters.
ENDS = ".,!?;:"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        scheme, rest = uri.split(":", 1)
        if scheme == "file":
            return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


class WordIds(dict):
    """Token ids, as bytes, of a part of a text between blanks; a miss asks the tokenizer."""

    def __init__(self, path: str, width: int):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = f"<u{width}"
        self.stems: dict[str, bytes] = {}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def stem(self, text: str) -> bytes:
        out = self.stems.get(text)
        if out is None:
            if len(self.stems) >= CACHE_ENTRIES:
                self.stems.clear()
            out = self.encoded(text)
            if len(text) <= CACHED_LENGTH:
                self.stems[text] = out
        return out

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        body = word.rstrip(ENDS)
        if body.isascii() and body.isalpha():  # letters, then marks: two pre-tokens for certain
            out = self.stem(body.lower()) + (self.stem(word[len(body) :]) if len(body) < len(word) else b"")
        else:
            out = self.encoded(word) if word else b""
        if len(word) <= CACHED_LENGTH:
            self[word] = out
        return out


class SplitEncoder:
    """Encodes texts with a tokenizer that lower-cases and drops white space.

    Such a tokenizer never joins what a blank parts, so the parts between
    blanks are encoded by the library once each and put together again.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = 2 if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) < 1 << 16 else 4
        self.words = WordIds(path, self.width)
        steps = spec.get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [steps])
        normal = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}])
        self.splits = any(s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed" for s in steps) and any(s.get("type") == "Lowercase" for s in normal)

    def encode(self, text: str) -> bytes:
        if not self.splits:
            return self.words.encoded(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, SplitEncoder] = {}


def encoder(path: str) -> SplitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SplitEncoder(path)
    return _ENCODERS[path]


@dataclass(frozen=True)
class Manifest:
    """What was written: folder, id width in bytes, and (name, base, tokens, documents) of each part in order."""

    folder: str
    width: int
    parts: list[tuple[str, int, int, int]]


def part_count(docs: DataFrame) -> int:
    """Parts for a table by the size that its source states, and one for each core at least."""
    stated = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_PARTS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-stated // PART_BYTES)))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, parts: int | None = None) -> Manifest:
    """Encodes every text, appends ``end_id`` and writes the parts in ascending doc_id order.

    One range shuffle of the texts.  The driver gets one row for each part.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")

    def run(batches):
        enc = encoder(tokenizer)
        width = enc.width
        end = int(end_id).to_bytes(width, "little")
        fs, root = file_system(folder)
        name, files, held, pending, first, tokens, docs = f"part-{uuid.uuid4().hex}", None, [], 0, None, 0, 0
        for b in chunks(batches):
            if files is None:
                fs.create_dir(root, recursive=True)
                files = {x: fs.open_output_stream(f"{root}/{name}.{x}") for x in ("bin", "off", "ids")}
                files["off"].write(bytes(8))
                first = (b.column("doc_id")[0].as_py(), b.column("h")[0].as_py())
            files["ids"].write(b.column("doc_id").fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
            sizes = []
            for text in b.column("text").to_pylist():
                data = enc.encode(text or "") + end
                sizes.append(len(data) // width)
                held.append(data)
                pending += len(data)
                if pending >= WRITE_BYTES:
                    files["bin"].write(b"".join(held))
                    held, pending = [], 0
            offsets = tokens + np.cumsum(sizes)
            files["off"].write(offsets.astype("<i8").tobytes())
            tokens, docs = int(offsets[-1]), docs + len(sizes)
        if files is None:
            return
        files["bin"].write(b"".join(held))
        for f in files.values():
            f.close()
        yield pa.RecordBatch.from_pydict({"name": [name], "least": [NULL_ID if first[0] is None else first[0]], "h": [first[1]], "tokens": [tokens], "docs": [docs], "width": [width]})

    rows = text_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id"), F.col("h")]
    ordered = rows.repartitionByRange(parts or part_count(docs), *order).sortWithinPartitions(*order)
    found = sorted(ordered.mapInArrow(tidied(run), "name string, least long, h long, tokens long, docs long, width long").collect(), key=lambda r: (r.least, r.h))
    listed, base = [], 0
    for r in found:
        listed.append((r.name, base, r.tokens, r.docs))
        base += r.tokens
    manifest = Manifest(folder, found[0].width if found else 2, listed)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"width": manifest.width, "parts": listed}).encode())
    return manifest


class Part:
    """A part's files: mapped where the folder is a mounted one, else read range by range."""

    def __init__(self, folder: str, name: str, width: int):
        fs, root = file_system(folder)
        self.kinds = {"bin": np.dtype(f"<u{width}"), "off": np.dtype("<i8"), "ids": np.dtype("<i8")}
        paths = {x: f"{root}/{name}.{x}" for x in self.kinds}
        sizes = {x: fs.get_file_info(p).size for x, p in paths.items()}
        self.docs = sizes["ids"] // 8
        local = isinstance(fs, pafs.LocalFileSystem)
        self.mapped = {x: np.memmap(p, self.kinds[x], "r") for x, p in paths.items() if local and sizes[x]}
        self.files = {} if local else {x: fs.open_input_file(p) for x, p in paths.items()}

    def read(self, of: str, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi of a file."""
        kind = self.kinds[of]
        if hi <= lo:
            return np.empty(0, kind)
        if of in self.mapped:
            return self.mapped[of][lo:hi]
        return np.frombuffer(self.files[of].read_at((hi - lo) * kind.itemsize, lo * kind.itemsize), kind)


def read_tokens(spark: SparkSession, manifest: Manifest, docs_at_once: int = 1024) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    folder, width = manifest.folder, manifest.width
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest.parts:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist()):
                part = Part(folder, name, width)
                for lo in range(0, part.docs, docs_at_once):
                    hi = min(lo + docs_at_once, part.docs)
                    offsets = part.read("off", lo, hi + 1)
                    tokens = part.read("bin", int(offsets[0]), int(offsets[-1]))
                    at = offsets - offsets[0]
                    crc = [zlib.crc32(tokens[a:z].astype("<u4").tobytes()) for a, z in zip(at.tolist(), at[1:].tolist())]
                    doc = [None if x == NULL_ID else x for x in part.read("ids", lo, hi).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = spark.createDataFrame([(p[0], p[1]) for p in manifest.parts], "name string, base long")
    return parts.repartition(len(manifest.parts)).mapInArrow(tidied(run), schema)
