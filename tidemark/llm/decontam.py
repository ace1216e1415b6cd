"""Operator 1, benchmark decontamination: a generalised suffix automaton of the test items.

Document words stream through the automaton, which tracks the longest suffix of
what was read that occurs in some item.  Where that length reaches an item
window, the words under the window are hit; spans of hits are removed, and a
document whose hits reach the coverage limit is contaminated.

An automaton of all items would follow the size of the benchmark, in memory
and in the time that every worker takes to build it.  So the hashes of all item
windows are kept once, sorted, with the items they stand in, in files of the
shared folder (12 bytes a window) that workers map.  For each few megabytes of
documents the hashes name the items that can occur at all, and the automaton is
built of these, at most ``BLOCK_BYTES`` of their text at a time: a benchmark of
any size costs its lookups and the items that do occur.  Documents never shuffle.

Defined cases: null and empty texts have no words, no hits and no items; items
without words have no window; an item without id counts under the id ``null``,
and items of the same id count as one; very long texts are read whole; repeated
rows are judged alike, whatever their order; an empty table of documents gives
no rows, one of items no hits; extra columns of either table, whatever their
names, are ignored (``contamination``) or kept (``decontaminate``).
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from .common import FOLD, by_text, chunks, folded_words, named, shared_folder, text_rows, texts, tidied
from .substring import GOLDEN, MASK, mixed, window_hashes, word_hashes
from .token_files import file_system

#: Item text in one automaton, in bytes; a longer item fills one alone.
BLOCK_BYTES = 1 << 20
#: Bits of the table of adjacent item words that cuts documents into runs.
TABLE_BITS = 22
#: Bits for each item window in the table that most document windows end at.
BITS_A_WINDOW = 16

WORD = re.compile(rb"[^ ]+")


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with their windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self.extend(last, c)
        # Per state: the state that stands for the last ``window`` words, and items shorter than a window that end here.
        self.shortest = min([min(window, len(seq)) for _, seq in coded], default=0)
        self.at = [self.above(v) for v in range(len(self.next))]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, seq in coded:
            v = 0
            for i, c in enumerate(seq):
                v = self.next[v][c]
                if i + 1 >= window:
                    self.items.setdefault(self.at[v], set()).add(name)
            if len(seq) < window:
                self.short.setdefault(v, []).append((len(seq), name))
        self.whole = [self.ending(v) for v in range(len(self.next))] if self.short else None
        self.pairs = np.zeros(1 << TABLE_BITS, np.bool_)
        for _, seq in coded:
            a = np.array(seq, np.int64)
            self.pairs[self.slot(a[:-1], a[1:])] = True

    @staticmethod
    def slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 7) & ((1 << TABLE_BITS) - 1)

    def extend(self, last: int, c: int) -> int:
        step, link, length = self.next, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self.split(last, c, q)
        new = self.add({}, length[last] + 1, 0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, c, q)
        return new

    def add(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def split(self, p: int, c: int, q: int) -> int:
        copy = self.add(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def above(self, v: int) -> int:
        """The state on v's suffix path whose words include the suffix of one window."""
        if self.length[v] < self.window:
            return -1
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def ending(self, v: int) -> list[tuple[int, str]]:
        out = []
        while v > 0:
            out += self.short.get(v, [])
            v = self.link[v]
        return out

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, words, items) of each item window that ends at a position of the sequence."""
        step, link, length = self.next, self.link, self.length
        v = n = 0
        for i, c in enumerate(seq):
            while v and c not in step[v]:
                v = link[v]
                n = length[v]
            if c in step[v]:
                v = step[v][c]
                n += 1
            if n >= self.window:
                yield i, self.window, self.items[self.at[v]]
            if self.whole is not None:
                for size, name in self.whole[v]:
                    if size <= n:
                        yield i, size, {name}

    def runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of known words whose neighbours all stand together in some item; no window leaves one."""
        known = codes >= 0
        joined = known[:-1] & known[1:]
        joined &= self.pairs[self.slot(codes[:-1], codes[1:])]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
        lo, hi = edge[::2], edge[1::2] + 1
        keep = hi - lo >= max(self.shortest, 2)
        yield from zip(lo[keep].tolist(), hi[keep].tolist())
        if self.shortest == 1:  # words that stand alone can be whole items
            inside = np.zeros(len(codes) + 1, np.int8)
            np.add.at(inside, lo, 1)
            np.add.at(inside, hi, -1)
            for i in np.flatnonzero(known & (np.cumsum(inside[:-1]) == 0)).tolist():
                yield i, i + 1


@dataclass
class Found:
    """Hits of one document: merged word spans [from, to) and the ids of items."""

    spans: list[tuple[int, int]]
    items: set[str]


def match(documents: list[list[bytes]], automaton: SuffixAutomaton) -> dict[int, Found]:
    """Hits of the documents that have any, by position."""
    if not automaton.shortest:
        return {}
    get, flat, starts = automaton.ids.get, [], []
    for words in documents:
        starts.append(len(flat))
        flat += map(get, words, repeat(-1))
        flat.append(-1)  # no run crosses documents
    codes = np.array(flat, np.int64)
    first, found = np.array(starts), {}
    for lo, hi in automaton.runs(codes):
        d = int(np.searchsorted(first, lo, "right")) - 1
        for end, n, items in automaton.stream(flat[lo:hi]):
            hit = found.setdefault(d, Found([], set()))
            at = lo - starts[d] + end + 1
            hit.spans.append((at - n, at))
            hit.items |= items
    for hit in found.values():
        hit.spans = merged(hit.spans)
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def item_windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words; windows of different lengths differ."""
    return mixed(window_hashes(hashes, n) + np.uint64(n * int(GOLDEN) & MASK))


class Windows:
    """The window hashes of a benchmark in a worker: mapped where the folder is a mounted one, else read once."""

    def __init__(self, folder: str):
        fs, root = file_system(folder)
        load = lambda name, kind: np.memmap(f"{root}/{name}", kind, "r") if isinstance(fs, pafs.LocalFileSystem) else np.frombuffer(fs.open_input_file(f"{root}/{name}").readall(), kind)
        self.hashes, self.owners, self.offsets, self.items = load("hashes", "<u8"), load("owners", "<i4"), load("offsets", "<i8"), load("items", "u1")
        self.bits = max(16, (len(self.hashes) * BITS_A_WINDOW).bit_length())
        self.table = np.zeros(1 << (self.bits - 3), np.uint8)
        at = np.asarray(self.hashes) >> np.uint64(64 - self.bits)
        np.bitwise_or.at(self.table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are item windows, and the items that have them."""
        at = hashes >> np.uint64(64 - self.bits)
        some = np.flatnonzero(self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
        wanted = hashes[some]
        lo = np.searchsorted(self.hashes, wanted)
        real = lo < len(self.hashes)
        real[real] = self.hashes[lo[real]] == wanted[real]
        each = np.unique(wanted[real])
        lo, hi = np.searchsorted(self.hashes, each), np.searchsorted(self.hashes, each, "right")
        owners = [self.owners[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        return some[real], np.unique(np.concatenate(owners)) if owners else np.empty(0, np.int32)

    def item(self, i: int) -> tuple[str, list[bytes]]:
        return pickle.loads(self.items[self.offsets[i] : self.offsets[i + 1]].tobytes())


_WINDOWS: dict[str, Windows] = {}


def windows_in(folder: str) -> Windows:
    """One benchmark in a worker, the one at hand."""
    if folder not in _WINDOWS:
        _WINDOWS.clear()
        _WINDOWS[folder] = Windows(folder)
    return _WINDOWS[folder]


class Benchmark:
    """The test items: their windows in files of the shared folder, written by the driver as it reads them one by one."""

    def __init__(self, items: DataFrame, window: int):
        self.window, self.folder = window, shared_folder(items.sparkSession, "items")
        rows = text_rows(items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null"))), "item_id")
        fs, root = file_system(self.folder)
        fs.create_dir(root, recursive=True)
        hashes, owners, offsets, lengths = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [0], set()
        with fs.open_output_stream(f"{root}/items") as out:
            for row in rows.toLocalIterator():
                words = folded_words((row.text or "").encode())
                n = min(window, len(words))
                if n:
                    lengths.add(n)
                    hashes.append(np.unique(item_windows(word_hashes(words), n)))
                    owners.append(np.full(len(hashes[-1]), len(offsets) - 1, np.int32))
                    data = pickle.dumps((row.item_id, words))
                    out.write(data)
                    offsets.append(offsets[-1] + len(data))
        #: Lengths of windows, a number for each item shorter than a window and for all others.
        self.lengths = sorted(lengths)
        every, of = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(every, kind="stable")
        for name, values in (("hashes", every[order].astype("<u8")), ("owners", of[order].astype("<i4")), ("offsets", np.array(offsets, "<i8"))):
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(values.tobytes())

    def match(self, documents: list[list[bytes]]) -> dict[int, Found]:
        """Hits of the documents that have any, by position."""
        found: dict[int, Found] = {}
        if not self.lengths:
            return found
        known = windows_in(self.folder)
        size = np.array([len(w) for w in documents], np.int64)
        hashes = word_hashes(list(chain.from_iterable(documents)))
        of = np.repeat(np.arange(len(documents)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(hashes))  # words to the end of the document
        some, items = set(), set()
        for n in self.lengths:
            starts = np.flatnonzero(left[: max(0, len(hashes) - n + 1)] >= n)
            at, owners = known.found(item_windows(hashes, n)[starts])
            some.update(of[starts[at]].tolist())
            items.update(owners.tolist())
        some = sorted(some)
        for block in self.blocks(known, sorted(items)):
            for d, hit in match([documents[i] for i in some], SuffixAutomaton(block, self.window)).items():
                old = found.setdefault(some[d], Found([], set()))
                old.spans = merged(old.spans + hit.spans)
                old.items |= hit.items
        return found

    def blocks(self, known: Windows, items: list[int]) -> Iterator[list[tuple[str, list[bytes]]]]:
        """The items in lists of bounded size."""
        held, size = [], 0
        for i in items:
            name, words = known.item(i)
            n = sum(map(len, words)) + len(words)
            if held and size + n > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append((name, words))
            size += n
        if held:
            yield held


def limits(hit: int, words: int, coverage: tuple[int, int]) -> bool:
    """True if the hit words reach the share coverage[0] / coverage[1] of a document."""
    return hit > 0 and hit * coverage[1] >= words * coverage[0]


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20)) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit word spans of every document."""
    benchmark = Benchmark(items, window)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>"

    def run(batches):
        for b in chunks(batches, 16 << 20):
            words = [folded_words(t) for t in texts(b)]
            found, none = benchmark.match(words), Found([], set())
            hits = [found.get(i, none) for i in range(len(words))]
            n = [sum(hi - lo for lo, hi in h.spans) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([len(h.items) for h in hits], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(h.items)).encode()).hexdigest() for h in hits]),
                    pa.array([limits(k, len(w), coverage) for k, w in zip(n, words)]),
                    pa.array([[list(s) for s in h.spans] for h in hits], pa.list_(pa.list_(pa.int64()))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return text_rows(docs, "doc_id").mapInArrow(tidied(run), schema)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between them goes too."""
    words = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at : words[lo][0]])
        at = words[hi - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20)) -> DataFrame:
    """The documents, all columns kept: contaminated ones go, hit spans of the others are cut out of ``text``.

    Only the texts reach Python, and only changed ones come back.
    """
    benchmark = Benchmark(items, window)

    def judged(raw: list[bytes]) -> pa.Array:
        words = [folded_words(t) for t in raw]
        found = benchmark.match(words)
        drop = {d for d, h in found.items() if limits(sum(hi - lo for lo, hi in h.spans), len(words[d]), coverage)}
        left = [cut(t, found[d].spans).decode() if d in found and d not in drop else None for d, t in enumerate(raw)]
        return pa.StructArray.from_arrays([pa.array([d in drop for d in range(len(raw))], pa.bool_()), pa.array(left, pa.string())], ["drop", "left"])

    rows = docs.withColumn(JUDGED, by_text(judged, "struct<drop:boolean,left:string>")(F.col("text"))).where(~F.col(f"`{JUDGED}`.drop"))
    text = F.coalesce(F.col(f"`{JUDGED}`.left"), F.col("text").cast("string")).cast(docs.schema["text"].dataType).alias("text")
    return rows.select(*[text if c == "text" else named(c) for c in docs.columns])


#: A column name that no table uses.
JUDGED = "tidemark judged"
