"""Operator 6, token counts: byte-pair merging with a heap over a linked list.

The count of a pre-token is its number of bytes less the number of merges, so
no identifier is ever made.  Texts are cut where the pre-tokenizer always cuts
(before a single space, around a single line feed); the parts repeat, and their
counts are kept in a bounded cache per worker.

Defined cases: null and empty texts count 0 tokens; very long texts are counted
whole, and a text without blanks is one part; pairs of equal rank merge from the
left; rows stay one to one and keep their doc_id as it is, null and repeated
ones included; an empty table gives no rows; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import CACHED_LENGTH, chunks, text_rows, tidied

#: Entries of a cache before it is emptied.
CACHE_ENTRIES = 600_000
#: fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class PairMerger:
    """Counts the tokens of one pre-token, by merges alone."""

    def __init__(self, merges: list[tuple[str, str]]):
        ids = {c: i for i, c in enumerate(byte_alphabet().values())}
        self.symbol = {b: ids[c] for b, c in byte_alphabet().items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            new = ids.setdefault(a + b, len(ids))
            self.rank.setdefault((ids[a], ids[b]), (rank, new))

    def count(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        rank = self.rank
        sym = [self.symbol[b] for b in word]
        heap = []
        for i in range(n - 1):
            r = rank.get((sym[i], sym[i + 1]))
            if r is not None:
                heap.append((r[0], i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has since been merged
            sym[i], sym[j] = rank[a, b][1], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get((sym[i], sym[k]))
                if r is not None:
                    heapq.heappush(heap, (r[0], i, sym[i], sym[k]))
            h = before[i]
            if h >= 0:
                r = rank.get((sym[h], sym[i]))
                if r is not None:
                    heapq.heappush(heap, (r[0], h, sym[h], sym[i]))
        return n - merges


class Counts(dict):
    """Token counts by text; a miss computes, a full cache is emptied."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = self.of(key)
        if len(key) <= CACHED_LENGTH:
            self[key] = n
        return n


class TokenCounter:
    """Counts tokens of whole texts as the vocabulary file's library does."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pattern = regex.compile(PATTERN)
        merger = PairMerger(pairs)
        self.pretoken = Counts(lambda w: merger.count(w.encode("utf-8", "surrogatepass")))
        self.head = Counts(self.by_pattern)
        self.tail = Counts(lambda w: self.by_pattern(" " + w))

    def by_pattern(self, text: str) -> int:
        return sum(map(self.pretoken.__getitem__, self.pattern.findall(text)))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total = -1
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            # A cut is safe only where single blanks part words: no run of white space crosses it.
            if not first or first[0].isspace() or first[-1].isspace():
                return self.by_pattern(text)
            for w in rest:
                if not w or w[0].isspace() or w[-1].isspace():
                    return self.by_pattern(text)
            total += 1 + self.head[first] + sum(map(self.tail.__getitem__, rest))
        return total

    def count(self, text: str) -> int:
        parts = [text]
        for s in self.special:
            parts = [y for x in parts for y in x.split(s)]
        return len(parts) - 1 + sum(self.plain(x) for x in parts if x)


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter for each vocabulary in a worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; one pass, no shuffle."""

    def run(batches):
        c = counter(vocabulary)
        for b in chunks(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            n = [c.count(x) for x in texts]
            size = pc.fill_null(pc.binary_length(b.column("text").cast(pa.binary())), 0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), size.cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return text_rows(docs, "doc_id").mapInArrow(tidied(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
