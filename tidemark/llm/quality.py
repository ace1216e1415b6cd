"""Operator 5, quality classifier: compressed sizes under dictionaries of good and bad text.

Two zstandard dictionaries are built from a bounded sample of labelled texts.
Every text is cut into pieces, each piece is compressed with either dictionary,
and the difference of the two total sizes over the text's size, calibrated by a
logistic fit on the learning rows, is the score.  Over the text's size, not over
the compressed sizes: text that repeats itself compresses to little with either
dictionary and gains nothing from the good one.  A short text is little evidence,
so the ratio is drawn to the mean of all labelled rows by ``PRIOR_BYTES`` bytes.

Calibration is cross-fitted: the learning rows are halved by a hash of doc_id,
and the fit comes from each half's rows under dictionaries of the other half, so
no row is compressed with a dictionary that holds its own text.  The scores come
from dictionaries of all learning rows.

Defined cases: null and empty texts have no pieces and get the mean ratio; very
long texts are compressed whole, piece by piece; rows of equal ratio get equal
scores; if a class has no learning rows, or too little text for a dictionary,
every score is the share of label 1 among the labelled rows, or 0; rows stay one
to one, repeated and null doc_ids included; a null doc_id is not held out; an
empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from . import labelled
from .common import chunks, text_rows, texts, tidied

#: Labelled rows of each class that learning reads at most, and bytes of their text that reach the driver.
PER_CLASS, TRAIN_BYTES = 2_000, 16 << 20
DICTIONARY_BYTES = 110 << 10
#: Bytes of text compressed at a time: short enough that the dictionary matters for every part of a long text.
PIECE = 1 << 10
LEVEL = 3
#: Bytes of text at the mean ratio that every text is taken to have besides its own.
PRIOR_BYTES = 64


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    fit: tuple[float, float] | None
    base: float
    mean: float = 0.0
    scale: float = 1.0

    def ratios(self, differences: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bounded variable of the fit: what a text far from both classes weighs has a limit."""
        return np.tanh((differences + PRIOR_BYTES * self.mean) / (lengths + PRIOR_BYTES) / self.scale)

    def scores(self, differences: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return labelled.probability(self.ratios(differences, lengths), self.fit)


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


class Sizes:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for d in (good, bad):
            made = zstandard.ZstdCompressionDict(d)
            made.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=made, level=LEVEL, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> int:
        """bad - good in bytes: positive where the good dictionary serves better."""
        cut = pieces(text)
        good, bad = (sum(len(c.compress(p)) for p in cut) for c in self.compressors)
        return bad - good


_SIZES: dict[tuple[bytes, bytes], Sizes] = {}


def sizes(model: Model) -> Sizes:
    """One pair of compressors in a worker for the model at hand."""
    key = (model.good, model.bad)
    if key not in _SIZES:
        _SIZES.clear()
        _SIZES[key] = Sizes(*key)
    return _SIZES[key]


def dictionary(samples: list[bytes]) -> bytes | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text
        return None


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Learns from at most ``per_class`` labelled rows of each class and ``TRAIN_BYTES`` of text of each, documented bounds of the sample."""
    rows, counts = labelled.sample(docs, labels, label, F.lit(True) if learn is None else learn, per_class)
    rows = rows.withColumn("half", labelled.part(2))
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    none = Model(b"", b"", None, base)
    if not (counts.get(0) and counts.get(1)):
        return none
    samples: dict[int, tuple[list[bytes], list[bytes]]] = {}
    for y in (1, 0):
        samples[y], total = ([], []), 0
        for r in rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
            text = (r.text or "").encode()
            samples[y][r.half].extend(pieces(text))
            total += len(text)
            if total >= TRAIN_BYTES:
                break
    learnt = lambda halves: [dictionary([x for h in halves for x in samples[y][h]]) for y in (1, 0)]
    made = learnt((0, 1))
    if not all(made):
        return none
    model = Model(made[0], made[1], None, base)
    halves = [learnt((1 - h,)) for h in (0, 1)]  # for the rows of each half, the dictionaries of the other
    others = [Model(d[0], d[1], None, base) if all(d) else model for d in halves]

    def run(batches):
        for b in chunks(batches):
            raw, half = texts(b), b.column("half").to_numpy()
            d = np.zeros(len(raw), np.int64)
            for h in (0, 1):
                for i in np.flatnonzero(half == h).tolist():
                    d[i] = sizes(others[h]).difference(raw[i])
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(d), pa.array([len(t) for t in raw], pa.int64())], ["label", "d", "n"])

    got = np.array([(r.d, r.n, r.label) for r in rows.mapInArrow(tidied(run), "label int, d long, n long").collect()], float).reshape(-1, 3)
    weight = labelled.class_weights(got[:, 2], counts)
    ratio = got[:, 0] / np.maximum(got[:, 1], 1)
    scaled = Model(model.good, model.bad, None, base, float(np.average(ratio, weights=weight)), float(np.median(np.abs(ratio))) or 1.0)
    return replace(scaled, fit=labelled.logistic(scaled.ratios(got[:, 0], got[:, 1]), got[:, 2], weight, ridge=1e-3))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; one pass, no shuffle."""

    def run(batches):
        for b in chunks(batches):
            if model.fit is None:
                p = np.full(b.num_rows, model.base)
            else:
                raw = texts(b)
                p = model.scores(np.array([sizes(model).difference(t) for t in raw], float), np.array([len(t) for t in raw], float))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64())], ["doc_id", "score"])

    return text_rows(docs, "doc_id").mapInArrow(tidied(run), "doc_id long, score double")
