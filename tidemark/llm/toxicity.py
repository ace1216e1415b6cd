"""Operator 4, toxicity: maximum-scoring segments over token log-odds.

Learning counts tokens of a bounded labelled sample by class: each distinct word
of a text and the word's prefixes, once a text and word, so that a text that
repeats a word cannot make it count.  A token's score is its log-odds ratio
between the classes under an informative Dirichlet prior, kept where it is
significant.  A word takes the score of the longest token that fits it, at
every place, less a drift that makes clean text cost.  A linear scan finds
every maximal-scoring segment of a text: these are its passages.  Segment
scores follow an extreme-value law in clean text, so lambda comes from the
clean score distribution and K from the sample's clean documents.

A document's score must not grow with mere repetition, so it comes from a
second scan in which a word counts at its first place only: the normalised
scores of these segments are summed, and a logistic fit on the learning rows
turns the sum into a probability.  Each scan has a K of its own.

Calibration is cross-fitted: the learning rows are dealt into ``PARTS`` by a hash
of doc_id, tokens are counted by part, and K and the logistic fit come from each
part's rows under the tokens of all others, so no row calibrates scores that it
taught.  The scores themselves come from all learning rows.

Defined cases: null and empty texts and texts without known toxic words have no
segment and get the score of an empty sum; very long texts are scanned whole;
equal segment scores are all kept, and tokens of equal significance are taken
in order of their text; without labels of both classes every score is the share
of label 1 among the labelled rows, or 0; rows stay one to one, repeated and
null doc_ids included; a null doc_id is not held out; an empty table gives no
rows; extra columns, whatever their names, are ignored (``passages``) or kept
(``reject``).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import labelled
from .common import CACHED_LENGTH, by_text, chunks, folded_words, text_rows, texts, tidied, written

#: Labelled rows of each class that learning reads at most.
PER_CLASS = 6_000
#: Tokens of the model at most, the most significant first: the bound of what learning gathers and tasks carry.
MAX_TOKENS = 50_000
#: Lengths of the prefixes that are tokens, in characters, the longest first.
PREFIXES = (8, 7, 6, 5, 4, 3)
#: Entries of a worker's cache of word scores before it is emptied.
CACHE_ENTRIES = 1 << 17
#: Prior weight as a share of all counted words, and the least |z| of a token that counts.
PRIOR, LEAST_Z = 0.01, 3.0
#: Parts of the learning rows that calibrate each other.
PARTS = 5
#: What each word costs, so that clean text has a falling score.
DRIFT = 0.25


def tokens(word: bytes) -> list[str]:
    """The tokens of a word, the longest first: ``word$`` and ``prefix*``."""
    w = word.decode("utf-8", "replace")
    return [w + "$", *(w[:k] + "*" for k in PREFIXES if len(w) >= k)]


class WordScores(dict):
    """Scores by word; None for words that no token of the model fits."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: bytes) -> float | None:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        s = next((self.scores[t] for t in tokens(word) if t in self.scores), None)
        if len(word) <= CACHED_LENGTH:
            self[word] = s
        return s

    def __reduce__(self):
        return WordScores, (self.scores,)  # the cache stays behind


@dataclass(frozen=True)
class Model:
    scores: WordScores
    lam: float
    log_k: float
    log_k_passages: float
    fit: tuple[float, float] | None
    base: float


def known(words: list[bytes], scores: WordScores) -> list[tuple[int, float]]:
    """Places and scores of the known words."""
    return [(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s is not None]


def firsts(words: list[bytes], places: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The places at which a word stands for the first time."""
    return sorted({words[i]: (i, s) for i, s in reversed(places)}.values())


def segments(words: list[bytes], scores: WordScores, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(from, to, score) of all maximal-scoring segments, left to right; ``to`` is exclusive."""
    return scan(known(words, scores), drift)


def scan(places: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """Maximal-scoring segments of a text that has scores at these places only.

    Every segment starts and ends at a word of positive score, so the scan
    visits known words only and charges the words between them as one step.
    """
    # Candidates as (from, to, total before, total after).  A candidate joins an earlier one
    # whose total before is less, if the total after has not been reached there.
    found: list[tuple[int, int, float, float]] = []
    total, last = 0.0, 0
    for i, s in places:
        before = total - drift * (i - last)
        total, last = before + s - drift, i + 1
        if s <= drift:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(lo, hi, b - a) for lo, hi, a, b in found]


def decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * scores)) = 1, by bisection."""
    if not (scores > 0).any():
        return 1.0
    lo, hi = 0.0, 1.0
    excess = lambda x: float(np.log(share @ np.exp(np.clip(x * scores, -700, 700))))
    while excess(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def chance_level(n: int, log_k: float) -> float:
    """What the best segment of a clean text of n words reaches, in units of 1 / lambda; no text is too short for 0."""
    return max(0.0, log_k + float(np.log(n)))


def chance_constant(n: np.ndarray, top: np.ndarray) -> float:
    """log K from the lengths of clean texts and their best segments, in units of 1 / lambda."""
    k = len(n) / max(1e-300, float((n * np.exp(np.clip(-top, -700, 0))).sum())) if len(n) else 1.0
    return float(np.log(k))


def normalised(found: list[tuple[int, int, float]], n: int, lam: float, log_k: float) -> float:
    """Sum of the significant segments' scores above chance; the best one if none is significant; without segments, a score of 0."""
    if not n:
        return 0.0
    level = chance_level(n, log_k)
    above = [lam * s - level for _, _, s in found]
    return sum(x for x in above if x > 0) or max(above, default=-level)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Learns from at most ``per_class`` labelled rows of each class."""
    rows, counts = labelled.sample(docs, labels, label, F.lit(True) if learn is None else learn, per_class)
    rows = rows.withColumn("part", labelled.part(PARTS))
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    none = Model(WordScores({}), 1.0, 0.0, 0.0, None, base)
    if not (counts.get(0) and counts.get(1)):
        return none

    def count(batches):
        for b in chunks(batches, 32 << 20):
            seen = [Counter() for _ in names]
            for y, k, t in zip(b.column("label").to_pylist(), b.column("part").to_pylist(), texts(b)):
                words = set(folded_words(t))
                held = seen[2 * k + y]
                held[""] += len(words)
                for w in words:
                    held.update(tokens(w))
            found = list(set().union(*seen))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[w] for w in found], pa.int64()) for c in seen)], ["token", *names])

    names = [f"{kind}{k}" for k in range(PARTS) for kind in ("clean", "toxic")]
    counted = rows.mapInArrow(tidied(count), ", ".join(["token string", *(f"{c} long" for c in names)]))
    totals = written(counted.groupBy("token").agg(*[F.sum(c).alias(c) for c in names]), "tokens-toxic")
    column = lambda kind, but: sum((F.col(f"{kind}{k}") for k in range(PARTS) if k != but), F.lit(0)).alias(kind)
    learnt = lambda but: log_odds(totals.select("token", column("clean", but), column("toxic", but)))
    whole = learnt(None)
    if whole is None:
        return none
    others = [learnt(k) or whole for k in range(PARTS)]  # for the rows of each part, the tokens of all others

    def best(batches):
        for b in chunks(batches):
            words = [folded_words(t) for t in texts(b)]
            by = [others[h] for h in b.column("part").to_pylist()]
            places = [known(w, scores) for w, (scores, _) in zip(words, by)]
            top = [lam * max((x for _, _, x in scan(firsts(w, p))), default=0.0) for w, p, (_, lam) in zip(words, places, by)]
            top_passage = [lam * max((x for _, _, x in scan(p)), default=0.0) for p, (_, lam) in zip(places, by)]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array(top, pa.float64()), pa.array(top_passage, pa.float64())], ["n", "top", "top_passage"])

    clean = np.array([(r.n, r.top, r.top_passage) for r in rows.where("label = 0").mapInArrow(tidied(best), "n long, top double, top_passage double").where("n > 0").collect()]).reshape(-1, 3)
    log_k, log_k_passages = (chance_constant(clean[:, 0], clean[:, c]) for c in (1, 2))

    def sums_of(batches):
        for b in chunks(batches):
            words = [folded_words(t) for t in texts(b)]
            by = [others[h] for h in b.column("part").to_pylist()]
            x = [float(normalised(scan(firsts(w, known(w, scores))), len(w), lam, log_k)) for w, (scores, lam) in zip(words, by)]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x, pa.float64())], ["label", "x"])

    xy = np.array([(r.x, r.label) for r in rows.mapInArrow(tidied(sums_of), "label int, x double").collect()]).reshape(-1, 2)
    fit = labelled.logistic(xy[:, 0], xy[:, 1], labelled.class_weights(xy[:, 1], counts))
    return Model(whole[0], whole[1], log_k, log_k_passages, fit, base)


def log_odds(totals: DataFrame) -> tuple[WordScores, float] | None:
    """Scores of the significant tokens and lambda, from counts (token, clean, toxic) whose empty token has the sums."""
    n = totals.where("token = ''").first()
    n0, n1 = (n.clean, n.toxic) if n else (0, 0)
    if not n0 or not n1:
        return None
    prior = PRIOR * (n0 + n1)
    a = F.lit(PRIOR) * (F.col("clean") + F.col("toxic"))
    odds = lambda y, m: F.log((F.col(y) + a) / (F.lit(m + prior) - F.col(y) - a))
    delta = odds("toxic", n1) - odds("clean", n0)
    z = delta / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    share = (F.col("clean") + a) / F.lit(n0 + prior)
    seen = totals.where("token <> '' AND clean + toxic > 0")
    kept = seen.select("token", delta.alias("delta"), z.alias("z"), share.alias("share")).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "token").limit(MAX_TOKENS).collect()
    gains = [(r.delta - DRIFT, r.share) for r in kept if r.delta > DRIFT]
    s, p = np.array([x for x, _ in gains] + [-DRIFT]), np.array([x for _, x in gains])
    return WordScores({r.token: r.delta for r in kept}), decay(s, np.append(p, max(1e-9, 1 - p.sum())) / max(1.0, p.sum()))


def probability_of(words: list[bytes], places: list[tuple[int, float]], model: Model) -> float:
    """Probability of toxicity of a text whose known words stand at these places."""
    if model.fit is None:
        return model.base
    x = normalised(scan(firsts(words, places)), len(words), model.lam, model.log_k)
    return float(labelled.probability(np.array(x), model.fit))


def score_of(words: list[bytes], model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Probability of toxicity and the significant segments of a text."""
    places = known(words, model.scores)
    p = probability_of(words, places, model)
    if model.fit is None:
        return p, []
    return p, [x for x in scan(places) if model.lam * x[2] > chance_level(len(words), model.log_k_passages)]


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the toxic passages (first word, end, score) of every document; one pass, no shuffle."""
    schema = "doc_id long, score double, passages array<struct<start:long,stop:long,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in chunks(batches):
            got = [score_of(folded_words(t), model) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([p for p, _ in got]), pa.array([[dict(zip(("start", "stop", "score"), s)) for s in found] for _, found in got], kind)], ["doc_id", "score", "passages"])

    return text_rows(docs, "doc_id").mapInArrow(tidied(run), schema)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, all columns kept; only the texts reach Python."""

    def score(raw: list[bytes]) -> pa.Array:
        return pa.array([probability_of(w, known(w, model.scores), model) for w in map(folded_words, raw)], pa.float64())

    return docs.where(by_text(score, "double")(F.col("text")) < threshold)
