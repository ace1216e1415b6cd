"""Operators 1, 2 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tables import frame

from tidemark.llm import components, decontam, minhash, substring
from tidemark.llm.common import folded_words

FOLDED = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return FOLDED.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def test_folded_words_match_the_pattern(rows):
    for _, t in [*rows, (0, "Straße ÄÖ AbC1-2_x\x7f\x80é")]:
        assert folded_words((t or "").encode()) == fold(t)


# -- 1 ------------------------------------------------------------------------


def brute_hits(words, items, window):
    hit, found = set(), set()
    for name, w in items:
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(name)
    return hit, found


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination(spark, rows, docs, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    texts = [t for _, t in rows if t and 20 < len(t) < 5000]
    items = [(i, " ".join(t.split()[2:17])) for i, t in enumerate(texts[:8])] + [(50, "one"), (51, "B, c"), (52, ""), (53, None), (None, "again again"), (54, texts[1]), (55, "no such words here")]
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    coded = [("null" if i is None else str(i), fold(t)) for i, t in items]
    want = Counter()
    for i, t in rows:
        w = fold(t)
        hit, found = brute_hits(w, coded, 13)
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert sum(k[2] > 0 for k in want) > 8


def test_automaton_random():
    r = random.Random(0)
    for _ in range(60):
        word = lambda: r.choice([b"a", b"b", b"c"])
        items = [(str(i), [word() for _ in range(r.randrange(0, 9))]) for i in range(4)]
        texts = [[word() for _ in range(r.randrange(0, 40))] for _ in range(3)]
        found = decontam.match(texts, decontam.SuffixAutomaton(items, 5))
        for d, w in enumerate(texts):
            hit, names = brute_hits(w, items, 5)
            h = found.get(d, decontam.Found([], set()))
            assert {x for lo, hi in h.spans for x in range(lo, hi)} == hit and h.items == names


def test_decontaminate(spark, docs, none):
    passage = " ".join(f"p{i}" for i in range(15))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long = " ".join(f"q{i}" for i in range(400))
    extra = frame(spark, [(900, f"Clean start, {passage}! end."), (901, long + " " + passage + ". " + long), (902, long)], True)
    got = {r.doc_id: r.text for r in decontam.decontaminate(extra, items).collect()}
    assert set(got) == {901, 902} and got[902] == long and got[901] == long + " . " + long
    assert decontam.decontaminate(docs, items).count() == docs.count()
    assert decontam.decontaminate(docs, items.limit(0)).exceptAll(docs).count() == 0
    assert decontam.contamination(none, items).count() == 0


def test_large_benchmark(spark):
    """20 MB of items: what occurs is found, and what does not costs lookups alone."""
    r = random.Random(6)
    items = spark.range(4000).select(F.col("id").alias("item_id"), F.expr("array_join(transform(sequence(1, 700), i -> concat('w', pmod(xxhash64(id, i), 50000))), ' ')").alias("text"))
    some = items.where("item_id % 500 = 3").collect()
    assert sum(len(x.text) for x in some) / len(some) * 4000 > 16e6
    rows = [(i, " ".join(f"w{r.randrange(50000)}" for _ in range(300))) for i in range(300)]
    rows += [(1000 + x.item_id, "before " + " ".join(x.text.split()[40 : 40 + 13 + k]) + " after " * 5) for k, x in enumerate(some)]
    found = {x.doc_id: x for x in decontam.contamination(frame(spark, rows), items).collect()}
    assert all(found[i].n_hit == 0 for i in range(300))
    assert [(found[1000 + x.item_id].n_hit, found[1000 + x.item_id].n_items) for x in some] == [(13 + k, 1) for k in range(len(some))]


# -- 2 ------------------------------------------------------------------------


def brute_classes(rows):
    """Class of each (doc_id, text): the least doc_id of its component; null texts alone."""
    texts = sorted({t for _, t in rows if t is not None})
    bags = []
    for t in texts:
        w = fold(t)
        n = min(5, len(w))
        bags.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            both = sum((a & b).values())
            if both and both >= 0.8 * sum((a | b).values()):
                parent[root(i)] = root(j)
    comp = {t: root(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if t is not None and i is not None:
            least[comp[t]] = min(i, least.get(comp[t], i))
    return Counter((i, i if t is None else least.get(comp[t], i)) for i, t in rows)


def edited(r, text, share):
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def near_rows():
    r = random.Random(5)
    out, n = [], 1000
    for size, share in ((30, 0.015), (12, 0.03), (5, 0.06)):
        base = " ".join(f"b{r.randrange(5000)}" for _ in range(150))
        for _ in range(size):
            out.append((n, edited(r, base, share)))
            n += 1
    return out


@pytest.mark.parametrize("tile", [3, 8, 256])
def test_near_duplicates(spark, rows, none, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "STAR", 4)
    every = [*rows, *near_rows()]
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(frame(spark, every, True).repartition(3)).collect())
    assert got == brute_classes(every)
    assert minhash.near_duplicates(none).count() == 0


def test_deduplicate(spark, rows):
    every = [*rows, *near_rows()]
    docs = frame(spark, every, True)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    classes = brute_classes(every)
    known = {c for i, c in classes if i is not None and c is not None}
    assert sorted(i for i, t in got if i is not None and i != 3) == sorted(known - {3})
    assert [i for i, _ in got].count(3) == 2  # two texts, two classes, one id
    assert minhash.deduplicate(docs.limit(0)).count() == 0


def test_signatures_estimate_without_bias():
    r = random.Random(1)
    a = Counter({i: r.choice([1, 1, 1, 2, 3, 9, 40]) for i in range(60)})
    b = Counter({i: r.choice([1, 1, 1, 2, 3, 9, 40]) for i in range(20, 80)})
    true = sum((a & b).values()) / sum((a | b).values())
    runs = []
    for salt in range(60):
        key = lambda i: minhash.mixed(np.array([i * 1000 + salt], np.uint64))[0]
        of, h, c = zip(*[(d, key(i), n) for d, bag in enumerate((a, b)) for i, n in bag.items()])
        s = minhash.signatures(np.array(of), np.array(h, np.uint64), np.array(c), 2, 128)
        assert not np.isinf(s).any()
        runs.append((s[0] == s[1]).mean())
    assert abs(np.mean(runs) - true) < 4 * (true * (1 - true) / (128 * 60)) ** 0.5


def test_overlaps():
    r = random.Random(8)
    texts = [[b"w%d" % r.randrange(6) for _ in range(r.randrange(1, 40))] for _ in range(12)] + [[b"a"] * 30, [b"a"] * 25]
    bags = [minhash.shingles(w) for w in texts]
    got = minhash.overlaps(bags)
    assert all(abs(got[i, j] - minhash.overlap(a, b)) < 1e-6 for i, a in enumerate(bags) for j, b in enumerate(bags) if i != j)


def test_components(spark):
    chain = [(f"{i:04}".encode(), f"{i + 1:04}".encode()) for i in range(50)] + [(b"x", b"y"), (b"y", b"x"), (b"z", b"z")]
    got = components.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in chain], "a binary, b binary")).collect()
    assert {bytes(r.node): bytes(r.comp) for r in got} == {f"{i:04}".encode(): b"0000" for i in range(51)} | {b"x": b"x", b"y": b"x"}


# -- 9 ------------------------------------------------------------------------


def brute_removed(rows, width):
    """Counter of (doc_id, words, removed, digest); ids are distinct."""
    texts = {i: BLANKS.findall(t or "") for i, t in rows}
    seen, out = set(), Counter()
    for i in sorted(texts):
        w, gone = texts[i], set()
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if g in seen:
                gone.update(range(k, k + width))
            seen.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("width", "block"), [(20, 1 << 20), (20, 2000), (3, 500), (1, 3000)])
def test_substring(spark, unique, width, block):
    got = substring.repeated(frame(spark, unique, True).repartition(3), width, block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(unique, width)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substring_repeated_ids_and_nothing(spark, rows, none):
    got = substring.repeated(frame(spark, rows), 20, 4000, keep_text=False).collect()
    assert len(got) == len(rows) and substring.repeated(none).count() == 0
    twice = [r.n_removed for r in got if r.doc_id == 2]
    assert len(twice) == 3


def test_packing():
    r = np.random.default_rng(0)
    for n in (1, 2, 1000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = r.integers(0, 1 << 32, len(x)).astype(np.uint32)
        assert all((a == b).all() for a, b in zip(substring.unpacked(substring.packed(x, y)), (x, y)))
    edge, more = np.array([0, 1, (1 << 64) - 1], np.uint64), np.array([0, (1 << 32) - 1, 7], np.uint32)
    assert all((a == b).all() for a, b in zip(substring.unpacked(substring.packed(edge, more)), (edge, more)))


def test_windows_of_one_hash_stay_apart(spark, monkeypatch):
    """With a first hash of four bits nearly all windows share one; the second still tells them apart."""
    whole = substring.window_hashes
    monkeypatch.setattr(substring, "window_hashes", lambda h, w, base=substring.BASE: whole(h, w, base) & np.uint64(15) if base == substring.BASE else whole(h, w, base))
    r = random.Random(2)
    first = r.choices(range(16), k=500)
    order, ascending, same = substring.hash_order(np.array(first, np.uint64), second := np.array(r.choices(range(9), k=500), np.uint32))
    pairs = list(zip(ascending.tolist(), second[order].tolist()))
    assert pairs == sorted(zip(first, second.tolist())) and same.tolist() == [False, *(a == b for a, b in zip(pairs, pairs[1:]))]
    rows = [(i, " ".join(f"w{r.randrange(5)}" for _ in range(40))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(substring, "even_keys", lambda spark, n: np.arange(n, dtype=np.int32))
    table = pa.table({"raw": [t.encode() for _, t in rows]})
    a, b, n, size = substring.part_windows(table.column("raw").to_pylist(), 4)
    assert len(set(a.tolist())) <= 16 and n.sum() == len(a) and size.sum() == 30 * 40
    order, _, same = substring.hash_order(a, b)
    grams = [tuple(t.split()[i : i + 4]) for _, t in rows for i in range(37)]
    assert (~same).sum() == len(set(grams)) and docs.count() == 30


def test_parts_of_one_id(spark):
    """Rows without id, a third of all, are many parts; each text's windows are removed but once."""
    r = random.Random(4)
    texts = [" ".join(f"u{r.randrange(10**6)}" for _ in range(60)) for _ in range(120)]
    rows = [(None, t) for t in texts] + [(i, texts[i % 120]) for i in range(240)]
    docs = frame(spark, rows, True)
    got = substring.repeated(docs, 20, 3000).collect()
    assert len(got) == 360 and all(x.n_removed == (0 if x.doc_id is None else 60) for x in got)
    assert substring.layout(3 * 10**10, 6)[0] < 2000 and substring.layout(10**14, 4000)[0] < 500_000
    parts, buckets = substring.layout(10**14, 4000)
    assert parts * buckets <= 4 * 10**14 / substring.MESSAGE_BYTES


def test_bounds_are_even(spark):
    rows = spark.range(4000).select(F.col("id").alias("key"), F.xxhash64("id").alias("h"), F.when(F.col("id") < 100, 1000).otherwise(10).cast("long").alias("size"))
    total = rows.agg(F.sum("size")).first()[0]
    bounds = substring.part_bounds(rows, total, 16)
    held = Counter()
    for x in rows.collect():
        held[int(np.searchsorted(bounds, substring.places(np.array([x.key]), np.array([x.h])), "right")[0])] += x.size
    assert len(held) == 16 and max(held.values()) < 2 * total / 16
    keys = substring.even_keys(spark, 50)
    got = spark.createDataFrame([(int(k),) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(50)).alias("p")).collect()
    assert [x.p for x in got] == list(range(50))
