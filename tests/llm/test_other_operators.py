"""Operators 3 to 8 and 10: libraries, exact round trips, brute force and held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tables import frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import avi, bpe_count, labelled, mixing, quality, sharding, token_files, toxicity
from tidemark.llm.common import folded_words

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "it's we're <|endoftext|> x", "tab\tnew\n\nline \r\n end ", " nbsp em", "é Å ﬁ ΣΣ İ", "12,345.67!?", "\x1c\x85x", " lead", "trail ", "\U0001f600\U0001f600 日本語", "A.B.C. don't", "a\n b", "<|startoftext|>", "x" * 3000, "́ combining"]

# -- 3 ------------------------------------------------------------------------


def test_token_files(spark, rows, none):
    odd = [(1000 + i, t) for i, t in enumerate(ODD)]
    every = [x for x in rows if x[0] is not None] + odd
    manifest = token_files.write_tokens(frame(spark, every, True).repartition(4), WORDS, 2, parts=5)
    got = sorted(token_files.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    tokenizer, start, want = Tokenizer.from_file(WORDS), 0, []
    h = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in every], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    for i, t in sorted(every, key=lambda x: (x[0], h[x[1]])):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert manifest.width == 2 and len(manifest.parts) > 1
    empty = token_files.write_tokens(none, WORDS, 2)
    assert empty.parts == [] and token_files.read_tokens(spark, empty).count() == 0


def test_token_files_of_one_id(spark):
    """A doc_id of all rows fills several parts, and their files read alike by maps and by ranges."""
    rows = [(7, f"text {i} " * (i % 9)) for i in range(400)]
    manifest = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS, 2, parts=4)
    assert len(manifest.parts) == 4 and sum(p[3] for p in manifest.parts) == 400
    got = sorted(token_files.read_tokens(spark, manifest, docs_at_once=7).collect(), key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    n = {t: len(Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids) + 1 for _, t in rows}
    assert sorted(r.n_tokens for r in got) == sorted(n[t] for _, t in rows)
    part = token_files.Part(manifest.folder, manifest.parts[0][0], manifest.width)
    mapped = [part.read(x, 3, 9).tolist() for x in ("bin", "off", "ids")]
    fs, root = token_files.file_system(manifest.folder)
    part.mapped, part.files = {}, {x: fs.open_input_file(f"{root}/{manifest.parts[0][0]}.{x}") for x in part.kinds}
    assert [part.read(x, 3, 9).tolist() for x in ("bin", "off", "ids")] == mapped


def test_token_files_null_id_and_other_tokenizer(spark):
    manifest = token_files.write_tokens(spark.createDataFrame([(None, "A b"), (-5, "c  D")], "doc_id long, text string"), BYTES, 50256)
    got = sorted(token_files.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -5]
    tokenizer = Tokenizer.from_file(BYTES)
    assert [r.n_tokens for r in got] == [len(tokenizer.encode(t).ids) + 1 for t in ("A b", "c  D")]


# -- 6 ------------------------------------------------------------------------


def test_token_counts(spark, rows, none):
    every = [*rows, *[(1000 + i, t) for i, t in enumerate(ODD)]]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_count.token_counts(frame(spark, every, True), BYTES).collect())
    tokenizer = Tokenizer.from_file(BYTES)
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((i, len((t or "").encode()), n(t), n(t) > 1024) for i, t in every)
    assert bpe_count.token_counts(none, BYTES).count() == 0


def test_merges_random():
    r, c, tokenizer = random.Random(2), bpe_count.TokenCounter(BYTES), Tokenizer.from_file(BYTES)
    for _ in range(300):
        t = "".join(r.choice("aeiou rstn.,'\né一") for _ in range(r.randrange(40)))
        assert c.count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), repr(t)


# -- 4 and 5 ------------------------------------------------------------------


def labelled_rows(seed, n, mark):
    """Texts of which a third is marked by ``mark(random, words) -> words``; ids, texts and labels."""
    r, out = random.Random(seed), []
    for i in range(n):
        w = [f"v{int(r.paretovariate(0.7)) % 3000}" for _ in range(r.randrange(20, 200))]
        y = int(i % 3 == 0)
        out.append((i, " ".join(mark(r, w) if y else w), y))
    return out


def insult(r, w):
    for _ in range(4):
        w[r.randrange(len(w))] = r.choice(["Grrfoo", "barbaz", "quxxxed,"])
    return w


def accuracy(scores, truth, held):
    test = [(r.score >= 0.5, truth[r.doc_id]) for r in scores.collect() if held(r.doc_id)]
    return sum(a == b for a, b in test) / len(test)


def test_toxicity(spark, docs, none):
    rows = labelled_rows(1, 900, insult)
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.train(table, labels, learn=labelled.fold(5) != 0)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert accuracy(toxicity.passages(table, model), {i: y for i, _, y in rows}, held) > 0.95
    found = toxicity.passages(table, model).where("doc_id = 0").first()
    marked = [k for k, w in enumerate(folded_words(rows[0][1].encode())) if w in (b"grrfoo", b"barbaz", b"quxxxed")]
    assert found.passages and all(any(p.start <= k < p.stop for k in marked) for p in found.passages)
    kept = toxicity.reject(table, model)
    assert 550 < kept.count() < 660
    assert toxicity.reject(docs, model).count() == docs.count() and toxicity.passages(none, model).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.passages(docs, model).collect())
    bare = toxicity.train(table, labels.limit(0))
    assert {r.score for r in toxicity.passages(docs, bare).collect()} == {0.0}
    one = toxicity.train(table, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.passages(docs, one).collect()} == {1.0}


def brute_segments(s):
    """Maximal-scoring segments by definition: the best segment, then the same left and right of it."""
    best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return [*brute_segments(s[:i]), (i, j), *[(a + j, b + j) for a, b in brute_segments(s[j:])]]


def test_segments_are_maximal():
    r = random.Random(4)
    for _ in range(300):
        n = r.randrange(1, 14)
        words = [b"w%d" % i for i in range(n)]
        given = {f"w{i}$": r.uniform(-3, 4) for i in range(n) if r.random() < 0.7}
        s = [given.get(f"w{i}$", 0.0) - 0.25 for i in range(n)]
        got = toxicity.segments(words, toxicity.WordScores(given))
        assert [(a, b) for a, b, _ in got] == brute_segments(s)
        assert all(abs(x - sum(s[a:b])) < 1e-9 for a, b, x in got)


def test_passages_of_repeated_words(spark):
    rows = labelled_rows(1, 900, insult)
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    r = random.Random(8)
    clean = lambda n: [b"v%d" % (int(r.paretovariate(0.7)) % 3000) for _ in range(n)]
    bad = [b"grrfoo", b"barbaz", b"quxxxed"]
    scattered = [w for b in bad for w in (*clean(400), b)]
    text = [*scattered, *clean(400), *bad, *bad, *clean(400)]
    p, found = toxicity.score_of(text, model)
    at = len(scattered) + 400
    assert any(lo <= at and at + 6 <= hi and hi - lo < 100 for lo, hi, _ in found)
    again = toxicity.score_of([*text, *bad, *bad], model)[0]
    assert again <= p  # repetition adds passages, not score
    assert toxicity.reject(table, model).count() == toxicity.passages(table, model).where("score < 0.5").count()


def test_toxicity_score_by_definition(spark):
    """Scores as their definition says: brute-force segments over first places, chance taken off, summed and put on the logistic curve."""
    rows = labelled_rows(1, 600, insult)
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    r = random.Random(3)
    for n in (0, 1, 5, 30, 40):
        words = [r.choice([b"grrfoo", b"barbaz", b"grrfoos", b"v1", b"v2", b"v77", b"unknownword"]) for _ in range(n)]
        seen, s = set(), []
        for w in words:
            hit = next((model.scores.scores[t] for t in toxicity.tokens(w) if t in model.scores.scores), 0.0)
            s.append((0.0 if w in seen else hit) - toxicity.DRIFT)
            seen.add(w)
        level = max(0.0, model.log_k + np.log(n)) if n else 0.0
        above = [model.lam * sum(s[a:b]) - level for a, b in brute_segments(s)]
        x = (sum(v for v in above if v > 0) or max(above, default=-level)) if n else 0.0
        want = 1 / (1 + np.exp(-(model.fit[0] * x + model.fit[1])))
        assert abs(toxicity.score_of(words, model)[0] - want) < 1e-9


def test_quality_score_by_definition(spark):
    rows = [(i, t, 1 - y) for i, t, y in labelled_rows(2, 600, shout)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.train(table, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    sizes = {}
    for name, d in (("good", model.good), ("bad", model.bad)):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL, write_content_size=False, write_dict_id=False)
        sizes[name] = lambda t, c=c: sum(len(c.compress(t[i : i + 1024])) for i in range(0, len(t), 1024))
    got = {x.doc_id: x.score for x in quality.scored(table, model).collect()}
    for i, t, _ in rows[:60]:
        t = t.encode()
        ratio = (sizes["bad"](t) - sizes["good"](t) + quality.PRIOR_BYTES * model.mean) / (len(t) + quality.PRIOR_BYTES)
        assert abs(got[i] - 1 / (1 + np.exp(-(model.fit[0] * np.tanh(ratio / model.scale) + model.fit[1])))) < 0.02


def shout(r, w):
    return [x.upper() + r.choice(["!!", "&&&", "$$"]) for x in w]


def test_quality(spark, docs, none):
    rows = [(i, t, 1 - y) for i, t, y in labelled_rows(2, 900, shout)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.train(table, labels, learn=labelled.fold(3) != 1)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert accuracy(quality.scored(table, model), {i: y for i, _, y in rows}, held) > 0.95
    got = quality.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(none, model).count() == 0
    assert {r.score for r in quality.scored(docs, quality.train(table, labels.limit(0))).collect()} == {0.0}


# -- 7 ------------------------------------------------------------------------


def check_shards(docs, rows, shards, slack):
    got = sharding.shard(docs, shards).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert max(sizes.values()) <= mean + slack and min(sizes[k] for k in range(shards)) >= mean - slack
    return got


def test_shards(spark, rows, docs, none):
    small = [(i, t) for i, t in rows if len(t or "") < 3000] * 20
    got = check_shards(frame(spark, small, True), small, 4, 4000)
    check_shards(docs, rows, 2, 110_000)
    assert sharding.shard(none).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(frame(spark, small, True).repartition(7), 4).collect()))


def test_sharded_keeps_the_records(spark, docs, tmp_path):
    want = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, 4).collect())
    rows = sharding.sharded(docs, 4, str(tmp_path / "shards"))
    got = rows.collect()
    assert Counter((r.record.doc_id, len((r.record.text or "").encode()) + 1, zlib.crc32((r.record.text or "").encode()), r.shard, r.slot) for r in got) == want
    assert rows.select("record.*").exceptAll(docs).count() == 0
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} == {f"shard={r.shard}" for r in got}


def test_shards_of_copies(spark):
    r = random.Random(3)
    rows = [(i, "copy of one text " * 5) for i in range(1500)] + [(5000 + i, f"text {r.random()} " * r.randrange(1, 9)) for i in range(3000)]
    got = check_shards(frame(spark, rows), rows, 8, 1500)
    again = sharding.shard(frame(spark, rows).repartition(5), 8)
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again.collect()}


def test_overfull_ranges_keep_equal_texts_together(spark):
    """In one hot range only a text that is by itself too large is parted; equal rows without end are spread."""
    r = random.Random(5)
    rows = [(i, "one large group " * 4) for i in range(900)] + [(10_000 + i, f"small group {i % 60}") for i in range(600)] + [(None, "same row") for _ in range(3000)] + [(20_000 + i, f"t{r.random()}") for i in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 8).collect()
    assert len(got) == len(rows)
    shards, sizes = defaultdict(set), Counter()
    for x in got:
        shards[x.text_crc32].add(x.shard)
        sizes[x.shard] += x.size
    assert all(len(shards[zlib.crc32(f"small group {i}".encode())]) == 1 for i in range(60))
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 8
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


# -- 8 ------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while free := [s for s in names if s not in capped]:
        rate = (total - sum(epochs * sizes[s] for s in capped)) / sum(w[s] for s in free)
        over = {s for s in free if rate * w[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else rate * w[s] for s in names}
        capped |= over
    return {s: epochs * sizes[s] for s in names}


def test_mixing(spark, none):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "a", "a", "a", "b", "c", "d", None, "ä"]), " ".join(["w"] * r.randrange(0, 300))) for i in range(600)]
    rows += [(700, "zero", ""), (701, "zero", None), (None, "a", "x y"), (3, "b", "again"), (702, "long", "w " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs).collect()
    sizes, taken = Counter({"zero": 0}), Counter()
    for _, s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, _, t in rows)
    source = {(i, len((t or "").split())): s for i, s, t in rows}
    for r_ in got:
        s = source[r_.doc_id, r_.size]
        assert r_.source_size == sizes[s] and abs(r_.target - want[s]) < 1e-6 and 0 <= r_.taken <= 2 * r_.size
        taken[s] += r_.taken
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    assert mixing.mixed(none).count() == 0 and mixing.mixture(none).count() == 0
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns and max(n for n in Counter(r.doc_id for r in mix.collect()).values()) <= 4


def test_mixture_meets_the_targets(spark):
    r = random.Random(11)
    rows = [(i, r.choice("aaaaaabccd"), " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(200, 1200)))) for i in range(3000)]
    rows += [(None, "c", f"null id {i} " * 150) for i in range(400)] + [(9, "b", "same row " * 200)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    sizes, words, null_ids = Counter(), Counter(), Counter()
    for _, s, t in rows:
        sizes[s] += len(t.split())
    got = mixing.mixture(docs).collect()
    for x in got:
        words[x.source] += len(x.text.split())
        null_ids[x.text] += x.doc_id is None
    want = brute_targets(sizes)
    assert any(want[s] / sizes[s] % 1 for s in want)
    assert all(abs(words[s] / want[s] - 1) < 0.02 for s in want), {s: words[s] / want[s] for s in want}
    rate = want["c"] / sizes["c"]
    assert {null_ids[t] for i, s, t in rows if i is None} <= {0, 1, 2} and max(Counter((x.doc_id, x.text) for x in got if x.doc_id not in (None, 9)).values()) <= 2
    assert abs(sum(null_ids.values()) / 400 - rate) < 0.1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs.repartition(9)).collect()))


def test_packed_blocks(spark):
    r = random.Random(3)
    rows = [(i if i % 9 else None, r.choice(["a", "a", None, "c"]), " ".join(f"x{i}y{k}" for k in range(r.randrange(0, 400)))) for i in range(300)] + [(5, "c", None), (6, "c", "  \n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.packed(docs, output_shards=8).collect()
    taken = {s: sum(x.taken for x in mixing.mixed(docs.where(F.col("source").eqNullSafe(F.lit(s)) | F.lit(True))).collect() if True) for s in ("any",)}
    words, blocks, slots = Counter(), defaultdict(set), defaultdict(list)
    for x in got:
        words[x.source] += len(x.text.split())
        blocks[x.source, x.block].add(x.text)
        slots[x.source].append(x.slot)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert sum(words.values()) == taken["any"] and all(abs(words[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in want)
    assert all(len(v) == 1 for v in blocks.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(len(x.text.split()) for x in got) == mixing.BLOCK_WORDS and len({x.shard for x in got}) == 8
    every = Counter(w for _, _, t in rows for w in (t or "").split())
    seen = Counter(w for v in blocks.values() for t in v for w in t.split())
    assert not seen - every  # a word stands in one block, as often as in the documents
    runs = [t.split() for _, _, t in rows if t]
    assert all(any(part in " ".join(w) for w in runs) for v in list(blocks.values())[:20] for t in v for part in [" ".join(t.split()[:2])] if t.split()[0].split("y")[0] == t.split()[min(1, len(t.split()) - 1)].split("y")[0])
    assert mixing.packed(docs.limit(0)).count() == 0


def test_permutations(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(0)).alias("a"), mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(1)).alias("b"))
        a, b = zip(*df.collect())
        assert sorted(a) == sorted(b) == list(range(n)) and (n < 100 or a != b)


def test_draws_are_multinomial(spark):
    rows = [(i, "ab"[i % 2], "w " * 640) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sources = mixing.sources_of(mixing.sized(docs), (3, 1, 2), 1.5, 2)
    got = mixing.draws(sources, 8).collect()
    per = defaultdict(list)
    for r in got:
        per[r["rank"]].append(r.blocks)
    for s in sources.collect():
        n = round(s.target / 128)
        assert sum(per[s["rank"]]) == n and max(per[s["rank"]]) < n / 8 + 6 * (n / 8) ** 0.5


# -- 10 -----------------------------------------------------------------------


def test_avi_digests(spark, rows, none):
    got = Counter(tuple(r)[:7] for r in avi.media_digests(frame(spark, rows, True)).collect())
    want = Counter()
    for i, t in rows:
        t = (t or "").encode()
        p = avi.padded(t)
        m = avi.write_avi(avi.encode_frames(p))
        assert len(p) % 576 == 0 and len(p) > 0 and p.rstrip(b"\xff") == t.rstrip(b"\xff")
        want[i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest()] += 1
    assert got == want and avi.media_digests(none).count() == 0


def test_frames_are_jpegs():
    r = np.random.default_rng(0)
    for p in (bytes(576), bytes([255]) * 576, r.integers(0, 256, 576, dtype=np.uint8).tobytes(), bytes([0, 255] * 288)):
        (f,) = avi.encode_frames(p)
        pixels = avi.decode_jpeg(f)
        assert pixels.shape == (192, 192) and (np.kron(np.frombuffer(p, np.uint8).reshape(24, 24), np.ones((8, 8), np.uint8)) == pixels).all()
        assert avi.decode_frames([f])[0].tobytes() == p
        assert avi.decode_frames([f.replace(avi.jpeg_head(), avi.jpeg_head()[:2] + avi.segment(0xFE, b"note") + avi.jpeg_head()[2:])])[0].tobytes() == p


def test_foreign_files():
    frames = avi.encode_frames(avi.padded(b"hello" * 500))
    whole = avi.write_avi(frames)
    assert avi.read_avi(whole) == (25.0, frames)
    movi = whole.index(b"movi") - 8
    size = struct.unpack_from("<I", whole, movi + 4)[0]
    bare = whole[: movi + 8 + size]
    bare = bare[:4] + struct.pack("<I", len(bare) - 8) + bare[8:]
    assert avi.read_avi(bare)[1] == frames  # no index
    at = whole.index(b"idx1") + 8
    absolute = bytearray(whole)
    for i in range(len(frames)):
        struct.pack_into("<I", absolute, at + 16 * i + 8, struct.unpack_from("<I", whole, at + 16 * i + 8)[0] + whole.index(b"movi"))
    assert avi.read_avi(bytes(absolute))[1] == frames  # offsets from the start of the file
    for junk in (b"RIFF\x04\x00\x00\x00WAVE", b"", b"not a file", bytes(100)):
        with pytest.raises(ValueError):
            avi.read_avi(junk)


def colour_frame(luma, across, down, restart=0):
    """A frame of three components without Huffman tables: luma blocks of the given levels, chroma of noise."""
    r = random.Random(1)
    rows, cols = luma.shape
    code = {kind: {s: c for c, s in table.items()} for kind, table in avi.standard_codes().items()}
    bits, out, before, n = [], b"", [0, 0, 0], 0

    def put(kind, symbol, value, size):
        length, c = code[kind][symbol]
        bits.extend(c >> (length - 1 - i) & 1 for i in range(length))
        v = value if value >= 0 else value + (1 << size) - 1
        bits.extend(v >> (size - 1 - i) & 1 for i in range(size))

    def block(part, level):
        d, before[part] = level - before[part], level
        put(0x00 if part == 0 else 0x01, abs(d).bit_length(), d, abs(d).bit_length())
        ac = 0x10 if part == 0 else 0x11
        if part:  # a run of zeros that needs a long one, then a term
            put(ac, 0xF0, 0, 0)
            put(ac, 0x21, 1, 1)
        put(ac, 0, 0, 0)

    def flush():
        nonlocal bits
        bits += [1] * (-len(bits) % 8)
        data = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
        bits = []
        return data

    units = [(y, x) for y in range(0, rows, down) for x in range(0, cols, across)]
    for y, x in units:
        if restart and n and n % restart == 0:
            out += flush() + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            before = [0, 0, 0]
        for j in range(down):
            for i in range(across):
                block(0, int(luma[y + j, x + i]) - 128)
        block(1, r.randrange(-20, 20))
        block(2, r.randrange(-20, 20))
        n += 1
    out += flush()
    sof = struct.pack(">BHHB", 8, rows * 8, cols * 8, 3) + bytes([1, across << 4 | down, 0, 2, 0x11, 1, 3, 0x11, 1])
    head = b"\xff\xd8" + avi.segment(0xDB, bytes([0]) + bytes([8] * 64)) + avi.segment(0xDB, bytes([1]) + bytes([9] * 64)) + avi.segment(0xC0, sof)
    head += avi.segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return head + avi.segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize(("across", "down", "restart"), [(1, 1, 0), (2, 1, 0), (2, 2, 0), (2, 2, 3)])
def test_colour_frames_with_standard_tables(across, down, restart):
    luma = np.random.default_rng(2).integers(0, 256, (8, 12))
    got = avi.decode_jpeg(colour_frame(luma, across, down, restart))
    assert got.shape == (64, 96) and (got == np.kron(luma, np.ones((8, 8), int))).all()
    assert avi.decode_frames([colour_frame(luma, across, down, restart), b""])[1].tolist() == luma.ravel().tolist()


def test_unreadable_media_are_rows(spark):
    movie = avi.write_avi(avi.encode_frames(avi.padded(b"x" * 2000)))
    cut = colour_frame(np.full((4, 4), 9), 1, 1)[:-12]
    media = [(1, movie), (2, None), (3, b""), (4, b"junk"), (5, avi.write_avi([b"no frame"])), (6, avi.write_avi([cut])), (7, movie[:-40]), (None, movie), (1, movie)]
    got = avi.clip_rows(spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in media], "doc_id long, media binary")).collect()
    assert sorted(x.doc_id for x in got if x.error) == [3, 4, 5, 6] and all(x.clip is None for x in got if x.error)
    assert sum(x.frames for x in got if x.doc_id == 1) == 2 * 4 and not [x for x in got if x.doc_id == 2] and any(x.doc_id is None for x in got)


def test_a_cut_at_any_frame():
    assert avi.shots([576], 576) == [0, 1]
    assert avi.shots([1, 2, 500, 500, 3, 1], 576) == [0, 3, 4]
    assert avi.shots([10, 12, 9, 11, 60], 576) == [0]  # far above the mean, but a small change


def test_shots(spark):
    dark, light = bytes([10]) * 576, bytes([200]) * 576
    r = np.random.default_rng(1)
    noisy = lambda base: np.clip(np.frombuffer(base, np.uint8).astype(int) + r.integers(-2, 3, 576), 0, 255).astype(np.uint8).tobytes()
    movie = avi.write_avi(avi.encode_frames(b"".join([noisy(dark) for _ in range(10)] + [noisy(light) for _ in range(15)])))
    assert avi.clips(movie) == [(0.0, 0.4, 10), (0.4, 1.0, 15)]
    got = avi.clip_rows(spark.createDataFrame([(1, bytearray(movie)), (2, None)], "doc_id long, media binary")).collect()
    assert [(x.doc_id, x.clip, x.frames) for x in got] == [(1, 0, 10), (1, 1, 15)]
