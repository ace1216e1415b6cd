"""The pipeline against brute force on a small table, and the operator queries against their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tables import frame
from test_other_operators import brute_targets
from test_text_operators import brute_classes, brute_hits, fold
from tidemark.llm import labelled, toxicity
from tidemark.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def test_all_operators_are_registered():
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert Counter(tuple(r[c] for c in names) for r in QUERIES[name](spark, str(DATA)).collect()) == Counter(theirs.fetchall())


def test_stages(spark, tmp_path):
    r = random.Random(9)
    word = lambda: f"v{r.randrange(4000)}"
    base = [" ".join(word() for _ in range(r.randrange(40, 160))) for _ in range(300)]
    passage = " ".join(f"item{i}" for i in range(20))
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(0, 300, 5):
        rows[i] = (i, rows[i][1] + " slurone insultwo vilethree slurone2")
    rows += [(1000 + i, base[1]) for i in range(5)] + [(2000, base[2] + " " + passage), (2001, passage)]
    labels = [(i, int(i % 5 == 0)) for i in range(300)]
    docs = frame(spark, rows).select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train(now, spark.read.parquet(str(tmp_path / "labels.parquet")), learn=labelled.fold(5) != 0)
    score = {x.doc_id: x.score for x in toxicity.passages(now, model).collect()}
    kept = [(i, t) for i, t in rows if score[i] < 0.5]
    assert {i for i, _ in kept} == {i for i, _ in rows if i >= 1000 or i % 5}
    classes = {i: c for i, c in brute_classes(kept)}
    kept = [(i, t) for i, t in kept if classes[i] == i]
    clean = []
    for i, t in kept:
        hit, _ = brute_hits(fold(t), [("7", fold(passage))], 13)
        if not hit or 20 * len(hit) < len(fold(t)):
            clean.append(i)
    assert 2001 not in clean

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k == 2:
            assert sorted(x.doc_id for x in now.collect()) == sorted(clean)
        if k == 3:
            mixed = Counter(x.doc_id for x in now.collect())
            assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == [*docs.columns, "shard", "slot"]
    got = whole.collect()
    texts = {x.doc_id: x.text for x in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert all(x.text == texts[x.doc_id] for x in got)  # the training set has the texts as they were cut
    assert Counter(x.doc_id for x in got) == mixed
    assert Counter(x.doc_id for x in now.collect()) == mixed
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
    assert left <= {"stage-mixing", "sizes", "keys", "records", "ranges", "pieces"}  # what is not read any more is gone


def odd_documents(spark, rows):
    """Every odd row, with columns that clash with names inside and columns of nested, binary and map type."""
    docs = frame(spark, rows, True)
    return docs.withColumns({
        "nested": F.struct(F.col("doc_id").alias("text"), F.array(F.struct(F.lit(1).alias("a"))).alias("rows")),
        "raw": F.lit(b"\x00\xff"),
        "map": F.create_map(F.lit("k"), F.lit(1)),
        "a b`c": F.lit(1.5),
    })


def test_stages_on_odd_rows(spark, rows, tmp_path):
    docs = odd_documents(spark, rows)
    labels = [(i, int(i % 5 == 0)) for i in range(40)] + [(None, 1), (7, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[9][1]), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, have = docs, len(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert now.columns == [*docs.columns, *(["shard_", "slot_"] if k == 4 else [])], name
        got = now.collect()
        assert all(bytes(x.raw) == b"\x00\xff" and x.map == {"k": 1} and x.nested.text == x.doc_id for x in got)
        if k < 3:
            assert len(got) <= have
            have = len(got)
        if k == 0:
            assert {x.doc_id for x in got if x.text is None} == {100, 108, None} or 100 not in {x.doc_id for x in got}
    assert have and now.where("slot_ IS NULL OR shard_ IS NULL").count() == 0


def test_stages_on_empty_tables(spark, tmp_path):
    docs = odd_documents(spark, [])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


# -- the registered queries on the test tables, against libraries and definitions -------


def texts_of(spark):
    return {x.doc_id: (x.text or "") for x in spark.read.parquet(str(DATA / "documents.parquet")).collect()}


def test_token_queries_equal_the_library(spark):
    texts = texts_of(spark)
    words, pairs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    files = {x.doc_id: x for x in QUERIES["op3_token_files"](spark, str(DATA)).collect()}
    start = 0
    for i in sorted(texts):
        ids = np.array([*words.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    counts = {x.doc_id: x for x in QUERIES["op6_token_counts"](spark, str(DATA)).collect()}
    for i, t in texts.items():
        n = len(pairs.encode(t, add_special_tokens=False).ids)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(t.encode()), n, n > 1024)


def test_score_queries(spark):
    for name, folds, held, label in (("op4_toxicity", 5, 0, "toxic"), ("op5_quality", 3, 1, "quality")):
        sf = str(DATA.parent / "sf0.01")
        truth = {x.doc_id: x[label] for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if x[label] is not None}
        got = QUERIES[name](spark, sf).collect()
        assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % folds == held) for x in got)
        right = [x.predicted == truth[x.doc_id] for x in got if x.held_out and x.doc_id in truth]
        assert len(right) > 50 and sum(right) / len(right) > 0.9


def test_shard_and_mix_queries(spark):
    texts = texts_of(spark)
    slots = {}
    for x in QUERIES["op7_sharding"](spark, str(DATA)).collect():
        t = texts[x.doc_id].encode()
        assert (x.size, x.text_crc32, x.law) == (len(t) + 1, zlib.crc32(t), "bytes") and 0 <= x.shard < 16
        slots.setdefault(x.shard, []).append(x.slot)
    assert sum(map(len, slots.values())) == len(texts) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    source = {x.doc_id: x.source for x in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for x in QUERIES["op8_mixing"](spark, str(DATA)).collect():
        assert x.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[x.doc_id])) and 0 <= x.taken <= 2 * x.size
        sizes[source[x.doc_id]] += x.size
        taken[source[x.doc_id]] += x.taken
        target[source[x.doc_id]] = x.target
    want = brute_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 256 for s in want)


def test_media_query(spark):
    for x in QUERIES["op10_avi"](spark, str(DATA)).collect():
        t = texts_of(spark)[x.doc_id].encode() if x.doc_id < 3 else None
        if t is not None:
            p = t + b"\xff" * (max(576, -(-len(t) // 576) * 576) - len(t))
            assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
