"""The registered queries opN_<name> and their SQL.

Each query applies its operator, with production parameters, to the whole
table and returns the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import avi, bpe_count, decontam, labelled, minhash, mixing, quality, sharding, substring, token_files, toxicity
from .common import documents, spread


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(spread(documents(spark, sf_dir)), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, manifest)


def predictions(scores: DataFrame, folds: int, held: int) -> DataFrame:
    return scores.select("doc_id", F.coalesce(labelled.fold(folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"), learn=labelled.fold(5) != 0)
    return predictions(toxicity.passages(docs, model), 5, 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    model = quality.train(docs, documents(spark, sf_dir, "labels"), learn=labelled.fold(3) != 1)
    return predictions(quality.scored(docs, model), 3, 1)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(spread(documents(spark, sf_dir)), public_tokenizers.path("byte_bpe_50k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(documents(spark, sf_dir), keep_text=False)


def op10_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digests(spread(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_bag_minhash": op2_bag_minhash,
    "op3_token_files": op3_token_files,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_avi": op10_avi,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH folded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op2_bag_minhash": r"""
WITH RECURSIVE folded AS (SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
named AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w, CASE WHEN len(w) = 0 THEN text END) AS id, w FROM folded),
texts AS (SELECT id, any_value(w) AS w FROM named WHERE len(w) > 0 GROUP BY id),
grams AS (SELECT id, g, count(*) AS n FROM (SELECT id, w[i:i + least(5, len(w)) - 1] AS g FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM texts)) GROUP BY ALL),
sizes AS (SELECT id, sum(n) AS total FROM grams GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 5 * shared >= 4 * (x.total + y.total - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT DISTINCT id, id FROM named UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
classes AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id)
SELECT doc_id, class_id FROM named JOIN classes USING (id) UNION ALL SELECT doc_id, doc_id FROM documents WHERE text IS NULL""",
    "op9_substring_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM later),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)""",
}
