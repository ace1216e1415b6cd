"""The corpus pipeline: from raw documents to a sharded, mixed, clean training set.

Each stage calls one operator of ``tidemark.llm`` and works on all documents
that the stage before kept.  All stages but the last return the columns of
``documents``.  SQL can express neither a learnt score nor signatures, so there
is no SQL for the whole; the tests hold ``run`` against a brute-force version.

Defined cases, in every stage: an empty table gives an empty one; extra columns
of any type and name pass unchanged; very long texts are worked on whole; rows
need no order, ties are broken by doc_id and text.  Null and empty texts pass
all filters but mixing, which takes whole words and so none of them.  Repeated
rows are judged alike: toxicity and decontamination keep or drop all of them,
near-duplicates keep one, or one for each class where texts differ.  A null
doc_id is a value like any other and gives way to one that is not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontam, labelled, minhash, mixing, sharding, toxicity
from tidemark.llm.common import documents, release, scratch, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"), learn=labelled.fold(5) != 0)
    return toxicity.reject(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of least doc_id."""
    return minhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; passages of the benchmark are cut out of the others."""
    return decontam.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mixture(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of every row of the mix, and its shard and slot: the training set.

    The two columns get an underscore if the documents have columns of their names.
    """
    names = [x + "_" * (x in docs.columns) for x in ("shard", "slot")]
    return sharding.sharded(docs).select("record.*", *[F.col(a).alias(b) for a, b in zip(("shard", "slot"), names)])


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next.

    What a stage wrote besides its result goes when the result stands, and its input when the next result stands.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(path)
        if before:
            release(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
