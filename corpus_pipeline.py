"""A training corpus from ``documents``: five operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echofold.llm import decontaminate, minhash_forest, mixing, substring_dedup, toxicity
from echofold.llm.entries import MAX_REPETITION, TARGET_ENTROPY
from echofold.runtime import release, scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network trained on the labels does not call toxic."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return minhash_forest.without_copies(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has."""
    return substring_dedup.without_repeats(docs, length=50)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of the documents that are left, with their columns: the text as it was cut, lang and so on."""
    return mixing.mix(docs, entropy=TARGET_ENTROPY, repetition=MAX_REPETITION, carried=tuple(docs.columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("benchmark leaks", drop_leaks),
    ("mixing", mix_sources),
]

#: A trained network is not SQL. tests/llm holds every stage, and the whole, against plain versions on small rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's input and what it wrote on its
    way are dropped when it is done."""
    before, docs = None, table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), kept=True)
        if before is not None:
            release(before)
        before = docs
    return docs
