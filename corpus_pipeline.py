"""A training-data pipeline of five operators: toxicity filter, SimHash near-dedup, substring dedup, benchmark
decontamination, and byte-level BPE encoding. Each stage works on all that its predecessor kept, written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marl.llm import bpe, decontaminate, fmindex, simhash, toxicity
from marl.llm.common import fresh_path, remove, table
from marl.llm.settings import toxicity_model, vocabulary_path
from marl.llm.text import as_bytes


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return simhash.near_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more that a document with a smaller doc_id has, too."""
    return fmindex.dedup_words(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with byte offsets, and digests of the ids and of what they decode to."""
    return as_bytes(docs).mapInArrow(bpe.encode_decode(vocabulary_path(), ids=True), bpe.BOTH)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the trained classifier nor the merges; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # what the stage read is no longer needed once its own result is written
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
