"""Okapi BM25 over an index of passages, for many questions at once.

The index has one row for each passage: its size, its distinct terms and their counts. It is made in one pass over the
texts without an exchange, can be kept as Parquet, and all statistics follow from it. A search sends the weighted terms of
the questions, in blocks of bounded size, to the tasks that read the index; each task keeps the k best passages of every
question. Passages and questions may belong to corpora: statistics are those of a corpus, and questions see their own only.

A passage or question without an id, or without a corpus where corpora are named, takes no part. Null and empty texts have no terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text
from ..shared import cut, look_up, pieces
from .best import Best, ranked

#: Words that a task looks at in one go, and pairs of a word and a question that it scores in one go.
WORDS, PAIRS = 1 << 18, 1 << 18


@dataclass(frozen=True)
class Bm25Config:
    """floor: terms in more than half of the passages get this share of the mean idf in place of their negative one. block: weighted terms
    of questions that a task holds at a time."""

    k1: float = 1.5
    b: float = 0.75
    floor: float = 0.25
    block: int = 1_000_000


def passages(rows: DataFrame, key: str, column: str, corpus: str | None = None) -> DataFrame:
    """(corpus_id, passage_id, terms); without a column of corpora all passages are one corpus, 0."""
    own = F.col(corpus) if corpus else F.lit(0).cast("long")
    return rows.where(F.col(key).isNotNull() & own.isNotNull()).select(own.alias("corpus_id"), F.col(key).alias("passage_id"), text.tokens(column).alias("terms"))


def _shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many WORDS at most."""
    for batch in batches:
        for start, stop in pieces(pc.fill_null(batch.column("terms").value_lengths(), 0).to_numpy(), WORDS):
            yield batch.slice(start, stop - start)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _shorter(batches):
        lists = batch.column("terms")
        size = pc.fill_null(lists.value_lengths(), 0).to_numpy()
        coded = lists.flatten().dictionary_encode()
        width = max(1, len(coded.dictionary))
        place, count = np.unique(np.repeat(np.arange(len(size)), size) * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        offsets = pa.array(np.searchsorted(place, np.arange(len(size) + 1) * width), pa.int32())
        terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(place % width)))
        counts = pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("corpus_id"), batch.column("passage_id"), pa.array(size, pa.int32()), terms, counts], ["corpus_id", "passage_id", "size", "terms", "counts"])


def index(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(corpus_id, passage_id, size, terms, counts) of passages(), written to path, or to the shared folder for as long as the session lasts."""
    schema = StructType([rows.schema["corpus_id"], rows.schema["passage_id"], StructField("size", IntegerType()), StructField("terms", ArrayType(StringType())), StructField("counts", ArrayType(IntegerType()))])
    made = rows.mapInArrow(_counted, schema)
    if path is None:
        return cut(made)
    made.write.parquet(path)
    return read_index(rows.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def inverse_frequencies(indexed: DataFrame, cfg: Bm25Config = Bm25Config()) -> DataFrame:
    """(corpus_id, term, df, idf, mean_size) for every term; the counts combine before they are exchanged."""
    df = cut(indexed.select("corpus_id", F.explode("terms").alias("term")).groupBy("corpus_id", "term").agg(F.count("*").alias("df")))
    sizes = indexed.groupBy("corpus_id").agg(F.count("*").alias("passages"), F.avg("size").alias("mean_size"))
    terms = df.groupBy("corpus_id").agg(F.count("*").alias("n"))
    total = df.count()
    raw = look_up(df, sizes.join(terms, "corpus_id"), "corpus_id", "n", total)
    raw = raw.withColumn("raw", F.log(F.col("passages") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # a step from df, which is written
    mean = raw.groupBy("corpus_id").agg(F.avg("raw").alias("mean"), F.count("*").alias("n"))
    floored = F.when(F.col("raw") < 0, cfg.floor * F.col("mean")).otherwise(F.col("raw"))
    return look_up(raw, mean, "corpus_id", "n", total).select("corpus_id", "term", "df", floored.alias("idf"), "mean_size")


def weights(questions: DataFrame, indexed: DataFrame, cfg: Bm25Config = Bm25Config()) -> DataFrame:
    """(corpus_id, term, question_id, weight, mean_size): what a question's terms weigh in its corpus. questions: (question_id, question[, corpus_id])."""
    own = F.col("corpus_id") if "corpus_id" in questions.columns else F.lit(0).cast("long")
    asked = questions.where(F.col("question_id").isNotNull() & own.isNotNull()).select(own.alias("corpus_id"), "question_id", F.explode(text.tokens("question")).alias("term")).groupBy("corpus_id", "term", "question_id").agg(F.count("*").alias("times"))
    known = inverse_frequencies(indexed, cfg)
    return asked.join(known, ["corpus_id", "term"]).select("corpus_id", "term", "question_id", (F.col("times") * F.col("idf")).alias("weight"), "mean_size")


def _scored(block: pa.Table, k: int, digits: int | None, cfg: Bm25Config, kind: pa.DataType):
    """Scores all passages of a task for the questions of a block: sums over (passage, question) pairs of what they share."""
    names, question = np.unique(block["question_id"].to_numpy(), return_inverse=True)
    terms = block["term"].combine_chunks().dictionary_encode()
    corpora, corpus = np.unique(block["corpus_id"].to_numpy(), return_inverse=True)
    key = corpus * len(terms.dictionary) + terms.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    first = np.append(first, len(order))
    question, weight, mean = question[order], block["weight"].to_numpy()[order], block["mean_size"].to_numpy()[order]
    dictionary = terms.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, len(names))
        for batch in _shorter(batches):
            ids, lists = batch.column("passage_id"), batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=dictionary), -1).to_numpy()
            theirs = batch.column("corpus_id").to_numpy(zero_copy_only=False)
            own = np.searchsorted(corpora, theirs)
            own[corpora[np.minimum(own, len(corpora) - 1)] != theirs] = -1
            asked = np.flatnonzero((code >= 0) & (own[row] >= 0))
            wanted = own[row[asked]] * len(dictionary) + code[asked]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            asked, at = asked[keys[at] == wanted], at[keys[at] == wanted]
            many = first[at + 1] - first[at]
            count, size = batch.column("counts").flatten().to_numpy(), batch.column("size").to_numpy()
            for start, stop in pieces(np.bincount(row[asked], many, batch.num_rows).astype(np.int64), PAIRS):
                some = slice(*np.searchsorted(row[asked], [start, stop]))
                each = many[some]
                posting = np.repeat(asked[some], each)
                pair = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[at[some]], each)
                tf, of_row = count[posting].astype(np.float64), row[posting]
                part = weight[pair] * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * size[of_row] / mean[pair]))
                met, of = np.unique(of_row * len(names) + question[pair], return_inverse=True)
                score = np.bincount(of, part, len(met))
                if digits is not None:
                    score = np.round(score, digits)
                good = np.flatnonzero(score > 0)
                best.add(met[good] % len(names), score[good], ids.take(pa.array(met[good] // len(names))))
        found = best.pick()
        if found is not None:
            columns = [pa.array(names[found["question"].to_numpy()], kind), found["id"].combine_chunks(), found["score"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, ["question_id", "passage_id", "score"])

    return run


def search(questions: DataFrame, indexed: DataFrame, k: int, digits: int | None = 6, cfg: Bm25Config = Bm25Config()) -> DataFrame:
    """(question_id, passage_id, score, rank): the k best passages with a positive score of each question, ties by passage_id.

    Tasks hold the weights of one block of questions, and so does the driver: more questions make more blocks, each one more pass over the
    index, which is over and written before the next block is read."""
    found = cut(weights(questions, indexed, cfg))
    blocks = max(1, -(-found.count() // cfg.block))
    schema = StructType([questions.schema["question_id"], indexed.schema["passage_id"]]).add("score", "double")
    kind = to_arrow_type(schema["question_id"].dataType)
    hits = None
    for i in range(blocks):
        block = found.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i).toArrow()
        part = indexed.mapInArrow(_scored(block, k, digits, cfg, kind), schema) if block.num_rows else found.sparkSession.createDataFrame([], schema)
        part = cut(part) if blocks > 1 else part  # k hits of a question and task: the block itself is let go
        hits = part if hits is None else hits.unionByName(part)
    return ranked(hits, k)


def token_overlap(question: str, passage: str):
    """Share of a question's distinct terms that a passage has: the default of the reranker, which any column can replace."""
    q, p = F.array_distinct(text.tokens(question)), F.array_distinct(text.tokens(passage))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(0.0)
