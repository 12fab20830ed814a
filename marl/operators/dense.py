"""Exhaustive inner-product search: blocks of queries, of bounded size, against the vectors of every task.

A vector that is null or has a null, infinite or NaN component, or no id, or no corpus where corpora are named, takes no part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..shared import cut
from .best import Best, ranked

#: Bytes of query vectors that a task holds at a time, and products that it makes at a time.
BLOCK_BYTES, PRODUCTS = 32 << 20, 1 << 18


def usable(rows: DataFrame, key: str, column: str, name: str, normalize: bool, corpus: str | None) -> DataFrame:
    """(name, corpus_id, v): vectors with an id, as doubles, of unit length if asked for (zero vectors stay)."""
    v = F.col(column).cast("array<double>")
    if normalize:
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        unit = F.transform("v", lambda x: x / F.when(F.col("length") > 0, F.col("length")).otherwise(1.0))
    own = F.col(corpus) if corpus else F.lit(0).cast("long")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.where(F.col(column).isNotNull() & F.col(key).isNotNull() & own.isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).alias(name), own.alias("corpus_id"), v.alias("v"))
    return found.withColumn("length", length).select(name, "corpus_id", unit.alias("v")) if normalize else found


def _products(block: pa.Table, k: int, digits: int, kind: pa.DataType):
    lengths = block["v"].combine_chunks().value_lengths().to_numpy()
    every = np.array(block["question_id"].to_pylist(), dtype=object)
    corpus = block["corpus_id"].to_numpy()
    groups = {}
    for dim, own in set(zip(lengths.tolist(), corpus.tolist())):
        at = np.flatnonzero((lengths == dim) & (corpus == own))
        groups[dim, own] = (at, block["v"].combine_chunks().take(pa.array(at)).flatten().to_numpy().reshape(-1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, len(every))
        for batch in batches:
            size, own = batch.column("v").value_lengths().to_numpy(), batch.column("corpus_id").to_numpy(zero_copy_only=False)
            for (dim, mine), (of, queries) in groups.items():
                rows = np.flatnonzero((size == dim) & (own == mine))
                step = max(1, PRODUCTS // len(of))
                for at in range(0, len(rows), step):
                    part = pa.array(rows[at : at + step])
                    v = batch.column("v").take(part).flatten().to_numpy().reshape(-1, dim)
                    score = np.round(queries @ v.T, digits)
                    q, r = np.nonzero(score >= best.floor[of][:, None])
                    best.add(of[q], score[q, r], batch.column("passage_id").take(part).take(pa.array(r)))
        found = best.pick()
        if found is not None:
            columns = [pa.array(every[found["question"].to_numpy()].tolist(), kind), found["id"].combine_chunks(), found["score"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, ["question_id", "passage_id", "score"])

    return run


def search(
    queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", query_key: str | None = None,
    normalize: bool = False, digits: int = 6, corpus: str | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(question_id, passage_id, score, rank): the k largest inner products of each query, ties by id. Only vectors of one length, and of one
    corpus where a column of corpora is named, are compared. normalize: vectors of unit length, so that products are cosines."""
    asked = cut(usable(queries, query_key or key, column, "question_id", normalize, corpus))
    known = usable(vectors, key, column, "passage_id", normalize, corpus)
    total = asked.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    schema = StructType([asked.schema["question_id"], known.schema["passage_id"]]).add("score", "double")
    kind = to_arrow_type(asked.schema["question_id"].dataType)
    hits = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i).toArrow()
        part = known.mapInArrow(_products(block, k, digits, kind), schema) if block.num_rows else asked.sparkSession.createDataFrame([], schema)
        part = cut(part) if blocks > 1 else part  # k hits of a query and task: the block itself is let go
        hits = part if hits is None else hits.unionByName(part)
    return ranked(hits, k)
