"""A persisted vector index: cells around centroids, written once, and exact top-k by bounds on what a cell can hold.

Centroids come from a bounded sample; every vector is dealt to its nearest one. A cell knows its centroid c and the distance r of its
farthest vector: no inner product of a query q with a vector of the cell exceeds q.c + |q| r. Cells whose bound stays below the k-th
best product found so far are never read. Results are those of dense.search over all vectors, whatever the centroids.

A vector that is null or has a null, infinite or NaN component, no id or another length than the index takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, fresh_path
from .blocks import Pruned, pruned_search
from .dense import usable

#: Vectors that centroids are made of at most, rounds in which they settle, centroids at most (their table goes to every task).
SAMPLE, ROUNDS, CENTROIDS = 20_000, 4, 4096
#: Vectors of a part of a cell, which one task reads at a time.
PART = 20_000


@dataclass
class CellIndex:
    """vectors: (cell, part, passage_id, v), by cell; cells: (cell, n, parts, centroid, radius)."""

    vectors: DataFrame
    cells: DataFrame


def _centroids(sample: np.ndarray, many: int) -> np.ndarray:
    """Means of the sample's vectors nearest to each other, in a few rounds from evenly spaced ones."""
    found = sample[np.linspace(0, len(sample) - 1, min(many, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (sample @ found.T - 0.5 * (found**2).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=len(found))
        found[count > 0] = sums[count > 0] / count[count > 0, None]
    return found


def _deal(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            cell = (v @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)
            far = np.sqrt(((v - centroids[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), batch.column("passage_id"), batch.column("v"), pa.array(far)], ["cell", "passage_id", "v", "far"])

    return run


def build(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", path: str | None = None, each: int = 500) -> CellIndex:
    """The index of vectors of one length (the most frequent), about `each` of them to a cell, written to path or to the shared folder."""
    spark = vectors.sparkSession
    path = fresh_path(spark, "cells") if path is None else path
    known = cut(usable(vectors, key, column, "passage_id", False, None).select("passage_id", "v"))
    sizes = known.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["n"]) if sizes else (1, 0)
    known = known.where(F.size("v") == dim)
    drawn = known.orderBy(F.xxhash64("passage_id"), "passage_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = drawn.flatten().to_numpy().reshape(-1, dim) if n else np.zeros((1, dim))
    centroids = _centroids(sample, min(CENTROIDS, max(1, -(-n // each))))
    kind = known.schema["passage_id"].dataType.simpleString()
    dealt = cut(known.mapInArrow(_deal(centroids), f"cell long, passage_id {kind}, v array<double>, far double"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell long, centroid array<double>")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART)).join(F.broadcast(table), "cell")
    cells.write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    rows = dealt.join(F.broadcast(cells.select("cell", "parts")), "cell")  # CENTROIDS rows at most
    rows = rows.select("cell", F.pmod(F.xxhash64("passage_id", "v"), "parts").alias("part"), "passage_id", "v")
    rows.repartition("cell", "part").sortWithinPartitions("cell").write.parquet(f"{path}/vectors")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> CellIndex:
    return CellIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"))


def _products(digits: int, k: int, kinds: tuple):
    names = ["question_id", "passage_id", "score"]

    def run(_key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([pa.array([], t) for t in (*kinds, pa.float64())], names)
        if not vectors.num_rows or not queries.num_rows:
            return empty
        v = vectors["v"].combine_chunks().flatten().to_numpy().reshape(vectors.num_rows, -1)
        q = queries["q"].combine_chunks().flatten().to_numpy().reshape(queries.num_rows, -1)
        ids, asked, parts = vectors["passage_id"].combine_chunks(), queries["question_id"].combine_chunks(), []
        step = max(1, (4 << 20) // max(1, len(v)))
        for at in range(0, len(q), step):
            score = np.round(q[at : at + step] @ v.T, digits)
            keep = min(k, len(v)) - 1
            floor = -np.partition(-score, keep, axis=1)[:, keep]  # ties of the k-th stay
            a, b = np.nonzero(score >= floor[:, None])
            parts.append(pa.Table.from_arrays([asked.take(pa.array(at + a)), ids.take(pa.array(b)), pa.array(score[a, b])], names))
        return pa.concat_tables(parts)

    return run


def search(queries: DataFrame, indexed: CellIndex, k: int, key: str = "vec_id", column: str = "embedding", digits: int = 6, first: int = 2) -> Pruned:
    """The k largest inner products of each query, ties by id, and which cells were read for them."""
    from pyspark.sql.pandas.types import to_arrow_type

    asked = cut(usable(queries, key, column, "question_id", False, None).select("question_id", F.col("v").alias("q")))
    dot = F.aggregate(F.zip_with("q", "centroid", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    long = F.sqrt(F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x * x))
    # CENTROIDS rows at most, whatever the count of vectors
    met = asked.join(F.broadcast(indexed.cells), F.size("q") == F.size("centroid"))
    # a little more than the bound, for what sums of doubles lose
    bounds = met.select("question_id", F.col("cell").alias("block"), (dot + long * F.col("radius") + (F.abs(dot) + long * F.col("radius")) * 1e-9).alias("bound"))
    schema = f"question_id {asked.schema['question_id'].dataType.simpleString()}, passage_id {indexed.vectors.schema['passage_id'].dataType.simpleString()}, score double"
    kinds = (to_arrow_type(asked.schema["question_id"].dataType), to_arrow_type(indexed.vectors.schema["passage_id"].dataType))

    def score(pairs: DataFrame) -> DataFrame:
        wanted = pairs.withColumnRenamed("block", "cell").join(F.broadcast(indexed.cells.select("cell", "parts")), "cell")
        wanted = wanted.join(asked, "question_id").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "question_id", "q")
        return indexed.vectors.groupBy("cell", "part").cogroup(wanted.groupBy("cell", "part")).applyInArrow(_products(digits, k, kinds), schema)

    return pruned_search(bounds, score, k, first, 2 * 10.0**-digits)
