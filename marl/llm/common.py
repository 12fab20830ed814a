"""Shared helpers: tables, and connected components over link tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import SMALL_ROWS, cut, enough_tasks, fresh_path, leave_out, look_up, remove, spread

__all__ = ["connected_components", "cut", "enough_tasks", "fresh_path", "leave_out", "local_forest", "look_up", "read_all", "remove", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, smallest node of its component) of the links of one task, without the roots."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def read_all(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [x for x in batches if x.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = read_all(batches)
    if found is not None:
        u, v = local_forest(found["u"].to_numpy(), found["v"].to_numpy())
        yield pa.RecordBatch.from_pydict({"u": u, "v": v})


def connected_components(links: DataFrame, small: int = SMALL_ROWS) -> DataFrame:
    """Rows (node, root) for every node of a component that isn't its smallest node.

    links: (u long, v long), in any direction, repeats allowed. Each task first reduces its own
    links to a star forest; large-star and small-star rounds then run until nothing moves. The
    edge table is written between rounds, nothing but two totals reaches the driver. A node with a
    hot share of the links gets its least neighbour by broadcast, so that no task holds a hub's links;
    up to `small` links all nodes get it so.
    """
    edges = links.select("u", "v").where("u <> v").mapInArrow(_shrink, "u long, v long")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = look_up(both.where("v > u"), low, "u", "n", 2 * state[0], small).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        star = look_up(large, low, "u", "n", 2 * state[0], small).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(star.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
