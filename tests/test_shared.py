"""Joins on hot keys, the shared folder and counts of tasks."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from marl import shared
from marl.operators.best import Best


def test_look_up_meets_hot_and_other_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 2990, F.col("id") % 500).alias("k"), "id")
    counts = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("v"), "k"))
    total = rows.count()
    hot = counts.where(shared.is_hot("n", total)).collect()
    assert [r.k for r in hot] == [7]
    for small in (0, shared.SMALL_ROWS):
        got = shared.look_up(rows, counts, "k", "n", total, small)
        assert set(got.columns) == {"k", "id", "name"} and got.count() == 2990
        assert got.where("name <> concat('v', k)").count() == 0
        assert shared.look_up(rows.limit(0), counts, "k", "n", 0, small).collect() == []


def test_hot_keys_are_few_whatever_the_total(spark):
    for total in (10, 10**6, 10**12):
        bound = next(n for n in (2**i for i in range(60)) if spark.range(1).select(shared.is_hot(F.lit(n), total).alias("h")).first().h)
        assert total / bound <= shared.HOT_KEYS


def test_folder_is_the_sessions(spark):
    path = shared.fresh_path(spark, "kind")
    assert path.startswith(shared.folder(spark)) and "/kind-" in path
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file://"))
    shared.remove(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError):
        shared.folder(SimpleNamespace(sparkContext=context))
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: "hdfs://x/y", master="yarn")
    assert shared.folder(SimpleNamespace(sparkContext=context)) == "hdfs://x/y"


def test_counts_of_tasks(spark):
    assert shared.enough_tasks(spark, 10, 100) == int(spark.conf.get("spark.sql.shuffle.partitions")) and shared.enough_tasks(spark, 10**6, 100) == 10**4
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(10).coalesce(1)
    assert shared.spread(one).rdd.getNumPartitions() == cores and sorted(r.id for r in shared.spread(one).collect()) == list(range(10))
    many = spark.range(10).repartition(cores + 3)
    assert shared.spread(many) is many


def test_best_keeps_the_first_of_equals():
    import numpy as np
    import pyarrow as pa

    best = Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([1.0, 2.0, 5.0]), pa.array(["c", "b", "z"]))
    best.pick()
    best.add(np.array([0, 0, 0]), np.array([1.0, 2.0, 0.5]), pa.array(["a", "a", "a"]))
    found = best.pick().to_pydict()
    assert list(zip(found["question"], found["score"], found["id"])) == [(0, 2.0, "a"), (0, 2.0, "b"), (1, 5.0, "z")]
    assert Best(3, 1).pick() is None


def test_a_scope_deletes_what_was_cut_within(spark):
    def files():
        top = shared.folder(spark).removeprefix("file://")
        return sum(len(names) for _, _, names in os.walk(top))

    before = files()
    with shared.scope(spark):
        inner = shared.cut(spark.range(10).repartition(3))
        path = shared.fresh_path(spark, "kind")
        inner.write.parquet(path)
        with shared.scope(spark):
            assert shared.cut(spark.range(5)).count() == 5
        assert inner.count() == 10 and files() > before
    assert files() == before


@pytest.mark.parametrize("small, bits", [(100, 1 << 24), (0, 1 << 24), (0, 64)])
def test_leave_out_with_and_without_an_exchange(spark, small, bits):
    rows = spark.range(300).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit(1).alias("_place"), F.lit(2).alias("gone_id"))
    gone = spark.createDataFrame([(1, "t1"), (2, "other"), (None, "t20"), (None, None), (1, "t1"), (299, "t299")], "id long, text string")
    left = shared.leave_out(rows, gone, {"id": F.col("id"), "text": F.col("text")}, small, bits)
    assert left.columns == rows.columns and {r.text for r in rows.collect()} - {r.text for r in left.collect()} == {"t1", "t20", "t299"} and left.count() == 297
    assert shared.leave_out(rows, gone.limit(0), {"id": F.col("id")}, small, bits).count() == 300
