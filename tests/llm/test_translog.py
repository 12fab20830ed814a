"""Log reassembly against a sequential replay, over logs cut into many small chunks and scanned in small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from marl.llm import translog as t

LOG = "lsn long, source string, op int, key long, value long"


def replay(rows, epoch):
    none_first = lambda x: (x is not None, x)
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], *((v is not None, v or 0 if not isinstance(v, str) else v) for v in r[1:])))
    held_by, undone, store, states, n = {}, [], {}, [], 0
    for lsn, source, op, key, value in rows:
        held = held_by.setdefault(source, [[]])
        if op == t.CHANGE:
            held[-1].append((lsn, key, value))
        elif op == t.SAVEPOINT:
            held.append([])
        elif op == t.ROLLBACK:
            undone += [("rollback", c, lsn, k) for c, k, _ in held.pop()]
            if not held:
                held.append([])
        else:
            every = [x for part in held for x in part]
            held_by[source] = [[]]
            if op == t.ABORT:
                undone += [("abort", c, lsn, k) for c, k, _ in every]
                continue
            for _, k, v in every:
                if v is None or k is None:
                    store.pop(k, None)
                else:
                    store[k] = v
            n += 1
            if n % epoch == 0:
                states.append((n // epoch, len(store), sum(store.values())))
    if n % epoch:
        states.append((n // epoch + 1, len(store), sum(store.values())))
    undone += [("abort", c, None, k) for held in held_by.values() for part in held for c, k, _ in part]
    return sorted(undone, key=repr), states, store


def made(seed, n, weights, sources):
    r = random.Random(seed)
    ops = r.choices(range(5), weights, k=n)
    return [(i, r.choice(sources), op, r.choice([None, *range(6)]) if op == t.CHANGE else None, r.choice([None, r.randrange(100)]) if op == t.CHANGE else None) for i, op in zip(r.sample(range(10**6), n), ops)]


CASES = [
    (made(1, 240, [2, 1, 2, 2, 16], [None, "", "a", "b"]), t.LogConfig(20, 3, 4)),  # many sources, one of them null
    (made(2, 240, [1, 1, 30, 28, 50], ["a"]), t.LogConfig(20, 4, 3)),  # deep savepoints that cross chunks
    (made(3, 240, [0, 0, 5, 6, 10], ["a", "b"]), t.LogConfig(30, 16, 4)),  # transactions without an end
    (made(4, 120, [1, 0, 0, 0, 1], ["a"]) + [(None, "a", t.COMMIT, None, None)] * 3, t.LogConfig(20, 16, 4)),  # records without a place
    ([], t.LogConfig()),
]


@pytest.mark.parametrize("rows, cfg", CASES)
def test_against_a_replay(spark, rows, cfg):
    log = spark.createDataFrame(rows, LOG).withColumn("_block", F.lit(1)).withColumn("chunk", F.lit("x"))
    found = t.resolve(log, cfg)
    undone, states, store = replay(rows, cfg.epoch)
    assert sorted((tuple(r) for r in found.undone.collect()), key=repr) == undone
    assert sorted(tuple(r) for r in t.epoch_states(found, cfg).collect()) == states
    assert {r.key: r.value for r in t.stored(found.writes).collect()} == store


def test_repeated_records_are_records(spark):
    rows = [(1, "a", t.CHANGE, 1, 5)] * 3 + [(2, "a", t.ROLLBACK, None, None)] * 2 + [(3, "a", t.CHANGE, 2, 7)] * 2 + [(4, "a", t.COMMIT, None, None)] * 2
    found = t.resolve(spark.createDataFrame(rows, LOG), t.LogConfig(2, 2, 1))
    assert [tuple(r) for r in found.undone.collect()] == [("rollback", 1, 2, 1)] * 3
    assert sorted(tuple(r) for r in t.epoch_states(found, t.LogConfig(2, 2, 1)).collect()) == [(1, 1, 7), (2, 1, 7)]


def test_scan_equals_a_fold(spark):
    r = random.Random(5)
    rows = [(k, i, r.randrange(-3, 3), r.choice([None, r.randrange(4)])) for k in ("a", "b") for i in r.sample(range(40), 30)]
    df = spark.createDataFrame(rows, "k string, i int, s long, f long")
    got = {(x.k, x.i): x.out for x in t.scan(df, ["k"], "i", 40, {"out": (F.col("s"), F.col("f"))}, 1, 3).collect()}
    for k in ("a", "b"):
        now = 1
        for _, i, s, f in sorted(x for x in rows if x[0] == k):
            assert got[k, i] == now
            now = now + s if f is None else max(now + s, f)


def test_documents_as_records(spark):
    docs = spark.createDataFrame([(5, None, "s"), (None, "x", "s"), (6, "y", None), (6, "y", None)], "doc_id long, text string, source string").withColumn("lsn", F.lit(0))
    labels = spark.createDataFrame([(6, 1), (6, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    rows = t.document_log(docs, labels).collect()
    assert sorted(r.lsn for r in rows) == [5, 6, 6] and all(r.value is None for r in rows)
