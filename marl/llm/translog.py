"""Transaction log reassembly: associative chunk summaries, a parallel prefix scan over them, chunk-local resolution.

The log is cut into chunks by ranges of its sequence numbers. Each chunk is read once, without knowing what came before it, and
settles what it can: changes that a rollback, abort or commit of the same chunk meets. What is left of a source in a chunk is its
summary: how many transactions end there, how many rollbacks found no savepoint of the chunk (they act on what came before), how
many savepoints are open at its end. A summary is a function of the depth (open savepoints) at which the chunk begins,
max(depth + shift, floor), and such functions compose to such functions: the scan composes them in blocks of `fan`, blocks of blocks
and so on, so that neither a source with most of the rows nor one endless transaction goes through one task. With depths and
transaction numbers known, changes that a chunk left pending meet the first later rollback at their depth (a scan once more) or the
end of their transaction (a join). Commits are numbered over all sources by a scan of their counts; the shared store after each
epoch is a scan of what each epoch changes in it.

Nothing that grows with the log goes to the driver, into a broadcast, or through one task: a task holds one chunk, or blocks of at
most `fan` rows of a key.

Defined results: records are ordered by lsn, those with one lsn by source (null first), op, key and value; a record without lsn has
no place in the log and is left out; null is a source of its own; a change of null value deletes its key, one of null key is told when
it is undone but changes nothing in the store; repeated rows are records of their own; an empty log has no rows; columns that are not
named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, enough_tasks

COMMIT, ABORT, SAVEPOINT, ROLLBACK, CHANGE = range(5)
#: What a chunk tells: changes it saw undone, changes it saw committed, changes left pending, rollbacks without a savepoint of the
#: chunk, the first end of a transaction of each source, a summary of each source, its count of commits.
UNDONE, WRITTEN, PENDING, LOST, END, SUMMARY, COMMITS = range(7)
TOLD = "kind int, chunk int, source string, lsn long, by long, key long, value long, n long, ends long, lost long"
#: More than any count of records, and so seldom added that sums stay in 64 bits.
FAR = 1 << 33


@dataclass(frozen=True)
class LogConfig:
    """chunk_rows: records of a chunk, about; fan: summaries that one step of a scan takes together; epoch: commits of an epoch."""

    chunk_rows: int = 50_000
    fan: int = 256
    epoch: int = 4


@dataclass
class Resolved:
    """undone: (how, lsn, by, key), how being "rollback" or "abort" and by null at the log's end; writes: (commit, lsn, key, value), commits
    numbered from 0 in the order of the log; commits: how many there are."""

    undone: DataFrame
    writes: DataFrame
    commits: int


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One chunk, in the log's order: (chunk, lsn, source, op, key, value)."""
    told: list[tuple] = []
    open_of: dict[str, list[list[tuple]]] = {}  # by source: changes since the start (or since the chunk's), then since each open savepoint
    ends: dict[str, int] = {}
    lost: dict[str, int] = {}
    chunk = commits = None
    for batch in batches:
        for chunk, lsn, source, op, key, value in zip(*(c.to_pylist() for c in batch.columns)):
            held = open_of.setdefault(source, [[]])
            if op == CHANGE:
                held[-1].append((lsn, key, value))
            elif op == SAVEPOINT:
                held.append([])
            elif op == ROLLBACK:
                told += [(UNDONE, chunk, source, c, lsn, k, None, ROLLBACK, None, None) for c, k, _ in held.pop()]
                if not held:
                    held.append([])
                    if source not in ends:
                        told.append((LOST, chunk, source, lsn, None, None, None, lost.get(source, 0), None, None))
                        lost[source] = lost.get(source, 0) + 1
            else:
                commits = commits or 0
                for c, k, v in (x for part in held for x in part):
                    told.append((WRITTEN, chunk, source, c, None, k, v, commits, None, None) if op == COMMIT else (UNDONE, chunk, source, c, lsn, k, None, ABORT, None, None))
                if source not in ends:
                    told.append((END, chunk, source, lsn, None, None, None, commits if op == COMMIT else -1, None, None))
                commits += op == COMMIT
                ends[source] = ends.get(source, 0) + 1
                open_of[source] = [[]]
    for source, held in open_of.items():
        over, gone = ends.get(source, 0), lost.get(source, 0)
        told += [(PENDING, chunk, source, c, None, k, v, depth, over, gone) for depth, part in enumerate(held) for c, k, v in part]
        told.append((SUMMARY, chunk, source, None, None, None, None, len(held) - 1, over, gone))
    if commits:
        told.append((COMMITS, chunk, None, None, None, None, None, commits, None, None))
    if told:
        kinds = [pa.int32(), pa.int32(), pa.string()] + [pa.int64()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told), kinds)], [x.split()[0] for x in TOLD.split(", ")])


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by exchange at every size: both sides grow with the log, so that none is broadcast even while it is small."""
    return left.join(right.hint("merge"), on, how)


def scan(rows: DataFrame, keys: list[str], at: str, length: int, folds: dict[str, tuple[Column, Column]], start: int = 0, fan: int = 256) -> DataFrame:
    """rows with a column for each fold: `start` taken through the functions x -> max(x + shift, floor) of all rows of the same keys that
    come before, by `at`, a number from 0 to below length that rows of one key have once. A null floor never binds.

    Blocks of `fan` rows compose to one function each; blocks are scanned the same way, and what comes before a block then goes
    through the rows before each row of it."""
    names = list(folds)
    rows = rows.select("*", *(c.cast("long").alias(f"_{part}_{n}") for n, pair in folds.items() for part, c in zip(("shift", "floor"), pair)))
    return _scan(rows, keys, at, length, names, start, fan).drop(*(f"_{part}_{n}" for n in names for part in ("shift", "floor")))


def _scan(rows: DataFrame, keys: list[str], at: str, length: int, names: list[str], start: int, fan: int) -> DataFrame:
    deep = length > fan
    if deep:
        rows = cut(rows)
    block = Window.partitionBy(*keys, "_block").orderBy(at)
    found = rows.withColumn("_block", F.floor(F.col(at) / fan))
    found = found.select("*", *(F.sum(f"_shift_{n}").over(block.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_run_{n}") for n in names))
    found = found.select("*", *(F.max(F.col(f"_floor_{n}") - F.col(f"_run_{n}")).over(block.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_top_{n}") for n in names))
    came = {n: F.lit(start).cast("long") for n in names}
    if deep:
        totals = found.groupBy(*keys, "_block").agg(
            *(F.sum(f"_shift_{n}").alias(f"_shift_{n}") for n in names), *((F.sum(f"_shift_{n}") + F.max(F.col(f"_floor_{n}") - F.col(f"_run_{n}"))).alias(f"_floor_{n}") for n in names)
        )
        above = _scan(totals.withColumnRenamed("_block", at), keys, at, -(-length // fan), names, start, fan)
        found = _join(found, above.select(*keys, F.col(at).alias("_block"), *(F.col(n).alias(f"_came_{n}") for n in names)), [*keys, "_block"])
        came = {n: F.col(f"_came_{n}") for n in names}
    before = {n: F.col(f"_run_{n}") - F.col(f"_shift_{n}") for n in names}
    return found.select(*rows.columns, *(F.greatest(came[n] + before[n], F.col(f"_top_{n}") + before[n]).alias(n) for n in names))


def resolve(log: DataFrame, cfg: LogConfig = LogConfig()) -> Resolved:
    """What becomes of every change of a log (lsn long, source string, op int, key long, value long)."""
    known = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # null apart from every name
    narrow = cut(log.where("lsn is not null").select(F.col("lsn").cast("long").alias("lsn"), known.alias("source"), F.col("op").cast("int").alias("op"), F.col("key").cast("long").alias("key"), F.col("value").cast("long").alias("value")))
    order = ["lsn", "source", "op", "key", "value"]
    spark = log.sparkSession
    chunks = enough_tasks(spark, narrow.count(), cfg.chunk_rows)
    dealt = narrow.repartitionByRange(chunks, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("chunk"), *order)
    chunks = max(chunks, dealt._jdf.rdd().getNumPartitions())
    told = cut(dealt.mapInArrow(_chunk, TOLD))
    of = lambda kind: told.where(F.col("kind") == kind)

    summary = of(SUMMARY).select("source", "chunk", "ends", "n", "lost")
    never = F.lit(None).cast("long")
    depth = (F.when(F.col("ends") > 0, -FAR).otherwise(F.col("n") - F.col("lost")), F.col("n"))
    came = cut(scan(summary, ["source"], "chunk", chunks, {"before": (F.col("ends"), never), "depth": depth}, 0, cfg.fan).select("source", "chunk", "before", "depth"))
    offsets = scan(of(COMMITS).select("chunk", "n"), [], "chunk", chunks, {"first": (F.col("n"), never)}, 0, cfg.fan).select("chunk", "first")
    commits = of(COMMITS).agg(F.sum("n")).first()[0] or 0

    above = F.greatest(F.col("depth") - F.col("lost"), F.lit(0))
    pending = _join(of(PENDING), came, ["source", "chunk"]).select("source", "chunk", "lsn", "key", "value", (F.col("before") + F.col("ends")).alias("txn"), F.when(F.col("ends") > 0, F.col("n")).otherwise(above + F.col("n")).alias("level"))
    pending = cut(pending)
    lost = _join(of(LOST), came, ["source", "chunk"]).select("source", F.col("before").alias("txn"), F.greatest(F.col("depth") - F.col("n"), F.lit(0)).alias("level"), "chunk", F.col("lsn").alias("event"))
    over = _join(of(END), came, ["source", "chunk"]).select("source", F.col("before").alias("txn"), F.col("lsn").alias("end"), F.col("n").alias("end_commit"), F.col("chunk").alias("end_chunk"))
    stack = ["source", "txn", "level"]
    marks = pending.select(*stack, "chunk", never.alias("event")).unionByName(lost).groupBy(*stack, "chunk").agg(F.min("event").alias("event"))
    back = F.lit(chunks - 1) - F.col("chunk")
    marks = cut(marks.withColumn("back", back))
    later = scan(marks, stack, "back", chunks, {"next": (F.lit(0), F.when(F.col("event").isNotNull(), F.col("back")))}, -1, cfg.fan)
    events = marks.where("event is not null").select(*stack, F.col("back").alias("next"), F.col("event").alias("undo"))
    settled = _join(_join(_join(pending, later.select(*stack, "chunk", "next"), [*stack, "chunk"]), events, [*stack, "next"], "left"), over, ["source", "txn"], "left")
    settled = cut(settled.select("lsn", "key", "value", "undo", "end", "end_commit", "end_chunk"))

    late = settled.where("undo is not null or end is null or end_commit < 0")
    undone = of(UNDONE).select(F.when(F.col("n") == ROLLBACK, "rollback").otherwise("abort").alias("how"), "lsn", "by", "key")
    undone = undone.unionByName(late.select(F.when(F.col("undo").isNotNull(), "rollback").otherwise("abort").alias("how"), "lsn", F.coalesce("undo", "end").alias("by"), "key"))
    writes = of(WRITTEN).select("chunk", "n", "lsn", "key", "value")
    writes = writes.unionByName(settled.where("undo is null and end_commit >= 0").select(F.col("end_chunk").alias("chunk"), F.col("end_commit").alias("n"), "lsn", "key", "value"))
    return Resolved(undone, _join(writes.where("key is not null"), offsets, ["chunk"]).select((F.col("first") + F.col("n")).alias("commit"), "lsn", "key", "value"), commits)


def stored(writes: DataFrame) -> DataFrame:
    """(key, lsn, value): the store after all commits; lsn is the record that the value comes from."""
    last = F.max_by(F.struct("lsn", "value"), F.struct("commit", "lsn", "value"))
    return writes.groupBy("key").agg(last.alias("w")).where("w.value is not null").select("key", "w.*")


def epoch_states(found: Resolved, cfg: LogConfig = LogConfig()) -> DataFrame:
    """(epoch, keys, total) after each epoch of cfg.epoch commits, from 1: keys stored, and the sum of their values."""
    epochs = -(-found.commits // cfg.epoch)
    spark = found.writes.sparkSession
    latest = F.max_by(F.struct("value"), F.struct("commit", "lsn", "value"))
    writes = cut(found.writes.withColumn("epoch", F.floor(F.col("commit") / cfg.epoch)).groupBy("key", "epoch").agg(latest.alias("w")).select("key", "epoch", F.col("w.value").alias("value")))
    placed = scan(writes, ["key"], "epoch", epochs, {"last": (F.lit(0), F.col("epoch"))}, -1, cfg.fan)
    before = writes.select("key", F.col("epoch").alias("last"), F.col("value").alias("old"))
    delta = _join(placed, before, ["key", "last"], "left").groupBy("epoch").agg(
        F.sum(F.col("value").isNotNull().cast("long") - F.col("old").isNotNull().cast("long")).alias("dn"), F.sum(F.coalesce("value", F.lit(0)) - F.coalesce("old", F.lit(0))).alias("dv")
    )
    every = _join(spark.range(epochs).withColumnRenamed("id", "epoch"), delta, ["epoch"], "left").select("epoch", F.coalesce("dn", F.lit(0)).alias("dn"), F.coalesce("dv", F.lit(0)).alias("dv"))
    never = F.lit(None).cast("long")
    sums = scan(every, [], "epoch", epochs, {"n": (F.col("dn"), never), "v": (F.col("dv"), never)}, 0, cfg.fan)
    return sums.select((F.col("epoch") + 1).alias("epoch"), (F.col("n") + F.col("dn")).alias("keys"), (F.col("v") + F.col("dv")).alias("total"))


def document_log(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents as records: the op and key follow from crc32 of doc_id, the value is the crc32 of `key:text`, null if the text is null or toxic."""
    toxic = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("lsn")).distinct().withColumn("toxic", F.lit(True))
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    kind = F.col("h") % 23
    op = F.when(kind <= 1, COMMIT).when(kind == 2, ABORT).when(kind <= 4, SAVEPOINT).when(kind <= 6, ROLLBACK).otherwise(CHANGE)
    key = F.floor(F.col("h") / 100) % 300
    text = F.col("text").cast("string")
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("lsn"), F.col("source").cast("string").alias("source"), h.alias("h"), text.alias("text"))
    rows = rows.select("lsn", "source", op.alias("op"), F.when(op == CHANGE, key).alias("key"), F.when(op == CHANGE, F.crc32(F.concat(key.cast("string"), F.lit(":"), text))).alias("value"))
    return _join(rows, toxic, ["lsn"], "left").withColumn("value", F.when(F.col("toxic").isNull(), F.col("value"))).drop("toxic")
