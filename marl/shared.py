"""Intermediate tables in the folder that driver and executors share, and joins that no hot key holds up."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are looked up by broadcast at most, and rows of a key below which it never is.
HOT_KEYS, LEAST_ROWS = 10_000, 100
#: Rows up to which a whole table of a few numbers is broadcast (some 10 MB as a hash table).
SMALL_ROWS = 200_000


def folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A temporary folder takes its place on a local master only (tests): executors of a cluster could not see it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='marl-shared-')}")
        found = context.getCheckpointDir()
    return found.replace("file:/", "file:///") if found.startswith("file:/") and not found.startswith("file://") else found


#: Paths of intermediate tables made within the innermost scope.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """All intermediate tables that are made within (by cut and fresh_path) are deleted at its end. What is read from them must be done by
    then: collected, or written elsewhere. Scopes may lie within each other. Outside of any scope tables stay for as long as the shared folder
    does, since a DataFrame that was returned may still read them (spark.cleaner.referenceTracking.cleanCheckpoints lets Spark delete those of
    cut once nothing refers to them)."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            remove(spark, path)


def fresh_path(spark: SparkSession, kind: str) -> str:
    path = f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if _scope.get() is not None:
        _scope.get().append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_path named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df and continues from there: what several plans read is computed once, and a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    found = df.checkpoint(eager=True)
    if _scope.get() is not None:
        kept = found._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if kept.isDefined():
            _scope.get().append(kept.get())
    return found


def unused(df: DataFrame, stem: str, *more: DataFrame) -> str:
    """A name that no column of the tables has, in whatever case, so that helpers never clash with a caller's columns."""
    taken = {c.lower() for d in (df, *more) for c in d.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the session's cores if it has fewer partitions: a file with one row group is read by one task, whatever its size.
    Inputs with a partition for each core stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of stretches of rows, in order and all of them, whose sizes sum to `most` at most; a larger row is a stretch of its own.
    What a task holds at a time then follows from `most`, not from how long the rows of an Arrow batch are."""
    sums, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(sums, sums[at] + most, side="right")) - 1)
        yield at, stop
        at = stop


def enough_tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows that a task has about `each` of them, as many as the session asks for at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def is_hot(count: Column | str, total: int, keys: int = HOT_KEYS) -> Column:
    """Whether a key has so many of `total` rows that at most `keys` keys can have as many."""
    return (F.col(count) if isinstance(count, str) else count) > max(LEAST_ROWS, -(-total // max(1, keys)))


def look_up(rows: DataFrame, side: DataFrame, key: str, count: str, total: int, small: int = SMALL_ROWS, keys: int = HOT_KEYS) -> DataFrame:
    """rows joined with side, which has each key once and in `count` how many of the `total` rows have it.

    Rows of hot keys meet their row of side by broadcast, of at most `keys` rows whatever the input; the others by an exchange. Where there
    are no more than `small` rows at all, and so no more in side, all of side is broadcast."""
    if total <= small:
        return rows.join(F.broadcast(side.drop(count)), key)
    hot = F.broadcast(side.where(is_hot(count, total, keys)).drop(count))
    cold = side.where(~is_hot(count, total, keys)).drop(count)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(cold, key))


#: Bits of the set that stands for keys too many to be broadcast themselves: 2 MB, in rows of 64.
BITS = 1 << 24


def leave_out(rows: DataFrame, gone: DataFrame, same: dict[str, Column], small: int = SMALL_ROWS, bits: int = BITS) -> DataFrame:
    """rows without those that a row of gone matches; same: for each of gone's columns the expression over rows that equals it (nulls equal nulls).

    rows may be wide and are not exchanged where that can be helped: up to `small` keys of gone are broadcast. Beyond, a set of `bits` bits of
    their hashes is, whatever their number; rows whose bit is not set stay where they are, and only the others meet gone by an exchange."""
    names = {c: unused(rows, f"gone_{c}") for c in same}
    gone = cut(gone.select(*(F.col(c).alias(n) for c, n in names.items())).distinct())
    match = F.lit(True)
    for c, n in names.items():
        match = match & same[c].eqNullSafe(F.col(n))
    if gone.count() <= small:
        return rows.join(F.broadcast(gone), match, "left_anti")
    place, mask, word = unused(rows, "place"), unused(rows, "mask"), unused(rows, "word")
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    hashed = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits))
    kinds = {n: gone.schema[n].dataType for n in names.values()}
    marks = gone.select(hashed([F.col(n) for n in names.values()]).alias(place)).groupBy(F.floor(F.col(place) / 64).alias(word)).agg(F.bit_or(one(F.col(place))).alias(mask))
    told = rows.withColumn(place, hashed([same[c].cast(kinds[n]) for c, n in names.items()]))
    told = told.join(F.broadcast(marks), F.floor(F.col(place) / 64) == F.col(word), "left")
    met = F.coalesce(F.col(mask), F.lit(0).cast("long")).bitwiseAND(one(F.col(place))) != 0
    columns = [f"`{c}`" for c in rows.columns]
    return told.where(~met).select(*columns).unionByName(told.where(met).select(*columns).join(gone, match, "left_anti"))
