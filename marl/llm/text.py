"""Texts as flat arrays of bytes: batches, words and polynomial prefix hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of vectorised work takes on, give or take one text.
STEP_BYTES = 4 << 20


#: Rows of an Arrow batch: the default of 10,000 texts would hold tens of megabytes on both sides of the pipe.
BATCH_ROWS = 1000


def long_texts(spark: SparkSession) -> None:
    """Lets the session send texts to Python in small batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def trim() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back() -> None:
    """The same at the end of a task, and powers kept: Python workers live on from stage to stage beside others."""
    _powers.clear()
    gc.collect()
    trim()


def trimmed(run):
    """A function of a group's key and rows that returns freed memory once all it worked with is gone."""

    def wrapped(key, rows):
        found = run(key, rows)
        trim()
        return found

    return wrapped


def trimmed_pair(run):
    """The same for a function of a key and the rows of both sides."""

    def wrapped(key, rows, others):
        found = run(key, rows, others)
        trim()
        return found

    return wrapped


def trimmed_batches(run):
    """The same for a function of batches, at the end of a task."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def as_bytes(documents: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, t): UTF-8 bytes of the text, null as empty."""
    long_texts(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), *more)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls, without a copy where there is one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), places


#: Stretches of this length at least, on average, are copied one by one; shorter ones by index, so many places at a time.
LONG_STRETCH, PLACES = 64, 1 << 16


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of data laid end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if total and total >= LONG_STRETCH * len(ends):
        return np.concatenate([data[a:b] for a, b in zip(starts.tolist(), (starts + lengths).tolist())])
    found, at = np.empty(total, data.dtype), 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PLACES, "right")))
        n = lengths[at:to]
        found[done : int(ends[to - 1])] = data[np.repeat(starts[at:to] - (ends[at:to] - n - done), n) + np.arange(int(ends[to - 1]) - done)]
        at = to
    return found


def text_batches(batches: Iterator[pa.RecordBatch], step: int = STEP_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(first column, bytes, offsets) in pieces of about step bytes; the second column holds the texts."""
    for batch in batches:
        data, offsets = flat(batch.column(1))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.column(0).slice(at, to - at), data, offsets[at : to + 1]
            at = to
    give_back()


# Polynomial hashing modulo 2**64. An odd base has an inverse, so that the hash of any stretch follows from two prefix sums.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}
#: Powers kept by a Python worker, for each of the two bases.
KEPT_POWERS = 1 << 21


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n + 1 powers; those of common lengths are kept."""
    if n < KEPT_POWERS:
        kept = _powers.get(int(base))
        if kept is None or len(kept) <= n:
            kept = _powers[int(base)] = _powers_of(base, min(KEPT_POWERS, max(1 << 12, 2 * n)))
        return kept[: n + 1]
    return _powers_of(base, n)


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    found = np.empty(n + 1, np.uint64)
    found[0] = 1
    have = 1
    with np.errstate(over="ignore"):
        while have < n + 1:
            more = min(have, n + 1 - have)
            found[have : have + more] = found[:more] * (found[have - 1] * base)
            have += more
    return found


class PrefixHash:
    """Hashes of stretches of a sequence of symbols, by prefix sums of symbol times power."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.down = powers(INVERSE, n)
        terms = (symbols.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)) * powers(BASE, n)[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, texts): byte ranges in data of the words between ASCII white space, and the count of words before each text."""
    base, end = int(offsets[0]), int(offsets[-1])
    raw = data[base:end]
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets - base] = True  # a text's end ends a word
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts + base, np.flatnonzero(ends) + 1 + base, np.searchsorted(starts, offsets - base)
