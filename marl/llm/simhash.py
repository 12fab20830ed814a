"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. Two fingerprints at most four bits apart have a
segment in which they differ by at most one bit (two in each would make six), so they share a variant
of that segment with one bit deleted. Every distinct fingerprint is indexed under its 64 variants;
an equality exchange on variants brings candidates together and their distance is verified. Within a
large group the bits outside the segment are cut into five parts, of which one must be equal, so that
members are compared by part and not all with all.

Defined results: null, empty or wordless text has fingerprint zero and is linked like any other; equal
fingerprints form a class, links join classes; repeated rows stay rows; rows without doc_id take part like
others (component_id is the smallest doc_id of the component, null if it has no id at all); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, enough_tasks, leave_out, local_forest, look_up, read_all
from .text import long_texts, trimmed_batches

#: First bit and width of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Shingles whose bits are counted at a time, and groups above this size are searched breadth first.
COUNTED, SMALL = 1 << 16, 24
#: Parts of the bits outside a segment; more than bits that may differ.
PARTS = 5
#: Variants that one task holds, 16 bytes each and some ten times that while they are compared.
VARIANTS = 2_000_000


def fingerprint(text: bytes | None, words: int = 4) -> int:
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    n = max(1, len(found) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[words - 1 :] - 1).tolist() if len(found) >= words else [len(whole)]
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, COUNTED):
        hashes = np.array([xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts[at : at + COUNTED], stops[at : at + COUNTED])], dtype="<u8")
        bits += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) for every row."""
    long_texts(documents.sparkSession)
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    return rows.mapInArrow(trimmed_batches(_fingerprints), "doc_id long, text_key long, fp long")


def variants(classes: DataFrame) -> DataFrame:
    """(key, fp): 64 rows for each fingerprint; a key holds the place of the deleted bit and the rest of its segment."""
    cases = []
    for at, width in SEGMENTS:
        part = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for bit in range(width):
            left = part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)).cast("long"))
            cases.append(left.bitwiseOR(F.lit((at + bit) << 22).cast("long")))
    return classes.select("fp", F.explode(F.array(*cases)).alias("key"))


def _parts(bit: int) -> list[np.uint64]:
    """Masks of the five parts of the bits outside the segment that holds a bit."""
    at, width = next((a, w) for a, w in SEGMENTS if a <= bit < a + w)
    outside = [b for b in range(64) if not at <= b < at + width]
    return [np.uint64(sum(1 << int(b) for b in part)) for part in np.array_split(outside, PARTS)]


def _spanning(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked in one large group: each step compares one member with those not reached yet only."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= distance
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _linked(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within each group; group is sorted."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(group)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    within = np.repeat(sizes, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero((within[step:] > step) & (within[step:] <= SMALL) & (group[step:] == group[:-step]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
        a.append(i)
        b.append(i + step)
    for at, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        i, j = _spanning(fp[at : at + n], distance)
        a.append(at + i)
        b.append(at + j)
    return np.concatenate(a), np.concatenate(b)


def links_of(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that connect all that share a key and are at most distance bits apart."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order].view(np.uint64)
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    sizes = np.diff(np.append(np.flatnonzero(new), len(key)))
    large = np.repeat(sizes > SMALL, sizes)
    i, j = _linked(key[~large], fp[~large], distance)
    found = [(fp[~large][i], fp[~large][j])]
    key, fp = key[large], fp[large]
    for nth in range(PARTS if len(key) else 0):
        mask = np.array([_parts(b)[nth] for b in range(64)])[key >> 22]
        order = np.lexsort([fp & mask, key])
        k, f = key[order], fp[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | ((f & mask[order])[1:] != (f & mask[order])[:-1])
        i, j = _linked(np.cumsum(new), f, distance)
        found.append((f[i], f[j]))
    return tuple(np.concatenate(x).view(np.int64) for x in zip(*found))


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """(u, v): links between fingerprints that connect all that is at most distance bits apart."""
    if distance > 4:
        raise ValueError("three segments with one deleted bit find up to 4 differing bits")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read_all(batches)
        if found is not None:
            u, v = local_forest(*links_of(*(found[c].to_numpy() for c in ("key", "fp")), distance))
            yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    # a task holds its variants, and fingerprints are small: stated numbers of tasks, that follow from the count of fingerprints
    tasks = enough_tasks(classes.sparkSession, 64 * classes.count(), VARIANTS)
    return variants(classes.repartition(tasks, "fp")).repartition(tasks, "key").mapInArrow(trimmed_batches(verified), "u long, v long")


def components(documents: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, text_key, fp, component_id) for every row."""
    fps = cut(fingerprints(documents))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    roots = connected_components(links(classes, distance))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id", "n")
    return look_up(fps, ids, "fp", "n", fps.count())


def near_dedup(documents: DataFrame, distance: int = 4) -> DataFrame:
    """documents with one document of each component: that with the smallest doc_id. A row without doc_id stays, as does a row whose doc_id
    another row of a different component has and which is the smallest of its own; of repeated rows all stay or none."""
    gone = components(documents.select("doc_id", "text"), distance).where("doc_id <> component_id").select("doc_id", "text_key")
    return leave_out(documents, gone, {"doc_id": F.col("doc_id"), "text_key": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
