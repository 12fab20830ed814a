"""Embedding near-dedup with spherical-cap filters.

Directions come from a structured random product code: coordinates are rotated at random and cut into
two blocks, each with a codebook of random unit vectors; a direction is a pair of codewords. A vector is
filed under all directions that it exceeds by a threshold, which list decoding finds from the two sorted
lists of block scores. Vectors meet by an exchange on directions and every meeting pair is verified by
its cosine in double precision. A direction that a hot share of the vectors exceeds is dealt to cells:
its members are put into blocks by a hash, and every pair of blocks is a cell of its own.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with
nothing; equal vectors form a class, which enters the search once and counts with all its rows; vectors of
different length never link; a cosine of exactly the threshold links; repeated vec_id rows are rows of their
own; a row without vec_id is not kept; rows without vec_id count as rows that others link with, and their component is the smallest vec_id
reachable, null if there is none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, enough_tasks, local_forest, look_up, read_all
from .text import mix, trimmed_batches

#: Rows of one direction that are compared with the others at a time.
BLOCK = 512
#: Codes of a block that are laid out at a time.
CODES = 2048
#: Rows up to which classes with their vectors are broadcast, and bytes that these take at most, whatever the vectors' length.
WHOLE, WHOLE_BYTES = 10_000, 32 << 20
#: Filed vectors that one task holds.
FILED = 200_000
#: A direction of more vectors than this, and than one in HOT_DIRECTIONS of all that are filed, is dealt to cells of about so many each way.
CELL, HOT_DIRECTIONS = 4096, 100_000


USABLE = "coalesce(size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0), false)"


@dataclass(frozen=True)
class CapFilters:
    """words: codewords of a block, so that there are words**2 directions; filed: directions that a vector exceeds on average.

    floor: a vector that exceeds fewer is filed under its floor best. Recall by cosine is measured in the tests.
    """

    words: int = 64
    filed: float = 24.0
    floor: int = 24
    seed: int = 7

    def sized(self, vectors: int, together: int = 256) -> CapFilters:
        """So many codewords that a direction holds about `together` of the vectors on average, whatever their number."""
        return replace(self, words=max(32, math.ceil(math.sqrt(self.filed * vectors / together))))


@lru_cache(maxsize=8)
def _code(dim: int, cfg: CapFilters) -> tuple[np.ndarray, np.ndarray, int, float]:
    rng = np.random.default_rng([cfg.seed, dim])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    half = max(1, dim // 2)
    books = []
    for width in (half, max(1, dim - half)):
        book = rng.standard_normal((cfg.words, width))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / math.sqrt(2))
    probe = rng.standard_normal((512, dim))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    probe = probe @ turn
    scores = (probe[:, :half] @ books[0].T)[:, :, None] + (probe[:, -books[1].shape[1] :] @ books[1].T)[:, None, :]
    height = float(np.quantile(scores, 1 - min(0.5, cfg.filed / cfg.words**2)))
    return turn, books[0], books[1], height


def decode(vectors: np.ndarray, cfg: CapFilters) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) for each direction that a unit vector exceeds, and for its cfg.floor best ones in any case."""
    turn, left, right, height = _code(vectors.shape[1], cfg)
    turned = vectors @ turn
    one, two = turned[:, : left.shape[1]] @ left.T, turned[:, -right.shape[1] :] @ right.T
    up, down = np.argsort(-one, axis=1), np.argsort(-two, axis=1)
    one, two = np.take_along_axis(one, up, axis=1), np.take_along_axis(two, down, axis=1)
    # the k best pairs are among those whose ranks in the two lists multiply to k at most
    pairs = np.array([(i, j) for i in range(min(cfg.floor, cfg.words)) for j in range(min(cfg.floor // (i + 1), cfg.words))])
    best = -np.sort(-(one[:, pairs[:, 0]] + two[:, pairs[:, 1]]), axis=1)[:, min(cfg.floor, len(pairs)) - 1]
    least = np.minimum(height, best - 1e-12)
    row, rank_one = np.nonzero(one + two[:, :1] >= least[:, None])  # the only first words with anything to list
    need = least[row] - one[row, rank_one]
    low, high = np.ones(len(row), np.int64), np.full(len(row), cfg.words)  # how many second words reach it: two is sorted, the first one does
    while (low < high).any():
        mid = (low + high + 1) >> 1
        enough = two[row, mid - 1] >= need
        low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
    count = low
    at = np.repeat(np.arange(len(row)), count)
    rank_two = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    row, found = row[at], up[row, rank_one][at] * cfg.words + down[row[at], rank_two]
    order = np.lexsort([found, row])
    return row[order], found[order]


def classes_of(embeddings: DataFrame) -> DataFrame:
    """(id, rep, n, v): distinct usable vectors, each with a number of its own, its smallest vec_id and its count of rows."""
    rows = _rows(embeddings).where(USABLE).select("vec_id", "v")
    return rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())


def _rows(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), _plain("embedding").alias("v"))


def _plain(column: str):
    """Doubles, without negative zeros."""
    return F.transform(F.col(column).cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _decoded(batches: Iterator[pa.RecordBatch], cfg: CapFilters) -> Iterator[tuple]:
    """(batch, places in it, vectors, row, direction) of the vectors of one length, a few thousand at a time."""
    for batch in batches:
        vectors = batch.column(batch.schema.get_field_index("v"))
        lengths = vectors.value_lengths().to_numpy()
        for dim in np.unique(lengths):
            own = np.flatnonzero(lengths == dim)
            for at in range(0, len(own), 4096):
                places = own[at : at + 4096]
                v = vectors.take(pa.array(places)).flatten().to_numpy().reshape(-1, dim)
                yield batch, places, v, *decode(_units(v), cfg)


def _key(direction: np.ndarray, dim: int) -> np.ndarray:
    return direction + (int(dim) << 32)


def _directions(cfg: CapFilters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, v, _, direction in _decoded(batches, cfg):
            key, n = np.unique(_key(direction, v.shape[1]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": key, "n": n})

    return run


def _file(cfg: CapFilters, kind: str, hot: dict[int, int]):
    """A row for each vector and direction, or cell of a direction. cell: the numbers of two blocks, -1 for a direction that isn't dealt;
    own: the vector's block. codes: the directions before this one that the vector exceeds, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys = np.array(sorted(hot), np.int64)
        blocks = np.array([hot[k] for k in hot_keys.tolist()], np.int64)
        for batch, places, v, row, direction in _decoded(batches, cfg):
            data = [x.tobytes() for x in v.astype(kind)]
            starts = np.searchsorted(row, np.arange(len(v) + 1))
            coded = [direction[a:b].astype("<i4").tobytes() for a, b in zip(starts[:-1], starts[1:])]
            before = np.arange(len(row)) - starts[row]
            key = _key(direction, v.shape[1])
            ids = batch.column("id").take(pa.array(places)).to_numpy()[row]
            parts = np.ones(len(row), np.int64)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                parts = np.where(hot_keys[at] == key, blocks[at], 1)
            own = (mix(ids.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            each = np.repeat(np.arange(len(row)), parts)
            other = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
            cell = np.where(parts[each] > 1, np.minimum(own[each], other) << 20 | np.maximum(own[each], other), -1)
            for a in range(0, len(each), 1 << 16):
                part = each[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[part]), pa.array(cell[a : a + (1 << 16)]), pa.array(own[part]), pa.array(ids[part]),
                        batch.column("n").take(pa.array(places[row[part]])),
                        pa.array([data[i] for i in row[part].tolist()], pa.binary()),
                        pa.array([coded[i][: 4 * k] for i, k in zip(row[part].tolist(), before[part].tolist())], pa.binary()),
                    ],
                    ["key", "cell", "own", "id", "n", "v", "codes"],
                )

    return run


class _Codes:
    """The code lists of a group's members, laid end to end."""

    def __init__(self, codes: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(codes), "<i4")
        self.sizes = np.array([len(c) // 4 for c in codes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def common(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Which of rows x columns have a code in common. Only codes that several of these members have are looked at, some at a time."""
        every, place = np.unique(np.concatenate([rows, columns]), return_inverse=True)
        n = self.sizes[every]
        of = np.repeat(np.arange(len(every)), n)
        flat = self.flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.starts[every][of]]
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        several = count[code] > 1
        kept, code = np.unique(code[several], return_inverse=True)
        of = of[several]
        found = np.zeros((len(rows), len(columns)), bool)
        for at in range(0, len(kept), CODES):
            own = (code >= at) & (code < at + CODES)
            member = np.zeros((len(every), min(CODES, len(kept) - at)), np.float32)
            member[of[own], code[own] - at] = 1
            found |= member[place[: len(rows)]] @ member[place[len(rows) :]].T > 0
        return found


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) links that connect all that a block of pairs connects, each row and column met once."""
    rows_left, columns_left = near.any(axis=1), near.any(axis=0)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while rows_left.any():
        queue = [int(rows_left.argmax())]
        rows_left[queue[0]] = False
        while queue:
            row = queue.pop()
            new = np.flatnonzero(near[row] & columns_left)
            if not len(new):
                continue
            columns_left[new] = False
            a.append(np.full(len(new), row))
            b.append(new)
            beside = np.flatnonzero(rows_left)
            beside = beside[near[np.ix_(beside, new)].any(axis=1)]
            if len(beside):
                rows_left[beside] = False
                a.append(beside)
                b.append(new[near[np.ix_(beside, new)].argmax(axis=1)])
                queue.extend(beside.tolist())
    return np.concatenate(a), np.concatenate(b)


def _meet(least: float, kind: str):
    """Per direction or cell: links that connect its members, and for each member the rows linked to it by pairs whose first common direction this is."""

    def group(cell: int, own: np.ndarray, ids: np.ndarray, n: np.ndarray, unit: np.ndarray, codes: _Codes) -> tuple:
        across = cell >= 0 and cell >> 20 != cell & 0xFFFFF
        one = np.flatnonzero(own == cell >> 20) if across else np.arange(len(ids))
        two = np.flatnonzero(own == cell & 0xFFFFF) if across else one
        total, u, v = np.zeros(len(ids), dtype=np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(one), BLOCK):
            rows = one[at : at + BLOCK]
            near = unit[rows] @ unit[two].T >= least
            if not across:
                near[np.arange(len(rows)), at + np.arange(len(rows))] = False
            some, others = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(some):
                continue
            near, rows, columns = near[np.ix_(some, others)], rows[some], two[others]
            first = near & ~codes.common(rows, columns)
            total[rows] += first @ n[columns]
            if across:
                total[columns] += n[rows] @ first
            a, b = _spanning(near)
            u.append(ids[rows[a]])
            v.append(ids[columns[b]])
        return total, np.concatenate(u), np.concatenate(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read_all(batches)
        if found is None:
            return
        keys, cells = found["key"].to_numpy(), found["cell"].to_numpy()
        order = np.lexsort([found["id"].to_numpy(), cells, keys])
        bounds = np.flatnonzero(np.concatenate([[True], (np.diff(keys[order]) != 0) | (np.diff(cells[order]) != 0), [True]]))
        ids, n, own = (found[c].to_numpy() for c in ("id", "n", "own"))
        named, totals, us, vs = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            at = order[a:b]
            rows = found.take(pa.array(at))
            v = np.frombuffer(b"".join(rows["v"].to_pylist()), dtype=kind).astype(np.float64).reshape(-1, int(keys[at[0]]) >> 32)
            total, u, w = group(int(cells[at[0]]), own[at], ids[at], n[at], _units(v), _Codes(rows["codes"].to_pylist()))
            some = total > 0
            named.append(ids[at][some])
            totals.append(total[some])
            us.append(u)
            vs.append(w)
        u, v = local_forest(np.concatenate(us), np.concatenate(vs))
        if named:
            who, at = np.unique(np.concatenate(named), return_inverse=True)
            count = np.zeros(len(who), dtype=np.int64)
            np.add.at(count, at, np.concatenate(totals))
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(count)], ["u", "v", "count"])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], ["u", "v", "count"])

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.9, cfg: CapFilters = CapFilters(), cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"  # vectors travel as they came and are cut to unit length where they meet
    classes = cut(classes_of(embeddings))
    cfg = cfg.sized(classes.count())
    counted = cut(classes.mapInArrow(_directions(cfg), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    bound = max(cell, -(-total // HOT_DIRECTIONS))
    tasks = enough_tasks(embeddings.sparkSession, total, FILED)
    hot = {r["key"]: -(-r["n"] // bound) for r in counted.where(F.col("n") > bound).collect()}  # HOT_DIRECTIONS rows at most
    filed = classes.mapInArrow(trimmed_batches(_file(cfg, kind, hot)), "key long, cell long, own long, id long, n long, v binary, codes binary")
    met = cut(filed.repartition(tasks, "key", "cell").mapInArrow(trimmed_batches(_meet(least, kind)), "u long, v long, count long"))
    roots = connected_components(met.where("v is not null").select("u", "v"))
    counts = met.where("v is null").groupBy("u").agg(F.sum("count").alias("linked"))
    found = classes.join(counts, classes["id"] == counts["u"], "left").join(roots, classes["id"] == roots["node"], "left")
    found = cut(found.select("v", "rep", "n", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "id").alias("root")))
    lowest = found.groupBy("root").agg(F.min("rep").alias("component"))
    rows = _rows(embeddings)
    longest = classes.agg(F.max(F.size("v"))).first()[0] or 1
    whole = min(WHOLE, WHOLE_BYTES // (8 * longest + 64))
    told = look_up(rows.where(USABLE), found.join(lowest, "root").select("v", "n", "links", "component"), "v", "n", rows.count(), whole, whole)
    told = told.select("vec_id", F.col("links").cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    others = rows.where(f"not {USABLE}").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
