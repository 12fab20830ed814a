"""Windows that also start in a document with a smaller id, over bytes or words, without a shuffle of all windows.

A window is W consecutive units of one text. Its anchor is the smallest hash of its k-grams, so equal windows have
equal anchors and consecutive windows mostly share one: a text falls into runs of windows with one anchor, and a run
into one segment of text. Anchors only route: whether a window is removed is read from what a resolver (suffix sort or
FM-index) says of it. In four exchanges:

1. groups of texts send the distinct anchors of each group to shards by anchor; shards answer with two bits for each:
   does it occur in two documents, and is it hot, that is, has it more than HOT places;
2. groups send the segments of runs whose anchor does, to shards by anchor. A segment that occurs several times within a
   group travels once, with the smallest and the largest of its ids, so that a hot passage arrives once from each group.
   The runs at the edges of a hot passage differ in every document, though, and all have its anchors: segments of hot
   anchors are therefore taken apart into their windows, each of which goes to the shard of its own hash;
3. the shard's resolver finds equal windows among all its segments, and with them the smallest id under which each
   window starts; groups are told in stretches of windows with one such id;
4. groups cover the windows whose smallest id is below the text's own.

Texts are exchanged once: the exchange by group is shared by steps 1, 2 and 4. Groups and shards are of bounded size,
their number follows from the size of the input. What is lost with an executor is made again from the map outputs of
the exchange before it; the answers of step 3 are small, the texts aren't, so that nothing is written twice.

Defined results: null text is empty; a row without doc_id counts as one with the largest id (2**63 - 1, which no document
should have); rows that share a doc_id do not remove from each other; repeated rows are judged alike and stay rows;
windows never cross texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import PrefixHash, flat, gather, mix, trimmed, trimmed_pair, words_in

#: Windows of a run at most; longer ones (of repetitive text) are cut.
LONGEST_RUN = 4096
#: Bytes of text worked on at a time within a group or shard.
STEP = 1 << 18
#: Places of an anchor above which its windows are dealt one by one: what an anchor brings to its shard is bounded by it.
HOT = 16_384
LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class RepeatConfig:
    """window and gram: units of a window and of an anchor's k-gram; unit: "byte" or "word"; group_bytes, shard_bytes: text for which
    there is one group, one shard; hot: places of an anchor above which its windows are dealt one by one."""

    window: int = 50
    gram: int = 24
    unit: str = "byte"
    group_bytes: int = 8 << 20
    shard_bytes: int = 4 << 20
    hot: int = HOT


@dataclass
class Piece:
    """Texts laid end to end: symbols of their units, bounds of each text in units, and the bytes of units [begin, end) as text[at[begin] : to[end - 1]]."""

    symbols: np.ndarray
    bounds: np.ndarray
    text: np.ndarray
    at: np.ndarray
    to: np.ndarray


def piece_of(data: np.ndarray, offsets: np.ndarray, cfg: RepeatConfig) -> Piece:
    base, end = int(offsets[0]), int(offsets[-1])
    if cfg.unit == "byte":
        raw, places = data[base:end], np.arange(end - base + 1)
        return Piece(raw, offsets - base, raw, places[:-1], places[1:])
    w0, w1, counts = words_in(data, offsets)
    lengths = w1 - w0 + 1
    n0 = np.cumsum(lengths) - lengths
    text = np.append(data, np.uint8(32))[np.repeat(w0 - n0, lengths) + np.arange(int(lengths.sum()))] if len(w0) else np.zeros(0, np.uint8)
    text[n0 + lengths - 1] = 32
    hashes = mix(PrefixHash(text).of(n0, n0 + lengths - 1)) if len(w0) else np.zeros(0, np.uint64)
    return Piece(hashes, counts, text, n0, n0 + lengths - 1)


def runs_of(piece: Piece, cfg: RepeatConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, count of windows, anchor) of each run."""
    n, w, k = len(piece.symbols), cfg.window, cfg.gram
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(n - k + 1)
    low = mix(PrefixHash(piece.symbols).of(place, place + k))
    span, have = w - k + 1, 1
    while have < span:
        more = min(have, span - have)
        low = np.minimum(low[: len(low) - more], low[more:])
        have += more
    edge = np.zeros(n + 1, np.int8)
    start, stop = piece.bounds[:-1], piece.bounds[1:]
    long = stop - start >= w
    edge[start[long]] += 1
    edge[stop[long] - w + 1] -= 1
    fine = np.cumsum(edge[: len(low)]) > 0
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | ~fine[:-1]
    first = np.flatnonzero(fine & change)
    closes = np.flatnonzero(np.append(change | ~fine, True))
    count = closes[np.searchsorted(closes, first, "right")] - first
    if len(count) and count.max() > LONGEST_RUN:
        parts = -(-count // LONGEST_RUN)
        rank = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first, whole = np.repeat(first, parts) + rank * LONGEST_RUN, np.repeat(count, parts)
        count = np.minimum(LONGEST_RUN, whole - rank * LONGEST_RUN)
    return first, count, mix(low[first])


class Group:
    """The rows of a group in an order that its content alone decides."""

    def __init__(self, rows: pa.Table, cfg: RepeatConfig) -> None:
        data, offsets = flat(rows["t"])
        ids = rows["id"].to_numpy()
        hashes = PrefixHash(data).of(offsets[:-1], offsets[1:]) if len(data) < STEP else _hashes(data, offsets)
        self.order = np.lexsort([offsets[1:] - offsets[:-1], hashes, ids])
        self.ids, self.cfg = ids[self.order], cfg
        lengths = (offsets[1:] - offsets[:-1])[self.order]
        self.data = gather(data, offsets[:-1][self.order], lengths)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])

    def runs(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece its first row and its runs: row, first window, count of windows and anchor. Found once."""
        if not hasattr(self, "_runs"):
            self._runs = []
            for at, _, piece in self.pieces():
                first, count, anchor = runs_of(piece, self.cfg)
                self._runs.append((at, np.searchsorted(piece.bounds, first, "right") - 1, first, count, anchor))
        return self._runs

    def pieces(self) -> Iterator[tuple[int, int, Piece]]:
        """(first row, row after the last, piece)."""
        at, n = 0, len(self.ids)
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + STEP, "right")) - 1))
            yield at, to, piece_of(self.data, self.offsets[at : to + 1], self.cfg)
            at = to


def _hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1))
        base = int(offsets[at])
        found.append(PrefixHash(data[base : int(offsets[to])]).of(offsets[at:to] - base, offsets[at + 1 : to + 1] - base))
        at = to
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Are the stretches of equal lengths at a and b equal, byte by byte."""
    found, at = np.ones(len(a), bool), 0
    ends = np.cumsum(lengths)
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * STEP, "right")))
        n = lengths[at:to]
        differ = gather(data, a[at:to], n) != gather(data, b[at:to], n)
        found[at:to] = np.add.reduceat(np.append(differ, False).astype(np.int64), np.cumsum(n) - n) == 0 if len(n) else True
        at = to
    return found


def classes_of(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each segment, segment that stands for each class): equal segments, checked byte by byte; the smallest id stands for its class."""
    order = np.lexsort([ids, lengths, hashes])
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (lengths[order[1:]] != lengths[order[:-1]])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    differ = np.zeros(len(order), bool)
    check = np.flatnonzero(~new)
    differ[check] = ~_same(text, starts[order[check]], starts[head[check]], lengths[order[check]])
    new |= differ  # a collision of hashes; what follows it is compared with the first of its hash all the same
    rank = np.cumsum(new) - 1
    rank = np.where(differ, rank, rank[np.maximum.accumulate(np.where(new & ~differ, np.arange(len(order)), 0))]) if differ.any() else rank
    classes = np.empty(len(order), np.int64)
    classes[order] = rank
    return classes, order[new]


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays)] + [x.nbytes for x in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(x.tobytes() for x in arrays)]))


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)[1:]
    at, found = 8 * (len(kinds) + 1), []
    for n, kind in zip(sizes.tolist(), kinds):
        found.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return found


def _steps(numbers: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Differences from one number to the next; np.cumsum takes them back, overflows included."""
    return np.diff(numbers, prepend=numbers.dtype.type(0)).astype(kind)


def _thin(ascending: np.ndarray) -> np.ndarray:
    """Sorted numbers as bytes that compress: differences, their highest bytes first, which are nearly all zero."""
    return np.diff(ascending, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8).T.copy()


def _thick(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.reshape(8, -1).T.copy().view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def _shard(anchors: np.ndarray, shards: int) -> np.ndarray:
    return ((anchors >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _by_shard(anchors: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) over sorted anchors."""
    where = _shard(anchors, shards)
    cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else np.zeros(0, np.int64)
    yield from zip(where[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist())


def _distinct(group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct anchors of a group, does each occur under two ids, its places), and which of them each run has."""
    anchors, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, row, _, _, anchor in group.runs():
        anchors.append(anchor)
        owners.append(group.ids[at + row])
    anchors, owners = np.concatenate(anchors), np.concatenate(owners)
    order = np.argsort(anchors)
    anchors, owners = anchors[order], owners[order]
    new = np.ones(len(anchors), bool)
    new[1:] = anchors[1:] != anchors[:-1]
    at = np.flatnonzero(new)
    twice = np.minimum.reduceat(owners, at) != np.maximum.reduceat(owners, at) if len(at) else np.zeros(0, bool)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return anchors[at], twice, np.diff(np.append(at, len(anchors))).astype(np.uint32), of


SEGMENT = (np.int32, np.int32, np.int64, np.int64, np.uint8)  # of a segment: bytes, windows, smallest id in steps, largest id less the smallest; all text
MEMBER = (np.int32, np.int32, np.int32)  # in steps, of a place of a class of equal segments: the class, row, first window
ALIAS = (np.int32, np.int32, np.int32)  # in steps, of what a segment that was sent stands for: the segment, a class, the first of its windows
ANSWER = (np.int32, np.int32, np.int32, np.int64)  # of a stretch of windows: the segment, first window, windows, smallest id


def _batch(names: str, kinds: tuple, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names.split())


def _ask(cfg: RepeatConfig, shards: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        anchors, twice, places, _ = _distinct(Group(rows, cfg))
        out = [(s, key[0].as_py(), _pack(_thin(anchors[a:b]), np.packbits(twice[a:b]), places[a:b])) for s, a, b in _by_shard(anchors, shards)]
        return _batch("shard gid blob", (pa.int64(), pa.int64(), pa.binary()), out)

    return run


def _answer(hot: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = [(_thick(a), t, n) for a, t, n in (_unpack(b, (np.uint8, np.uint8, np.uint32)) for b in rows["blob"].to_pylist())]
        anchors = np.concatenate([a for a, _, _ in found])
        own = np.concatenate([np.unpackbits(t, count=len(a)).astype(bool) for a, t, _ in found])
        _, of = np.unique(anchors, return_inverse=True)
        groups, places = np.bincount(of), np.bincount(of, np.concatenate([n for _, _, n in found]))
        told = np.packbits(np.stack([own | (groups[of] > 1), places[of] > hot], axis=1), axis=1)[:, 0] >> 6
        out, at = [], 0
        for gid, (a, _, _) in zip(rows["gid"].to_pylist(), found):
            out.append((gid, key[0].as_py(), _pack(told[at : at + len(a)])))
            at += len(a)
        return _batch("gid shard blob", (pa.int64(), pa.int64(), pa.binary()), out)

    return run


def _taken_apart(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, cfg: RepeatConfig) -> tuple:
    """The different windows of segments, as segments of their own: (text, starts, sizes, hashes, smallest ids, largest ids) of each,
    and for each place of one (window, segment, place in it)."""
    piece = piece_of(gather(text, starts, sizes), np.concatenate([[0], np.cumsum(sizes)]), cfg)
    count = np.diff(piece.bounds) - cfg.window + 1
    segment = np.repeat(np.arange(len(starts)), count)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    unit = piece.bounds[:-1][segment] + inside
    begin, end = piece.at[unit], piece.to[unit + cfg.window - 1]
    hashes = mix(PrefixHash(piece.symbols).of(unit, unit + cfg.window))
    window, reps = classes_of(piece.text, begin, end - begin, hashes, low[segment])
    most = np.full(len(reps), np.iinfo(np.int64).min)
    np.maximum.at(most, window, high[segment])
    return piece.text, begin[reps], (end - begin)[reps], hashes[reps], low[segment][reps], most, window, segment, inside


def _send(cfg: RepeatConfig, shards: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        if not rows.num_rows or not answers.num_rows:
            return _batch(SENT, kinds, [])
        gid, group = key[0].as_py(), Group(rows, cfg)
        anchors, _, _, of = _distinct(group)
        told = dict(zip(answers["shard"].to_pylist(), answers["blob"].to_pylist()))
        known = [_unpack(told[s], (np.uint8,))[0] for s, _, _ in _by_shard(anchors, shards)]
        known = np.concatenate(known) if known else np.zeros(0, np.uint8)
        told = known[of]
        parts, done = [], 0
        for (_, _, piece), (at, row, first, count, anchor) in zip(group.pieces(), group.runs()):
            answer = told[done : done + len(anchor)]
            done += len(anchor)
            own = np.flatnonzero(answer >= 2)
            if not len(own):
                continue
            row, first, count, anchor = row[own], first[own], count[own], anchor[own]
            begin, size = piece.at[first], piece.to[first + count + cfg.window - 2] - piece.at[first]
            hashes = PrefixHash(piece.text).of(begin, begin + size)
            parts.append((group.ids[at + row], (at + row).astype(np.int32), first - piece.bounds[row], count.astype(np.int32), size, anchor, answer[own] == 3, hashes, gather(piece.text, begin, size)))
        if not parts:
            return _batch(SENT, kinds, [])
        ids, row, first, count, size, anchor, hot, hashes, text = (np.concatenate(x) for x in zip(*parts))
        starts = np.cumsum(size) - size
        classes, reps = classes_of(text, starts, size, hashes, ids)
        # classes in the order in which they are met: numbers that belong together then differ little and are sent in few bytes
        order = np.argsort(reps)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        classes, reps = place[classes], reps[order]
        high = ids[reps].copy()
        np.maximum.at(high, classes, ids)
        apart = hot[reps]
        # segments to send, and what each of them stands for: a class as a whole, or a window at places of some classes
        whole = np.flatnonzero(~apart)
        own = reps[whole]
        sent = [(anchor[own], size[own], count[own], ids[own], high[whole], gather(text, starts[own], size[own]))]
        alias = [(np.arange(len(whole)), whole, np.zeros(len(whole), np.int64))]
        if apart.any():
            some = np.flatnonzero(apart)
            own = reps[some]
            window_text, begin, sizes, window_anchor, low, most, window, segment, inside = _taken_apart(text, starts[own], size[own], ids[own], high[some], cfg)
            sent.append((window_anchor, sizes, np.ones(len(begin), np.int32), low, most, gather(window_text, begin, sizes)))
            alias.append((window + len(whole), some[segment], inside))
        # where its segments stand is for the group itself to know: no shard reads it
        out = [(gid % shards, gid, -1, True, _pack(_steps(classes, np.int32), _steps(row, np.int32), _steps(first, np.int32)))]
        anchor, size, count, low, high, text = (np.concatenate(x) for x in zip(*sent))
        starts = np.cumsum(size) - size
        segment, stands_for, inside = (np.concatenate(x) for x in zip(*alias))
        shard = _shard(anchor, shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_place = np.argsort(place[segment], kind="stable")
        segment, stands_for, inside = place[segment][by_place], stands_for[by_place], inside[by_place]
        for s, a, b in _by_shard(anchor[order], shards):
            own = order[a:b]
            out.append((s, gid, s, False, _pack(size[own].astype(np.int32), count[own].astype(np.int32), _steps(low[own]), high[own] - low[own], gather(text, starts[own], size[own]))))
            x, y = np.searchsorted(segment, [a, b])
            out.append((gid % shards, gid, s, True, _pack(_steps(segment[x:y] - a, np.int32), _steps(stands_for[x:y], np.int32), _steps(inside[x:y], np.int32))))
        return _batch(SENT, kinds, out)

    return run


#: (text, starts, lengths, windows, smallest ids, largest ids) of segments -> for their windows, one after the other, the smallest id under which each starts.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
SENT, TOLD = "shard gid part places blob", "gid part places blob"


def _resolve(resolver: Resolver):
    def run(_key: tuple, rows: pa.Table) -> pa.Table:
        places = rows["places"].to_pylist()
        heads = list(zip(rows["gid"].to_pylist(), rows["part"].to_pylist()))
        blobs = rows["blob"].to_pylist()
        out = [(*h, True, b) for h, p, b in zip(heads, places, blobs) if p]
        asked = [(h, _unpack(b, SEGMENT)) for h, p, b in zip(heads, places, blobs) if not p]
        if asked:
            low = np.concatenate([np.cumsum(x[2], dtype=np.int64) for _, x in asked])
            size, windows, _, high, text = (np.concatenate(x) for x in zip(*(x for _, x in asked)))
            size, windows, high = size.astype(np.int64), windows.astype(np.int64), high + low
            least = resolver(text, np.cumsum(size) - size, size, windows, low, high)
            base = np.cumsum(windows) - windows
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            new[base] = True
            at = np.flatnonzero(new)
            n, of = np.diff(np.append(at, len(least))), np.searchsorted(base, at, "right") - 1
            tell = least[at] < high[of]  # else no place of the segment has a larger id
            at, n, of = at[tell], n[tell], of[tell]
            begin = np.cumsum([0] + [len(x[0]) for _, x in asked])
            ends = np.searchsorted(of, begin)
            for (head, _), b, x, y in zip(asked, begin, ends[:-1], ends[1:]):
                if y > x:
                    own = of[x:y]
                    out.append((*head, False, _pack((own - b).astype(np.int32), (at[x:y] - base[own]).astype(np.int32), n[x:y].astype(np.int32), least[at[x:y]])))
        return _batch(TOLD, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), out)

    return run


def _met(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with keys[i] == among[j]; among is sorted."""
    low, high = np.searchsorted(among, keys), np.searchsorted(among, keys, "right")
    each = high - low
    return np.repeat(np.arange(len(keys)), each), np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)


def _spans(told: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows) of the stretches of windows that also start under a smaller id, sorted by row."""
    places, answers = {}, {}
    for part, is_place, blob in zip(told["part"].to_pylist(), told["places"].to_pylist(), told["blob"].to_pylist()):
        (places if is_place else answers)[part] = blob
    found = [(np.zeros(0, np.int64),) * 3]
    if answers:
        classes, row, first = (np.cumsum(x, dtype=np.int64) for x in _unpack(places[-1], MEMBER))
        by_class = np.argsort(classes, kind="stable")
        classes, row, first = classes[by_class], row[by_class], first[by_class]
        for part, blob in answers.items():
            of, begin, n, least = _unpack(blob, ANSWER)
            segment, stands_for, inside = (np.cumsum(x, dtype=np.int64) for x in _unpack(places[part], ALIAS))
            i, j = _met(of, segment)
            k, place = _met(stands_for[j], classes)
            i, j = i[k], j[k]
            gone = least[i] < ids[row[place]]
            i, j, place = i[gone], j[gone], place[gone]
            found.append((row[place], first[place] + inside[j] + begin[i], n[i].astype(np.int64)))
    row, first, n = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(row, kind="stable")
    return row[order], first[order], n[order]


#: (group, piece, first row, flags of removed units) -> columns of the piece's rows.
Finisher = Callable[[Piece, np.ndarray], dict]


def _finish(cfg: RepeatConfig, finisher: Finisher, schema: pa.Schema):
    def run(_key: tuple, rows: pa.Table, spans: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        group = Group(rows, cfg)
        row, first, count = _spans(spans, group.ids)
        parts = []
        for at, to, piece in group.pieces():
            a, b = np.searchsorted(row, [at, to])
            begin = piece.bounds[row[a:b] - at] + first[a:b]
            edge = np.zeros(len(piece.symbols) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + count[a:b] + cfg.window - 1, -1)
            parts.append(finisher(piece, np.cumsum(edge[:-1]) > 0))
        made = {f"made_{k}": [x for p in parts for x in p[k]] for k in parts[0]}
        source = rows.take(pa.array(group.order))
        columns = [pa.array(made[f.name], f.type) if f.name in made else source[f.name].cast(f.type) for f in schema]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def kept_of(piece: Piece, removed: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, bytes]]:
    """(units, removed, flags, kept text) of each text of a piece."""
    for a, b in zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist()):
        flags = removed[a:b]
        gone = int(flags.sum())
        if a == b:
            kept = b""
        elif not gone:
            kept = piece.text[piece.at[a] : piece.to[b - 1]].tobytes()
        else:
            left = a + np.flatnonzero(~flags)
            ends = np.minimum(piece.to[left] + (piece.at[1] - piece.to[0] if len(piece.at) > 1 else 0), len(piece.text))
            kept = gather(piece.text, piece.at[left], ends - piece.at[left]).tobytes() if len(left) else b""
            if len(left) and ends[-1] > piece.to[left[-1]]:
                kept = kept[: len(kept) - int(ends[-1] - piece.to[left[-1]])]
        yield b - a, gone, flags, kept


def remove_repeats(documents: DataFrame, resolver: Resolver, finisher: Finisher, made: str, cfg: RepeatConfig, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document: its columns of keep as own_<name>, what the finisher makes (a schema string) as made_<name>.

    A text that is kept travels once: own_text is put together from its bytes and whether it was null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, BooleanType, StructType

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    total = documents.agg(F.sum(F.length(text))).first()[0] or 0
    groups, shards = max(1, math.ceil(total / cfg.group_bytes)), max(1, math.ceil(total / cfg.shard_bytes))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    gid = F.pmod(F.xxhash64(number, text), F.lit(groups)).cast("long").alias("gid")  # rows of one id, or of none, are spread, too
    others, with_text = [c for c in keep if c != "text"], "text" in keep
    more = [F.col("text").isNull().alias("nothing")] if with_text else []
    rows = documents.select(gid, number.alias("id"), text.alias("t"), *more, *(F.col(f"`{c}`").alias(f"own_{c}") for c in others))
    asked = rows.groupBy("gid").applyInArrow(trimmed(_ask(cfg, shards)), "shard long, gid long, blob binary")
    answers = asked.groupBy("shard").applyInArrow(trimmed(_answer(cfg.hot)), "gid long, shard long, blob binary")
    sent = rows.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(trimmed_pair(_send(cfg, shards)), "shard long, gid long, part long, places boolean, blob binary")
    spans = sent.groupBy("shard").applyInArrow(trimmed(_resolve(resolver)), "gid long, part long, places boolean, blob binary")
    schema = StructType()
    for c in others:
        schema.add(f"own_{c}", documents.schema[c].dataType)
    if with_text:
        schema.add("t", BinaryType()).add("nothing", BooleanType())
    for field in StructType.fromDDL(made):
        schema.add(f"made_{field.name}", field.dataType)
    found = rows.groupBy("gid").cogroup(spans.groupBy("gid")).applyInArrow(trimmed_pair(_finish(cfg, finisher, to_arrow_schema(schema))), schema)
    if with_text:
        found = found.withColumn("own_text", F.when(~F.col("nothing"), F.col("t").cast("string"))).drop("t", "nothing")
    return found


def plain(found: DataFrame) -> DataFrame:
    """Without the prefixes of names."""
    return found.toDF(*(c.removeprefix("own_").removeprefix("made_") for c in found.columns))
