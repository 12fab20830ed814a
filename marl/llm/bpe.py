"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is a finite-state machine over classes of code points (letter, number, space, other, and a
few with one code point of context). The machine's transition functions compose associatively: the text of a
batch is laid out as many stretches side by side, the function of every stretch is composed for all states at
once, a scan over stretches gives each one its entry state, and a second pass marks the boundaries. Distinct
slices are then merged pair by pair through a bounded cache; the ids of a document are laid out from them with
their offsets, from which decoding restores the bytes.

Defined results: null text is empty (no ids); repeated rows stay rows; texts of any length are encoded whole;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa

from .text import gather, give_back, text_batches

#: Cached slices of one Python worker; on overflow the cache starts anew.
CACHED = 100_000
#: Bytes of text encoded at a time: ids and slices take about fifty times their text while they are made.
PIECE = 1 << 19
#: Slices up to this many bytes are merged side by side, those up to LISTED as lists; rank of a pair that doesn't merge.
SIDE_BY_SIDE, LISTED, NEVER = 64, 512, 1 << 30
#: Pairs of one rank that a long slice merges at a time once a merge has made a pair of lower rank.
CAREFUL = 16
#: Stretches that are scanned side by side.
STRETCHES = 2048

# Classes of code points, and those that context makes of them.
LETTER, NUMBER, OTHER, SPACE, LAST_BLANK, LAST_SPACE, SHORT, LONG = range(8)
# States of the machine; FRESH: a token has just ended whatever comes.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary-before flag by (class, state). A blank that ends a run of white space belongs to
    what follows; an apostrophe at the start of a token with a known ending takes one or two letters with it."""
    into = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: IN_SPACE, LAST_BLANK: AFTER_BLANK, LAST_SPACE: FRESH, SHORT: ONE_LEFT, LONG: TWO_LEFT}
    step, starts = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for c in range(8):
        for s in range(8):
            to, begins = into[c], True
            if s == ONE_LEFT and c == LETTER:
                to, begins = FRESH, False
            elif s == TWO_LEFT and c == LETTER:
                to, begins = ONE_LEFT, False
            elif c in (SHORT, LONG) and s in (IN_OTHER, AFTER_BLANK):
                to, begins = IN_OTHER, False
            elif s == AFTER_BLANK and c in (LETTER, NUMBER, OTHER):
                begins = False
            elif s == to and c in (LETTER, NUMBER, OTHER, SPACE):
                begins = False
            step[c, s], starts[c, s] = to, begins
    return step, starts


STEP, STARTS = _machine()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    found = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            found[i] = LETTER
        elif kind == "N":
            found[i] = NUMBER
    # the code points with the property White_Space
    for a, b in ((9, 13), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        found[a : b + 1] = SPACE
    return found


def boundaries(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a token starts; begins: indexes at which a text starts."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[begins[begins < n]] = True
    first[n] = True
    space = kind == SPACE
    last = space[:-1] & ~space[1:] & ~first[1:-1]
    kind[:-1][last] = np.where(points[:-1][last] == 32, LAST_BLANK, LAST_SPACE)
    quotes = np.flatnonzero(points == 39)
    quotes = quotes[(quotes + 1 < n)]
    quotes = quotes[~first[quotes + 1]]
    next_one = points[quotes + 1]
    kind[quotes[np.isin(next_one, [ord(x) for x in "stmd"])]] = SHORT
    two = quotes[(quotes + 2 < n)]
    two = two[~first[two + 2]]
    pairs = points[two + 1].astype(np.int64) << 21 | points[two + 2]
    kind[two[np.isin(pairs, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG

    width = -(-n // STRETCHES)
    whole = np.full(width * STRETCHES, OTHER, np.uint8)
    whole[:n] = kind
    fresh = np.zeros(width * STRETCHES, bool)
    fresh[:n] = first[:n]
    # tables with a second half for code points that begin a text: there every state counts as FRESH
    step = np.concatenate([STEP, np.repeat(STEP[:, FRESH : FRESH + 1], 8, axis=1)]).ravel()
    starts = np.concatenate([STARTS, np.ones((8, 8), bool)]).ravel()
    symbol = ((whole + np.uint8(8) * fresh).astype(np.int32) * 8).reshape(STRETCHES, width).T.copy()
    functions = np.tile(np.arange(8, dtype=np.uint8), (STRETCHES, 1))
    for row in symbol:
        functions = step[row[:, None] + functions]
    state = np.zeros(STRETCHES, np.uint8)
    at = FRESH
    for i, f in enumerate(functions.tolist()):
        state[i] = at
        at = f[at]
    flags = np.empty(symbol.shape, bool)
    for j, row in enumerate(symbol):
        place = row + state
        flags[j] = starts[place]
        state = step[place]
    return flags.T.ravel()[:n]


class Vocabulary:
    """Ranks of a tiktoken file, cached merging, and decoding."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = {i: b for b, i in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the pair of lowest rank is merged first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        never = NEVER
        pairs = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) != never:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], never)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
        return tuple(ranks[p] for p in parts)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """merge() of one very long slice. Symbols form a linked list, and the places of pairs wait by rank: each round merges the pairs
        of the lowest rank from the left, up to the first that makes a pair of a lower rank still."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        symbols = self.pairs[2][np.frombuffer(piece, np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NEVER)
        rank[:-1] = self._joined(symbols[:-1], symbols[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != NEVER]
            places = places[np.argsort(rank[places], kind="stable")]
            for part in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1) if len(places) else ():
                low = int(rank[part[0]])
                if low not in waiting:
                    waiting[low] = []
                    heappush(queue, low)
                waiting[low].append(part)

        wait(np.arange(n))
        most = n
        while queue:
            low = heappop(queue)
            places = np.concatenate(waiting.pop(low))
            places = np.unique(places[rank[places] == low])
            while len(places):
                at, places = places[:most], places[most:]
                at = at[rank[at] == low]
                if not len(at):
                    continue
                # of pairs that overlap every second one merges, from the left
                chained = np.zeros(len(at), bool)
                chained[1:] = after[at[:-1]] == at[1:]
                count, every = np.arange(len(at)), at
                at = at[(count - np.maximum.accumulate(np.where(chained, 0, count))) % 2 == 0]
                made = self._round(symbols, after, before, rank, at, low)
                lower = np.flatnonzero(made < low)
                if len(lower) and lower[0] + 1 < len(at):  # undone from there on, to come after the lower pairs
                    keep = lower[0] + 1
                    self._undo()
                    at = at[:keep]
                    places = np.concatenate([every[every > at[-1]], places])
                    self._round(symbols, after, before, rank, at, low)
                most = max(CAREFUL, 2 * len(at)) if not len(lower) else CAREFUL
                left = before[at]
                wait(np.unique(np.concatenate([at, left[left >= 0]])))
                if len(lower) and len(places):
                    wait(places[rank[places] == low])
                    break
        found, i = [], 0
        while i < n:
            found.append(int(symbols[i]))
            i = int(after[i])
        return tuple(found)

    def _round(self, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, rank: np.ndarray, at: np.ndarray, low: int) -> np.ndarray:
        """Merges the pairs at `at` and ranks what is beside them. For each the lower of the ranks on both sides, as they are when those on its
        left have merged and those on its right have not."""
        n, gone = len(symbols), after[at]
        then = after[gone]
        inner = then < n
        made = np.full(len(at), NEVER)
        made[inner] = self._joined(np.full(int(inner.sum()), low), symbols[then[inner]])
        left = before[at]
        self._before = [(x, i, x[i]) for x, i in ((symbols, at), (after, at), (before, then[inner]), (rank, at), (rank, gone), (rank, left[left >= 0]))]
        symbols[at] = low
        after[at] = then
        before[then[inner]] = at[inner]
        rank[gone] = NEVER
        rank[at] = NEVER
        rank[at[inner]] = self._joined(symbols[at[inner]], symbols[then[inner]])
        left = before[at]
        first = left >= 0
        rank[left[first]] = self._joined(symbols[left[first]], symbols[at[first]])
        made[first] = np.minimum(made[first], rank[left[first]])
        return made

    def _undo(self) -> None:
        for x, i, was in reversed(self._before):
            x[i] = was

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted (left id, right id) keys of all pairs that merge, the ids they merge to, and the ids of single bytes."""
        keys, ids = [], []
        for piece, i in self.ranks.items():
            for at in range(1, len(piece)):
                left, right = self.ranks.get(piece[:at]), self.ranks.get(piece[at:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    ids.append(i)
        keys, ids = np.array([*keys, np.iinfo(np.int64).max]), np.array([*ids, NEVER])
        order = np.argsort(keys)
        return keys[order], ids[order], np.array([self.ranks[bytes([i])] for i in range(256)])

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ids, _ = self.pairs
        wanted = left << 20 | right
        at = np.searchsorted(keys, wanted)
        return np.where(keys[at] == wanted, ids[at], NEVER)

    def merge_many(self, slices: list[bytes]) -> list[tuple[int, ...]]:
        """merge() of many slices side by side: each round merges in every slice its leftmost pair of lowest rank."""
        size = np.array([len(x) for x in slices])
        symbols = self.pairs[2][np.frombuffer(b"".join(slices), np.uint8)]
        owner = np.repeat(np.arange(len(slices)), size)
        last = np.cumsum(size) - 1
        rank = np.full(len(symbols), NEVER)
        inside = np.ones(len(symbols), bool)
        inside[last] = False
        at = np.flatnonzero(inside)
        rank[at] = self._joined(symbols[at], symbols[at + 1])
        live, done = np.arange(len(slices)), [()] * len(slices)
        while len(live):
            count = size[live]
            start = np.cumsum(count) - count
            low = np.minimum.reduceat(rank, start)
            ready = low == NEVER
            if ready.any():
                told = np.repeat(ready, count)
                flat_ids, ends = symbols[told].tolist(), np.cumsum(count[ready]).tolist()
                for i, a, b in zip(live[ready].tolist(), [0, *ends], ends):
                    done[i] = tuple(flat_ids[a:b])
                symbols, owner, rank, live, low = symbols[~told], owner[~told], rank[~told], live[~ready], low[~ready]
                if not len(live):
                    break
                count = size[live]
            hits = np.flatnonzero(rank == np.repeat(low, count))
            first = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            symbols[first] = rank[first]
            left = np.ones(len(symbols), bool)
            left[first + 1] = False
            symbols, owner = symbols[left], owner[left]
            rank = rank[left]
            size[live] -= 1
            first = first - np.arange(len(first))
            after = np.append(owner[1:], -1)[first] == owner[first]
            rank[first] = NEVER
            rank[first[after]] = self._joined(symbols[first[after]], symbols[first[after] + 1])
            before = first[(first > 0) & (owner[np.maximum(first - 1, 0)] == owner[first])]
            rank[before - 1] = self._joined(symbols[before - 1], symbols[before])
        return done

    def learn(self, slices: list[bytes]) -> None:
        """Puts the ids of slices that the cache lacks into it."""
        if len(self.cache) >= CACHED:
            self.cache.clear()
        cache, ranks = self.cache, self.ranks
        new = [s for s in set(slices) if s not in cache]
        several = []
        for s in new:
            if (whole := ranks.get(s)) is not None:
                cache[s] = (whole,)
            elif len(s) > SIDE_BY_SIDE:
                cache[s] = self.merge(s) if len(s) <= LISTED else self.merge_long(s)
            else:
                several.append(s)
        if several:
            cache.update(zip(several, self.merge_many(several)))

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts laid end to end as UTF-8 (data, offsets): ids, the count of ids before each text, and the byte offset at which each id starts."""
        base, end = int(offsets[0]), int(offsets[-1])
        raw = data[base:end]
        whole = raw.tobytes()
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), "<u4")
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each code point starts
        begins = np.searchsorted(at, np.unique(offsets[:-1] - base))
        cut = np.concatenate([at[boundaries(points, begins)], [len(whole)]]).astype(np.int64)
        slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(whole)]).dictionary_encode()
        distinct, code = slices.dictionary.to_pylist(), slices.indices.to_numpy()
        self.learn(distinct)
        known = list(map(self.cache.__getitem__, distinct))
        counts = np.fromiter(map(len, known), np.int64, len(known))
        flat_ids = np.fromiter(chain.from_iterable(known), np.int32, int(counts.sum()))
        sizes = counts[code]
        ids = gather(flat_ids, (np.cumsum(counts) - counts)[code], sizes)
        before = np.concatenate([[0], np.cumsum(sizes)])
        counts = before[np.searchsorted(cut, offsets - base)]
        lengths = self.pieced[2][ids]
        return ids, counts, np.cumsum(lengths) - lengths

    def _laid(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in texts], np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths

    @cached_property
    def pieced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all ids laid end to end, where those of each id start, and how many they are."""
        return self._laid([self.pieces.get(i, b"") for i in range(max(self.pieces) + 1)])

    @cached_property
    def printed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of all ids as decimal numbers with a comma behind each."""
        return self._laid([b"%d," % i for i in range(max(self.pieces) + 1)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_decode(path: str, ids: bool = False, digest: bool = True):
    """A mapInArrow function of (doc_id, text binary).

    digest: ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of the bytes decoded from them); ids: ids
    array<int> and starts array<int>, the byte offset of each id. The vocabulary file must be at `path` on every executor.
    """
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what a worker has kept of another stage: the vocabulary takes its place
        vocab = vocabulary(path)
        vocab.cache.clear()  # of the task before: workers live on, their memory is for others, too
        for keys, data, offsets in text_batches(batches, PIECE):
            found, counts, starts = vocab.encode_batch(data, offsets)
            out = {"doc_id": keys, "n_tokens": pa.array(np.diff(counts))}
            if digest:
                for name, table, spare in (("ids_sha256", vocab.printed, 1), ("decoded_sha256", vocab.pieced, 0)):
                    lengths = table[2][found]
                    laid = gather(table[0], table[1][found], lengths).tobytes()
                    ends = np.concatenate([[0], np.cumsum(lengths)])[counts].tolist()
                    out[name] = pa.array([sha256(laid[a : max(a, b - spare)]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())
            if ids:
                where = pa.array(counts, pa.int32())
                out["ids"] = pa.ListArray.from_arrays(where, pa.array(found))
                own = starts - np.repeat(offsets[:-1] - offsets[0], np.diff(counts))
                out["starts"] = pa.ListArray.from_arrays(where, pa.array(own.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)
        vocab.cache.clear()
        give_back()

    return run


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, n_tokens long, ids array<int>, starts array<int>"
BOTH = f"{DIGEST}, ids array<int>, starts array<int>"
