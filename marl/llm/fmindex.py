"""Substring dedup: a compressed FM-index per shard, searched backward over a wavelet tree.

A shard's segments are laid end to end as word numbers. Of their suffix array the index keeps the Burrows-Wheeler transform as a
wavelet matrix of packed bits with 32-bit rank blocks, the common lengths of neighbouring suffixes up to the threshold with the
nearest shorter ones on both sides, and the least document ids of blocks of suffixes; the suffix array itself isn't kept, so that
where a text stands in it is found by searching only. Every segment is streamed through the index side by side with others, from
its last word to its first, and matched with documents of smaller ids alone: a step of backward search extends the match by one
word to the left; an interval that is empty or holds no smaller id is refused, and the match gives up words on the right, to the
next longest one that stands elsewhere, until the step succeeds or nothing is left. That gives the matching statistics, the length
of the longest match with an earlier document that begins at each word, up to the threshold. Where they reach it, the least id of
the interval is the smallest under which the window starts; neighbouring windows with one such id are reported as an interval.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Piece, RepeatConfig, kept_of, plain, remove_repeats
from .text import gather


class Bits:
    """A packed bit vector whose ranks are counted for each 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(len(bits) + 64 - len(bits) % 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate([[0], ones[:-1]]).astype(np.int32 if len(bits) < 1 << 31 else np.int64)
        self.ones = int(ones[-1])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = place >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))


#: The lowest bits of a number, as many as the place says.
BELOW = (np.int64(1) << np.arange(32, dtype=np.int64)) - 1


def _packed(bits: np.ndarray) -> np.ndarray:
    """For each 32 places one number: how many ones come before, and the places' own bits below that."""
    padded = np.zeros(len(bits) + 32 - len(bits) % 32, bool)
    padded[: len(bits)] = bits
    words = np.packbits(padded, bitorder="little").view(np.uint32).astype(np.int64)
    ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
    return (np.concatenate([[0], ones[:-1]]) << 32) | words


class WaveletMatrix:
    """Ranks of symbols in a sequence: a tree of four branches a level, two bits of the symbols each, one bit vector for each branch."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        for shift in range(2 * (-(-bits // 2) - 1), -1, -2):
            digit = (symbols >> shift) & 3
            branches = [digit == d for d in range(4)]
            tables = [_packed(x) for x in branches]
            sizes = np.array([int(x.sum()) for x in branches])
            self.levels.append((shift, np.concatenate(tables), np.arange(4) * len(tables[0]), np.cumsum(sizes) - sizes))
            symbols = np.concatenate([symbols[x] for x in branches])

    def descend(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where places (in rows, all for the same symbols) end up among the symbols ordered by their last bits: for two places, the difference
        counts the symbol between them."""
        for shift, table, base, start in self.levels:
            digit = (symbols >> shift) & 3
            entry = table[(place >> 5) + base[digit]]
            place = (entry >> 32) + np.bitwise_count(entry & BELOW[place & 31])
            place += start[digit]
        return place


class LeastId:
    """Least values of ranges: each is covered by two stretches of a power of two, which are tabled for every place up to BLOCK and for every
    BLOCK places beyond."""

    BLOCK = 16

    def __init__(self, values: np.ndarray) -> None:
        self.kinds, ranks = np.unique(values, return_inverse=True)
        self.n, k = len(values), self.BLOCK
        self.near = [ranks.astype(np.int32)]
        for j in range(k.bit_length() - 1):
            self.near.append(self._doubled(self.near[-1], 1 << j))
        self.near = np.concatenate(self.near)
        self.far = [self.near[-self.n :][::k]]  # of BLOCK places from every BLOCK-th on
        while len(self.far[-1]) > 1 << (len(self.far) - 1):
            self.far.append(self._doubled(self.far[-1], 1 << (len(self.far) - 1)))

    @staticmethod
    def _doubled(least: np.ndarray, by: int) -> np.ndarray:
        now = least.copy()
        now[:-by] = np.minimum(now[:-by], least[by:])
        return now

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The rank, among kinds, of the least value of each [low, high), none of them empty."""
        size = high - low
        level = np.minimum(np.frexp(size.astype(np.float32))[1] - 1, self.BLOCK.bit_length() - 1).astype(np.int64)
        base = level * self.n
        found = np.minimum(self.near[base + low], self.near[base + high - (np.int64(1) << level)])
        long = np.flatnonzero(size > 2 * self.BLOCK)
        if len(long):
            start, stop = -(-low[long] // self.BLOCK), high[long] // self.BLOCK
            count = stop - start
            level = np.frexp(count.astype(np.float64))[1] - 1
            for one in range(int(level.max(initial=-1)) + 1):
                own = np.flatnonzero((level == one) & (count > 0))
                if not len(own):
                    continue
                least = self.far[one]
                found[long[own]] = np.minimum(found[long[own]], np.minimum(least[start[own]], least[stop[own] - (1 << one)]))
        return found


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int, owners: np.ndarray | None = None) -> None:
        """text: numbers, each segment closed by 0; owners: an id for each place. Matches of up to `depth` symbols can be searched."""
        n, self.depth = len(text), depth
        most = int(text.max(initial=0)) + 1
        order, self.common = _sorted_suffixes(text, most, depth)
        # nearest suffixes on both sides whose common length is shorter: a match gives up words by going to them
        self.before, self.after = _shorter(self.common, depth)
        self.owners = LeastId((owners if owners is not None else np.arange(n))[order])
        short = np.flatnonzero(self.common < depth - 1)  # where suffixes differ before the last but one symbol of the depth
        self.cut, self.cuts = Bits(np.isin(np.arange(n), short)), np.append(short, n)
        self.tree = WaveletMatrix(text[order - 1], max(1, most.bit_length()))  # before the first suffix the last symbol, a 0
        count = np.bincount(text, minlength=most)
        self.size, self.first = n, np.cumsum(count) - count
        self.zero = self.tree.descend(np.arange(most), np.zeros(most, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that begin with the symbol and go on as those of [low, high) do."""
        both = self.tree.descend(symbols, np.stack([low, high])) + (self.first[symbols] - self.zero[symbols])
        return both[0], both[1]

    def shorter(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, length): the suffixes that share the next shorter beginning with those of [low, high), which aren't all."""
        left = np.where(low > 0, self.common[low], -1)
        right = np.where(high < self.size, self.common[np.minimum(high, self.size - 1)], -1)
        at = np.where(left >= right, low, np.minimum(high, self.size - 1))
        return self.before[at], self.after[at], np.maximum(left, right)

    def statistics(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(match, least) for each place of the streamed stretches, one after the other: the length, up to the depth and within its stretch, of
        the longest match that begins there with an owner smaller than the stretch's `below`, and the least owner of such matches of full depth
        (else -1)."""
        order = np.argsort(-lengths, kind="stable")
        start, length, below = starts[order], lengths[order], np.searchsorted(self.owners.kinds, below[order])
        base = (np.cumsum(lengths) - lengths)[order]
        match, found = np.zeros(int(lengths.sum()), np.int32), np.full(int(lengths.sum()), -1, np.int64)  # ids by their rank
        low, high, have = np.zeros(len(order), np.int64), np.full(len(order), self.size), np.zeros(len(order), np.int64)
        for step in range(1, int(length[0]) + 1 if len(length) else 1):
            live = int(np.searchsorted(-length, -step, "right"))  # the longest come first
            symbol = text[start[:live] + length[:live] - step]
            full = np.flatnonzero(have[:live] == self.depth)
            if len(full):  # a match of full depth gives up its last word first
                own = self.cut.rank(low[full] + 1) - 1
                low[full], high[full], have[full] = self.cuts[own], self.cuts[own + 1], self.depth - 1
            waiting = np.arange(live)
            while len(waiting):
                a, b = self.extend(symbol[waiting], low[waiting], high[waiting])
                good = a < b
                least = np.full(len(waiting), -1)
                some = np.flatnonzero(good)
                least[some] = self.owners.of(a[some], b[some])
                good[some] = least[some] < below[waiting[some]]
                some = np.flatnonzero(good)
                done = waiting[some]
                low[done], high[done] = a[some], b[some]
                have[done] += 1
                match[base[done] + length[done] - step] = have[done]
                deep = have[done] == self.depth
                found[(base[done] + length[done] - step)[deep]] = least[some][deep]
                waiting = waiting[~good]
                waiting = waiting[have[waiting] > 0]  # a symbol that no earlier owner has matches nothing
                if len(waiting):
                    low[waiting], high[waiting], have[waiting] = self.shorter(low[waiting], high[waiting])
        return match, np.where(found >= 0, self.owners.kinds[found], -1)


def _sorted_suffixes(text: np.ndarray, most: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes by their first `depth` symbols, at least; how many symbols each shares with the one before, up to `depth`)."""
    n, bits, step = len(text), most.bit_length(), 1
    ranks = [(1, text.astype(np.int64))]  # equal ranks: equal first symbols, as many as the step says
    rank = text.astype(np.int64)
    while step < depth:
        after = np.zeros(n, np.int64)
        if 2 * step * bits <= 62:  # as many symbols in one number as fit
            after[: max(0, n - step)] = rank[step:]
            rank = rank << (step * bits) | after
        else:
            if int(rank.max(initial=0)) >= n:
                rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
        ranks.append((step, rank))
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    same = np.zeros(len(a), np.int64)
    for step, rank in reversed(ranks):
        inside = np.flatnonzero((a < n) & (b < n) & (same < depth))
        equal = inside[rank[a[inside]] == rank[b[inside]]]
        same[equal] += step
        a[equal] += step
        b[equal] += step
    common[1:] = np.minimum(same, depth)
    return order, common.astype(np.int32)


def _shorter(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, after): the nearest place on the left, and on the right, with a smaller number; 0 and the length where there is none."""
    n = len(common)
    before, after = np.zeros(n, np.int32), np.full(n, n, np.int32)
    by = np.argsort(common, kind="stable")
    edges = np.searchsorted(common[by], np.arange(depth + 2))
    smaller = np.zeros(n, bool)
    for value in range(1, depth + 1):
        smaller[by[edges[value - 1] : edges[value]]] = True
        own = by[edges[value] : edges[value + 1]]
        if len(own):
            places = np.flatnonzero(smaller)
            at = np.searchsorted(places, own)
            before[own] = np.where(at > 0, places[np.maximum(at - 1, 0)], 0)
            after[own] = np.where(at < len(places), places[np.minimum(at, len(places) - 1)], n)
    return before, after


def numbers(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The segments' words, which single blanks part, as numbers from 1, each segment closed by 0."""
    laid = gather(text, starts, lengths)
    ends = np.cumsum(lengths)
    blank = laid == 32
    blanks = np.flatnonzero(blank)
    parts = np.concatenate([blanks, ends])  # where words end: at a blank, which belongs to no word, or with their segment
    order = np.argsort(parts, kind="stable")
    sizes = np.diff(np.concatenate([[0], parts[order]]))
    sizes[1:] -= order[:-1] < len(blanks)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(laid[~blank].tobytes())])
    found = np.zeros(len(sizes) + len(ends), np.int64)
    closing = np.searchsorted(parts[order], ends) + 1 + np.arange(len(ends))
    place = np.ones(len(found), bool)
    place[closing] = False
    found[place] = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    return found


#: Windows of a stretch that is streamed: longer segments are streamed in several, side by side, each from the words that its last window needs.
STREAMED = 256


def resolve(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, windows: np.ndarray, ids: np.ndarray, highest: np.ndarray, size: int = 50) -> np.ndarray:
    """The smallest id under which each window of `size` words starts, from the matching statistics of its segment with documents below the
    segment's highest id; a window without such a match starts under its own."""
    laid = numbers(text, starts, lengths)
    words = windows + size - 1
    begin = np.cumsum(words + 1) - words - 1
    index = FMIndex(laid, size, np.repeat(ids, words + 1))
    parts = -(-windows // STREAMED)
    segment = np.repeat(np.arange(len(windows)), parts)
    first = (np.arange(len(segment)) - np.repeat(np.cumsum(parts) - parts, parts)) * STREAMED
    count = np.minimum(STREAMED, windows[segment] - first)
    match, least = index.statistics(laid, begin[segment] + first, count + size - 1, highest[segment])
    place = np.repeat(np.cumsum(count + size - 1) - (count + size - 1) - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return np.where(match[place] == size, least[place], np.repeat(ids, windows))


def _digests(piece: Piece, removed: np.ndarray) -> dict:
    found = list(kept_of(piece, removed))
    return {"n_words": [x[0] for x in found], "n_removed": [x[1] for x in found], "kept_sha256": [sha256(x[3]).hexdigest() for x in found]}


def _texts(piece: Piece, removed: np.ndarray) -> dict:
    found = list(kept_of(piece, removed))
    return {"kept": [x[3].decode("utf-8") if x[1] else None for x in found], "n_removed": [x[1] for x in found]}


CONFIG = RepeatConfig(window=50, gram=10, unit="word", group_bytes=4 << 20)


def digests(documents: DataFrame, cfg: RepeatConfig = CONFIG) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    return plain(remove_repeats(documents, resolve, _digests, "n_words long, n_removed long, kept_sha256 string", cfg))


def dedup_words(documents: DataFrame, cfg: RepeatConfig = CONFIG) -> DataFrame:
    """documents with repeated passages cut out of text, other columns as they are; texts without a repeat stay as they were written."""
    done = remove_repeats(documents, resolve, _texts, "kept string, n_removed long", cfg, tuple(documents.columns))
    text = F.when(F.col("made_n_removed") > 0, F.col("made_kept")).otherwise(F.col("own_text"))
    return done.select(*((text if c == "text" else F.col(f"`own_{c}`")).alias(c) for c in documents.columns))
