"""Suffix-array dedup: a suffix sort, eight bytes after eight, over the bytes of texts.

Windows of 50 bytes that also start in a document with a smaller id are found by sorting the suffixes at their starts.
Suffixes fall into ties by their first eight bytes. A tie whose neighbours are all equal, in all bytes, is done; what the
others hold falls into smaller ties by the next eight, until none is left that differs within. Nothing is hashed: suffixes
of one tie are equal byte by byte.
"""

from __future__ import annotations

import sys
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Piece, RepeatConfig, kept_of, plain, remove_repeats


#: Suffixes compared with their neighbours at a time.
BLOCK = 1 << 15


class Suffixes:
    """Suffixes of a text at given starts, compared by their first `limit` bytes, all of which must lie within the text."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, limit: int) -> None:
        self.starts, self.limit, self.span = starts, limit, min(8, limit)
        text = np.ascontiguousarray(text, np.uint8)
        if self.limit < 8:  # a number takes in more bytes than are compared: room behind the last ones
            text = np.append(text, np.zeros(8, np.uint8))
        self.words = np.ndarray(max(0, len(text) - 7), np.uint64, text, strides=(1,))
        #: Where the bytes compared are read, eight at a time; the last eight overlap those before.
        self.steps = [*range(0, limit - 7, 8), *([limit - 8] if limit % 8 and limit > 8 else [])] or [0]

    def heads(self, starts: np.ndarray, step: int) -> np.ndarray:
        """The eight bytes at a step of each suffix (fewer below a limit of eight) as a number that sorts like them."""
        found = self.words[starts + step]
        if sys.byteorder == "little":
            found = found.byteswap(inplace=True)
        return found >> np.uint64(8 * (8 - self.span)) if self.span < 8 else found

    def _differ(self, starts: np.ndarray, steps: list[int]) -> np.ndarray:
        """Is each suffix another than the one before it, by its bytes from the given steps on."""
        found = np.zeros(len(starts), bool)
        for at in range(0, len(starts), BLOCK):
            part = starts[max(0, at - 1) : at + BLOCK]
            for step in steps:
                heads = self.heads(part, step)
                found[at + (at == 0) : at + BLOCK] |= heads[1:] != heads[:-1]
        return found

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, flags of those that differ from the one before); equal ones are in the order of their indexes."""
        n = len(self.starts)
        heads = self.heads(self.starts, 0)
        order = np.argsort(heads)
        heads = heads[order]
        new = np.ones(n, bool)
        new[1:] = heads[1:] != heads[:-1]
        own = np.arange(n)  # places in order that may still change
        for k in range(1, len(self.steps)):
            own = self._mixed(order, new, own, self.steps[k:])
            if not len(own):
                break
            part = order[own]
            heads = self.heads(self.starts[part], self.steps[k])
            tie = np.cumsum(new[own]).astype(np.uint64)
            by_head = np.argsort(heads)
            by_tie = np.sort(tie[by_head] << np.uint64(32) | np.arange(len(own), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
            moved = by_head[by_tie]
            order[own] = part[moved]
            heads = heads[moved]
            new[own[1:]] |= heads[1:] != heads[:-1]
        rank = np.cumsum(new).astype(np.uint64) << np.uint64(32)
        return (np.sort(rank | order.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64), new

    def _mixed(self, order: np.ndarray, new: np.ndarray, own: np.ndarray, steps: list[int]) -> np.ndarray:
        """Of the places `own`, those in ties of which some differ from the one before them by what is read at the steps to come."""
        first = np.flatnonzero(new[own])
        sizes = np.diff(np.append(first, len(own)))
        several = np.repeat(sizes > 1, sizes)
        own = own[several]
        if not len(own):
            return own
        differ = self._differ(self.starts[order[own]], steps)
        first, sizes = np.flatnonzero(new[own]), sizes[sizes > 1]
        differ[first] = False
        return own[np.repeat(np.logical_or.reduceat(differ, first), sizes)]

    def order(self) -> np.ndarray:
        """Indexes of the suffixes, sorted; equal ones in the order of their indexes."""
        return self.classes()[0]


def resolve(text: np.ndarray, starts: np.ndarray, _lengths: np.ndarray, windows: np.ndarray, ids: np.ndarray, _highest: np.ndarray, limit: int = 50) -> np.ndarray:
    """The smallest id under which each window starts: that of the equal suffixes beside it in the sorted order."""
    place = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    order, new = Suffixes(text, place, limit).classes()
    first = np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(np.repeat(ids, windows)[order], first), np.diff(np.append(first, len(order))))
    return least


def _digests(piece: Piece, removed: np.ndarray) -> dict:
    n, gone, spans, digest = [], [], [], []
    for units, out, flags, kept in kept_of(piece, removed):
        n.append(units)
        gone.append(out)
        spans.append(int((flags[1:] & ~flags[:-1]).sum() + flags[0]) if units else 0)
        digest.append(sha256(kept).hexdigest())
    return {"n_bytes": n, "n_removed": gone, "n_spans": spans, "kept_sha256": digest}


def _kept(piece: Piece, removed: np.ndarray) -> dict:
    found = list(kept_of(piece, removed))
    spans = []
    for _, _, flags, _ in found:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
        spans.append(edges.tolist())
    return {"kept": [x[3] for x in found], "spans": spans}


CONFIG = RepeatConfig(window=50, gram=24, unit="byte")


def digests(documents: DataFrame, cfg: RepeatConfig = CONFIG) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    return plain(remove_repeats(documents, resolve, _digests, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", cfg))


def dedup_bytes(documents: DataFrame, cfg: RepeatConfig = CONFIG) -> DataFrame:
    """(doc_id, kept binary, spans array<long>) for every row: remaining bytes, and the removed runs as [from, to, from, to, ...]."""
    return plain(remove_repeats(documents, resolve, _kept, "kept binary, spans array<long>", cfg))
