"""Quality: a linear-chain conditional random field labels every line good or bad.

A line's unary scores use its own features and those of its neighbouring lines; pair weights tie labels of
consecutive lines. Forward-backward marginals, weighted by the lengths of the lines, give the document's
share of good text, and a logistic curve fitted on the same bounded sample turns it into a score. All texts
of a batch run through forward-backward side by side.

Lines of a labelled document take its label in training. Defined results: null or empty text is one empty
line; lines end at \\n; no labels or one class only gives the smoothed share of the positive label as score;
repeated rows stay rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import PrefixHash, as_bytes, flat, mix, text_batches, words_in

FEATURES = 13


@dataclass(frozen=True)
class QualityConfig:
    """sample, sample_bytes: labelled documents that the model is fitted on at most, those with the smallest hashes of doc_id, and their bytes."""

    sample: int = 6_000
    sample_bytes: int = 24 << 20
    steps: int = 150
    ridge: float = 1e-3
    rate: float = 0.08


def _kinds() -> np.ndarray:
    found = np.zeros((256, 6), np.float32)  # upper case, digit, mark of prose, other mark, space, beyond ASCII
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            found[b, 5] = 1
        elif "A" <= c <= "Z":
            found[b, 0] = 1
        elif c.isdigit():
            found[b, 1] = 1
        elif c in ".,;:?'\"-()":
            found[b, 2] = 1
        elif c in " \t\r\x0b\x0c":
            found[b, 4] = 1
        elif not c.isalpha():
            found[b, 3] = 1
    return found


KINDS = _kinds()


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, texts): byte ranges of lines, and the count of lines before each text."""
    base, end = int(offsets[0]), int(offsets[-1])
    breaks = np.flatnonzero(data[base:end] == 10) + base
    per_text = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    texts = np.concatenate([[0], np.cumsum(per_text)])
    owner = np.repeat(np.arange(len(per_text)), per_text)
    inside = np.arange(len(owner)) - texts[owner]
    first_break = np.searchsorted(breaks, offsets[:-1])
    at = first_break[owner] + inside
    starts = np.where(inside == 0, offsets[:-1][owner], breaks[np.clip(at - 1, 0, max(0, len(breaks) - 1))] + 1 if len(breaks) else 0)
    stops = np.where(inside + 1 == per_text[owner], offsets[1:][owner], breaks[np.clip(at, 0, max(0, len(breaks) - 1))] if len(breaks) else 0)
    return starts, stops, texts


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return run[stops] - run[starts]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths in bytes, count of lines before each text) for the texts laid end to end."""
    base, end = int(offsets[0]), int(offsets[-1])
    starts, stops, texts = lines_of(data, offsets)
    size = (stops - starts).astype(np.float64)
    raw = data[base:end]
    share = np.empty((len(starts), 6))
    for k in range(6):
        share[:, k] = _sums(KINDS[:, k][raw], starts - base, stops - base)
    own = share / np.maximum(size, 1)[:, None]

    w0, w1, _ = words_in(data, offsets)
    first, last = np.searchsorted(w0, starts), np.searchsorted(w0, stops)
    n = (last - first).astype(np.float64)
    hashes = mix(PrefixHash(raw).of(w0 - base, w1 - base)) if len(w0) else np.zeros(0, np.uint64)
    line = np.repeat(np.arange(len(starts)), last - first)
    order = np.lexsort([hashes, line])
    again = np.zeros(len(w0), bool)
    if len(w0) > 1:
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    beside = np.zeros(len(w0), bool)
    if len(w0) > 1:
        beside[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    single = w1 - w0 == 1
    marks = [_sums(x.astype(np.float32), first, last) / np.maximum(n, 1) for x in (again, beside, single)] if len(w0) else [np.zeros(len(starts))] * 3
    closed = np.zeros(len(starts))
    full = size > 0
    closed[full] = np.isin(raw[stops[full] - 1 - base], [ord(c) for c in ".!?"])
    x = np.column_stack(
        [np.ones(len(starts)), *own.T[:4] * 4, own[:, 5], *marks, np.log1p(size) / 5, np.log1p(n) / 3, size / np.maximum(n, 1) / 10, closed]
    )
    x = np.minimum(x, 4.0)
    return x, size, texts


def with_neighbours(x: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Own features beside those of the line before and the line after (zeros at a text's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[texts[:-1]] = 0
    after[texts[1:] - 1] = 0
    return np.hstack([x, before, after])


def marginals(unary: np.ndarray, pair: np.ndarray, texts: np.ndarray, weights: np.ndarray | None = None) -> tuple:
    """P(good) of each line; with weights of the texts also the weighted expected counts of label pairs, and log Z by text.

    unary: (lines, 2) log scores of bad and good; pair: (2, 2) log scores of consecutive labels.
    """
    lengths = np.diff(texts)
    order = np.argsort(-lengths, kind="stable")
    start, length = texts[:-1][order], lengths[order]
    top = unary.max(axis=1, keepdims=True)
    local = np.exp(unary - top)
    link = np.exp(pair - pair.max())
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, most + 1), side="right")  # texts that have a line t
    ahead, behind, scale = np.empty_like(local), np.empty_like(local), np.empty(len(local))
    state = None
    for t in range(most):
        at = start[: active[t]] + t
        state = local[at] if t == 0 else (state[: active[t]] @ link) * local[at]
        scale[at] = state.sum(axis=1)
        state = state / scale[at][:, None]
        ahead[at] = state
    state = np.ones((0, 2))
    for t in range(most - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        now = np.ones((k, 2))
        if len(state):
            nxt = at[: len(state)] + 1
            now[: len(state)] = (state * local[nxt]) @ link.T
        now /= now.sum(axis=1, keepdims=True)
        behind[at] = now
        state = now
    both = ahead * behind
    good = both[:, 1] / both.sum(axis=1)
    if weights is None:
        return (good,)
    later = np.ones(len(local), bool)
    later[texts[:-1][lengths > 0]] = False
    at = np.flatnonzero(later)
    joint = ahead[at - 1][:, :, None] * link[None] * (local[at] * behind[at])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    log_z = np.add.reduceat(np.log(scale) + top[:, 0], texts[:-1]) + (lengths - 1) * pair.max()
    each = np.repeat(weights, lengths)[at]
    return good, (joint * each[:, None, None]).sum(axis=0), log_z


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # of the log odds of good, by feature
    pair: np.ndarray
    slope: float
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, size, texts = line_features(data, offsets)
        if not len(self.weights):
            return np.full(len(offsets) - 1, 1 / (1 + np.exp(-self.bias)))
        good = marginals(_unary(with_neighbours(x, texts), self.weights), self.pair, texts)[0]
        return 1 / (1 + np.exp(-np.clip(self.slope * _log_odds(_mean(good, size, texts)) + self.bias, -40, 40)))


def _unary(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.clip(x @ w, -60, 60)
    return np.column_stack([-z / 2, z / 2])


def _mean(good: np.ndarray, size: np.ndarray, texts: np.ndarray) -> np.ndarray:
    weight = size + 1
    return np.add.reduceat(good * weight, texts[:-1]) / np.add.reduceat(weight, texts[:-1])


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def loss(theta: np.ndarray, x: np.ndarray, y: np.ndarray, places: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the line labels and its gradient. All lines of a text have its label y; a text counts with one over the root
    of its count of lines, so that long ones count more than short ones and less than their lines."""
    lengths = np.diff(places)
    each = 1 / np.sqrt(lengths)
    total = (each * lengths).sum()
    w, pair = theta[:-4], theta[-4:].reshape(2, 2)
    unary = _unary(x, w)
    good, joint, log_z = marginals(unary, pair, places, each)
    label = np.repeat(y, lengths)
    told = np.diag([(each * (lengths - 1) * (y == k)).sum() for k in (0, 1)])  # label pairs, all of equal labels
    said = np.add.reduceat(unary[np.arange(len(x)), label.astype(int)], places[:-1]) + (lengths - 1) * np.diag(pair)[y.astype(int)]
    value = (each * (log_z - said)).sum() / total + ridge * (theta**2).sum()
    g = np.concatenate([((good - label) * np.repeat(each, lengths)) @ x, (joint - told).ravel()]) / total + 2 * ridge * theta
    return float(value), g


def fit(texts: list[bytes], y: np.ndarray, cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """Conditional likelihood of line labels by gradient steps; then the curve from document shares to labels."""
    y = np.asarray(y, dtype=np.float64)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(0), np.zeros((2, 2)), 0.0, base)
    parts, at = [], 0
    while at < len(texts):  # features of a megabyte or so at a time: they take many times the text's memory
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= 1 << 20):
            held += len(texts[to])
            to += 1
        data = np.frombuffer(b"".join(texts[at:to]), np.uint8)
        own, size, places = line_features(data, np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])]))
        parts.append((with_neighbours(own, places), size, np.diff(places)))
        at = to
    x, size, counts = (np.concatenate(p) for p in zip(*parts))
    places = np.concatenate([[0], np.cumsum(counts)])
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, cfg.steps + 1):
        _, g = loss(theta, x, y, places, cfg.ridge)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= cfg.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    w, pair = theta[:-4], theta[-4:].reshape(2, 2)
    share = _log_odds(_mean(marginals(_unary(x, w), pair, places)[0], size, places))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression in one variable
        p = 1 / (1 + np.exp(-np.clip(a * share + b, -40, 40)))
        r, d = p - y, p * (1 - p) + 1e-6
        h = np.array([[(d * share * share).sum() + 1e-3, (d * share).sum()], [(d * share).sum(), d.sum() + 1e-3]])
        change = np.linalg.solve(h, [(r * share).sum() + 1e-3 * (a - 1), r.sum()])
        a, b = a - np.clip(change[0], -1, 1), b - np.clip(change[1], -1, 1)
    return QualityModel(w, pair, float(a), float(b))


def fit_sample(sample: DataFrame, cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """sample: (doc_id, text, y), bounded by cfg.sample and cfg.sample_bytes."""
    found = sample.select("doc_id", F.col("text").cast("binary").alias("t"), "y").toArrow().combine_chunks()
    data, offsets = flat(found["t"])
    rows = sorted(zip(found["doc_id"].to_pylist(), found["y"].to_pylist(), (data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:]))))
    return fit([t for _, _, t in rows], np.array([float(y != 0) for _, y, _ in rows]), cfg)


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, offsets in text_batches(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(model.score(data, offsets))], ["doc_id", "score"])

    found = as_bytes(documents).mapInArrow(run, "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
