"""Toxicity: a linear classifier over words and word beginnings, regularised by counterfactuals.

Identity terms come from two places: groups that are given (a parameter), and the labelled sample itself, of which
words are taken that toxic and clean texts hold alike, each with those others that stand between the same neighbours.
Identity terms are features of the model like the words that tell the classes apart. In every sentence of the labelled
sample that holds one, the term is exchanged for the others it goes with, and the squared change of score, averaged
over all such pairs of sentences, is added to the loss, so that the mere mention of a group carries no weight.
Statistics for the choice of features come from the labelled sample, which is bounded; scoring reads every whole text.

Defined results: null or empty text scores as a text without evidence; labels without a document or with a null label
are left out; repeated rows of labels or of a labelled document count once in the sample; with no labels, or one class
only, the score is the smoothed share of the positive label; repeated documents stay rows; ties in the choice of
features go by their names; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .text import as_bytes, long_texts, text_batches, trimmed_batches

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Words remembered with their evidence by one Python worker.
CACHED = 200_000
#: Groups of identity terms that are exchanged for one another (fixed values; a parameter).
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class ToxicityConfig:
    """sample: labelled documents that the model is fitted on at most, those with the smallest hashes of doc_id. evidence: words and
    beginnings that are features at most, those whose odds are surest. neutral: words of the sample that are taken for identity terms at
    most; they stand in at most neutral_share of the texts and neutral_odds limits how unevenly the classes hold them. partners: words
    that each of them is exchanged for at most, of at least the similarity `alike` of neighbours, which are counted in `contexts` classes."""

    sample: int = 20_000
    least_documents: int = 5
    least_odds: float = 4.0
    evidence: int = 4_000
    beginnings: tuple[int, ...] = (4, 5, 6, 7)
    steps: int = 800
    ridge: float = 1e-5
    counterfactual: float = 1.0
    neutral: int = 64
    neutral_share: float = 0.25
    neutral_odds: float = 1.5
    partners: int = 3
    alike: float = 0.3
    contexts: int = 512
    identity_groups: tuple[tuple[str, ...], ...] = field(default=IDENTITY_GROUPS)


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def traits(word: str, cfg: ToxicityConfig) -> list[str]:
    """The word itself, and its beginnings marked by a star."""
    return [word] + [word[:n] + "*" for n in cfg.beginnings if len(word) >= n]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        yield batch, batch.column("text").to_pylist()


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, size: int, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, y): at most size labelled documents, of most_bytes together, whose crc32 of doc_id leaves another remainder than held_out."""
    long_texts(documents.sparkSession)
    id_ = F.col("doc_id").cast("long")
    chosen = labels.select(id_.alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").distinct()
    chosen = chosen.where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(size)
    texts = documents.select(id_.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = ["doc_id", "y", "key"]
    found = cut(texts.join(F.broadcast(chosen), "doc_id").withColumn("key", F.xxhash64("text")).dropDuplicates(own))
    # an id may have several texts: the bounds hold for rows
    first = found.select(*own, F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), *own).limit(size)
    if most_bytes is not None:
        rows, held = [], 0
        for r in first.collect():
            held += r["n"]
            if held <= most_bytes:
                rows.append((r["doc_id"], r["y"], r["key"]))
        first = documents.sparkSession.createDataFrame(rows, "doc_id long, y int, key long")
    return found.join(F.broadcast(first.select(*own)), own, "left_semi").select("doc_id", "text", "y")


def _count(cfg: ToxicityConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: dict[str, int] = {}
        good: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            names = list(bad.keys() | good.keys())
            batch = pa.RecordBatch.from_pydict({"trait": pa.array(names, pa.string()), "bad": pa.array([bad.get(t, 0) for t in names], pa.int64()), "good": pa.array([good.get(t, 0) for t in names], pa.int64())})
            bad.clear()
            good.clear()
            return batch

        n = {0: 0, 1: 0}
        for batch, texts in _texts(batches):
            for text, y in zip(texts, batch.column("y").to_pylist()):
                into = bad if y else good
                n[1 if y else 0] += 1
                for t in {t for w in words(text) for t in traits(w, cfg)}:
                    into[t] = into.get(t, 0) + 1
            if len(bad) + len(good) > 2 * CACHED:
                yield told()
        yield told()
        yield pa.RecordBatch.from_pydict({"trait": [""], "bad": pa.array([n[1]], pa.int64()), "good": pa.array([n[0]], pa.int64())})

    return run


@dataclass(frozen=True)
class ToxicityModel:
    """exchanges: what each identity term was exchanged for; pairs: sentences of the sample that were compared with an exchanged one."""

    weights: dict[str, float]
    bias: float
    cfg: ToxicityConfig
    exchanges: dict[str, list[str]] = field(default_factory=dict)
    pairs: int = 0

    def score(self, found: set[str]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[t] for t in found), -40, 40))))


def _odds(bad: int, good: int):
    return ((F.col("bad") + 0.5) / (bad - F.col("bad") + 0.5)) / ((F.col("good") + 0.5) / (good - F.col("good") + 0.5))


def _evidence(total: DataFrame, bad: int, good: int, cfg: ToxicityConfig) -> list[str]:
    odds = _odds(bad, good)
    clear = total.where((F.col("bad") + F.col("good") >= cfg.least_documents) & (odds >= cfg.least_odds))
    sure = F.log(odds) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    return [r["trait"] for r in clear.orderBy(sure.desc(), "trait").limit(cfg.evidence).select("trait").collect()]


def _neutral(total: DataFrame, bad: int, good: int, cfg: ToxicityConfig) -> list[str]:
    """The words that most texts hold among those that both classes hold alike."""
    n = F.col("bad") + F.col("good")
    alike = F.abs(F.log(_odds(bad, good))) <= float(np.log(cfg.neutral_odds))
    both = (F.col("bad") >= cfg.least_documents) & (F.col("good") >= cfg.least_documents) & (n <= cfg.neutral_share * (bad + good))
    words_only = (F.length("trait") >= 3) & ~F.endswith("trait", F.lit("*"))
    return [r["trait"] for r in total.where(words_only & both & alike).orderBy(n.desc(), "trait").limit(cfg.neutral).select("trait").collect()]


def _contexts(terms: list[str], cfg: ToxicityConfig):
    """Counts of what stands before and after each term, in classes."""
    at = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(terms), 2 * cfg.contexts), np.int64)
        for _, texts in _texts(batches):
            for text in texts:
                said = WORD.findall(text.lower())
                for i, w in enumerate(said):
                    if (k := at.get(w)) is not None:
                        if i:
                            seen[k, crc32(said[i - 1].encode()) % cfg.contexts] += 1
                        if i + 1 < len(said):
                            seen[k, cfg.contexts + crc32(said[i + 1].encode()) % cfg.contexts] += 1
        term, context = np.nonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": term, "context": context, "n": seen[term, context]})

    return run


def _partners(sample: DataFrame, terms: list[str], cfg: ToxicityConfig) -> dict[str, list[str]]:
    """Each term with those that stand between the most similar neighbours."""
    if len(terms) < 2:
        return {}
    counts = sample.select("text").withColumn("y", F.lit(0)).select("y", "text").mapInArrow(_contexts(terms, cfg), "term long, context long, n long")
    found = counts.groupBy("term", "context").agg(F.sum("n").alias("n")).toArrow()  # terms x contexts at most
    seen = np.zeros((len(terms), 2 * cfg.contexts))
    seen[found["term"].to_numpy(), found["context"].to_numpy()] = np.sqrt(found["n"].to_numpy())
    seen /= np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-12)
    near = np.round(seen @ seen.T, 9)
    np.fill_diagonal(near, -1)
    best = np.argsort(-near, axis=1, kind="stable")[:, : cfg.partners]
    return {t: [terms[j] for j in best[i] if near[i, j] >= cfg.alike] for i, t in enumerate(terms)}


def exchanges_of(sample: DataFrame, total: DataFrame, bad: int, good: int, cfg: ToxicityConfig) -> dict[str, list[str]]:
    """What each identity term is exchanged for: the others of its group, or its partners among the sample's neutral words."""
    named = sorted({t for g in cfg.identity_groups for t in g})
    seen = {r["trait"] for r in total.where(F.col("trait").isin(named)).select("trait").collect()}
    found: dict[str, list[str]] = {}
    for g in cfg.identity_groups:
        if seen & set(g):
            for t in g:
                found.setdefault(t, []).extend(x for x in g if x != t)
    own = [t for t in _neutral(total, bad, good, cfg) if t not in found]
    found.update({t: p for t, p in _partners(sample, own, cfg).items() if p})
    return found


def _differences(features: list[str], exchanges: dict[str, list[str]], cfg: ToxicityConfig):
    """For each text its label and features; and for all sentences with an exchanged term how their features change, each change with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: i for i, t in enumerate(features)}
        memory: dict[str, frozenset[int]] = {}

        def own(word: str) -> frozenset[int]:
            if word not in memory:
                if len(memory) > CACHED:
                    memory.clear()
                memory[word] = frozenset(at[t] for t in traits(word, cfg) if t in at)
            return memory[word]

        kind = pa.list_(pa.int32())

        def told(ys: list[int], ones: list, twos: list, counts: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ones, kind), pa.array(twos, kind), pa.array(counts, pa.int64())], ["y", "one", "two", "n"])

        changes: dict[tuple, int] = {}
        for batch, texts in _texts(batches):
            ones = []
            for text in texts:
                ones.append(sorted(frozenset().union(*map(own, words(text)))))
                for sentence in SENTENCE.split(text):
                    said = words(sentence)
                    for term in said & exchanges.keys():
                        rest = frozenset().union(*(own(w) for w in said if w != term))
                        for other in exchanges[term]:
                            gone, come = own(term) - own(other) - rest, own(other) - own(term) - rest
                            change = (tuple(sorted(gone)), tuple(sorted(come)))
                            changes[change] = changes.get(change, 0) + 1
            yield told([int(bool(y)) for y in batch.column("y").to_pylist()], ones, [None] * len(ones), [1] * len(ones))
        yield told([-1] * len(changes), [list(a) for a, _ in changes], [list(b) for _, b in changes], list(changes.values()))

    return run


class _Sparse:
    def __init__(self, lists: list[list[int]], width: int) -> None:
        self.n, self.width = len(lists), width
        self.col = np.fromiter((i for x in lists for i in x), np.int64)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists]) if lists else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def loss(y: np.ndarray, x: list[list[int]], pairs: list[tuple[list[int], list[int], int]], width: int, cfg: ToxicityConfig):
    """A function of (weights, bias) that gives log loss + ridge + the mean squared change of score over all exchanges, and its gradient.

    pairs: features that leave, features that come, and how many exchanges change a sentence so."""
    docs, gone, come = _Sparse(x, width), _Sparse([a for a, _, _ in pairs], width), _Sparse([b for _, b, _ in pairs], width)
    share = np.array([n for _, _, n in pairs], np.float64)
    share /= max(1.0, share.sum())

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(docs.times(w[:-1]) + w[-1], -40, 40)
        g = np.append(docs.back((1 / (1 + np.exp(-z)) - y) / len(y)) + 2 * cfg.ridge * w[:-1], (1 / (1 + np.exp(-z)) - y).mean())
        value = float((np.logaddexp(0, z) - y * z).mean() + cfg.ridge * (w[:-1] ** 2).sum())
        if pairs:
            change = come.times(w[:-1]) - gone.times(w[:-1])
            g[:-1] += 2 * cfg.counterfactual * (come.back(share * change) - gone.back(share * change))
            value += float(cfg.counterfactual * (share * change**2).sum())
        return value, g

    return at


def train(y: np.ndarray, x: list[list[int]], pairs: list[tuple[list[int], list[int], int]], width: int, cfg: ToxicityConfig) -> tuple[np.ndarray, float]:
    """Minimises loss() by gradient steps."""
    at = loss(y, x, pairs, width, cfg)
    w = np.zeros(width + 1)
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, cfg.steps + 1):
        _, g = at(w)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def _changes(sample: DataFrame, features: list[str], exchanges: dict[str, list[str]], cfg: ToxicityConfig) -> tuple[DataFrame, list[tuple]]:
    """(rows of _differences, its changes with their counts over the whole sample). Changes differ by term, partner and beginnings only, so
    that their number doesn't grow with the sample."""
    rows = sample.select("y", "text").mapInArrow(trimmed_batches(_differences(features, exchanges, cfg)), "y int, one array<int>, two array<int>, n long")
    found = rows.where("y < 0").groupBy("one", "two").agg(F.sum("n").alias("n")).toArrow()
    return rows, sorted(zip(found["one"].to_pylist(), found["two"].to_pylist(), found["n"].to_pylist()))


def fit(sample: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """sample: (doc_id, text, y), bounded by cfg.sample."""
    counts = cut(sample.select("y", "text").mapInArrow(trimmed_batches(_count(cfg)), "trait string, bad long, good long"))
    sums = counts.where("trait = ''").agg(F.sum("bad"), F.sum("good")).first()
    bad, good = int(sums[0] or 0), int(sums[1] or 0)
    base = float(np.log((bad + 0.5) / (good + 0.5)))
    if not bad or not good:
        return ToxicityModel({}, base, cfg)
    total = cut(counts.where("trait <> ''").groupBy("trait").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    evidence = _evidence(total, bad, good, cfg)
    exchanges = exchanges_of(sample, total, bad, good, cfg)
    features = [*evidence, *sorted((exchanges.keys() | {o for x in exchanges.values() for o in x}) - set(evidence))]
    if not evidence:
        return ToxicityModel({}, base, cfg, exchanges)
    rows, pairs = _changes(sample, features, exchanges, cfg)
    labelled = rows.where("y >= 0").select("y", "one").toArrow()
    weights, bias = train(labelled["y"].to_numpy().astype(float), labelled["one"].to_pylist(), pairs, len(features), cfg)
    return ToxicityModel({t: float(w) for t, w in zip(features, weights) if abs(w) > 1e-6}, bias, cfg, exchanges, sum(n for _, _, n in pairs))


def score_gap(sample: DataFrame, model: ToxicityModel) -> float:
    """The mean change of the log odds, either way, when identity terms of a sample (doc_id, text, y) are exchanged as in training."""
    features = sorted(model.weights)
    _, pairs = _changes(sample, features, model.exchanges, model.cfg)
    weight = lambda listed: sum(model.weights[features[i]] for i in listed)
    return sum(n * abs(weight(b) - weight(a)) for a, b, n in pairs) / max(1, sum(n for _, _, n in pairs))


def _judge(model: ToxicityModel):
    """Scores of texts laid end to end; the evidence of words met before is remembered."""
    memory: dict[str, tuple[str, ...]] = {}

    def run(data: np.ndarray, offsets: np.ndarray) -> list[float]:
        scores = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found: set[str] = set()
            for w in words(data[a:b].tobytes().decode("utf-8")):
                own = memory.get(w)
                if own is None:
                    if len(memory) > CACHED:
                        memory.clear()
                    own = memory[w] = tuple(t for t in traits(w, model.cfg) if t in model.weights)
                if own:
                    found.update(own)
            scores.append(model.score(found))
        return scores

    return run


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(model)
        for keys, data, offsets in text_batches(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(judge(data, offsets), pa.float64())], ["doc_id", "score"])

    return run


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    found = as_bytes(documents).mapInArrow(_score(model), "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """documents without those the model rejects, with its columns. Rows are judged by their own text."""
    columns = documents.columns
    long_texts(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(model)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), texts], ["doc_id", "t"])
            keep = [s < 0.5 for _, data, offsets in text_batches(iter([rows])) for s in judge(data, offsets)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema).select(*columns)
