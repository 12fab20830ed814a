"""An inverted index of passages with block maxima, and pruned BM25 search over it.

Passages are dealt to blocks of some `block_rows` by the hash of their ids. A row of the index is a term of a block: what the term is
worth in each of the block's passages before it is weighted (its impact), and the largest of that. Passages travel once, to their block,
and each block is turned round by itself. The columns of maxima alone tell how much a block can score for a question, so that most lists of
passages are never read; of what is read, only terms that a question has are dealt by block, and each block keeps its best hits alone.

As in lexical: a passage or question without an id, or without a corpus where corpora are named, takes no part; null and empty texts
have no terms; corpora have statistics of their own. Every list that idf multiplies must not be negative for bounds to hold: where the
floor makes an idf negative (in corpora of a few passages), the block of such a term counts with its smallest impact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import text
from ..shared import SMALL_ROWS, cut, enough_tasks, fresh_path, look_up, pieces
from . import lexical
from .blocks import Pruned, pruned_search
from .lexical import PAIRS, Bm25Config

#: Blocks of a question that are scored to find its floor.
FIRST = 4


@dataclass
class InvertedIndex:
    """postings: (corpus_id, term, block, posts array<struct<passage_id, impact>>, top, low); terms: (corpus_id, term, df, idf, mean_size)."""

    postings: DataFrame
    terms: DataFrame


def _turned(cfg: Bm25Config, key: pa.DataType, corpus: pa.DataType):
    names = ["corpus_id", "term", "block", "posts", "top", "low"]
    post = pa.struct([("passage_id", key), ("impact", pa.float64())])
    kinds = [corpus, pa.string(), pa.int64(), pa.list_(post), pa.float64(), pa.float64()]

    def run(passages: pa.Table) -> pa.Table:
        """The rows of a block of passages of one corpus, a row for each term."""
        lists = passages["terms"].combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        tf = passages["counts"].combine_chunks().flatten().to_numpy().astype(np.float64)
        share = passages["size"].to_numpy() / passages["mean_size"].to_numpy()
        impact = tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * share[row]))
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        impact = impact[order]
        posts = pa.StructArray.from_arrays([passages["passage_id"].combine_chunks().take(pa.array(row[order])), pa.array(impact)], fields=list(post))
        many = len(coded.dictionary)
        columns = [
            pa.repeat(passages["corpus_id"][0], many), coded.dictionary, pa.repeat(passages["block"][0], many),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), posts), np.maximum.reduceat(impact, first[:-1]), np.minimum.reduceat(impact, first[:-1]),
        ]
        return pa.Table.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c.cast(k) for c, k in zip(columns, kinds)], names)

    return run


def build(rows: DataFrame, cfg: Bm25Config = Bm25Config(), path: str | None = None, block_rows: int = 128) -> InvertedIndex:
    """The index of lexical.passages(), written to path, or to the shared folder, and read back."""
    spark = rows.sparkSession
    path = fresh_path(spark, "postings") if path is None else path
    forward = lexical.index(rows)
    lexical.inverse_frequencies(forward, cfg).write.parquet(f"{path}/terms")
    count = forward.count()
    blocks = max(1, -(-count // block_rows))
    mean = forward.groupBy("corpus_id").agg(F.avg("size").alias("mean_size"), F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("passage_id"), F.lit(blocks)).alias("block")
    known = look_up(forward.where("size > 0"), mean, "corpus_id", "n", count).select("corpus_id", "passage_id", "size", "terms", "counts", "mean_size", block)
    own, key = (forward.schema[c].dataType for c in ("corpus_id", "passage_id"))
    schema = f"corpus_id {own.simpleString()}, term string, block long, posts array<struct<passage_id: {key.simpleString()}, impact: double>>, top double, low double"
    dealt = known.repartition(enough_tasks(spark, count, 50_000), "corpus_id", "block")
    dealt.groupBy("corpus_id", "block").applyInArrow(_turned(cfg, to_arrow_type(key), to_arrow_type(own)), schema).write.parquet(f"{path}/postings")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> InvertedIndex:
    return InvertedIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"))


def _scored(weights: pa.Table, k: int, digits: int, kinds: tuple):
    """Scores a block of passages for the questions that want it, k of each and ties."""
    columns = ["question_id", "passage_id", "score"]
    names, question = np.unique(weights["question_id"].to_numpy(), return_inverse=True)
    terms = weights["term"].combine_chunks().dictionary_encode()
    dictionary = terms.dictionary
    corpora, corpus = np.unique(weights["corpus_id"].to_numpy(), return_inverse=True)
    key = corpus * len(dictionary) + terms.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    first = np.append(first, len(order))
    question, weight = question[order], weights["weight"].to_numpy()[order]

    def run(_key: tuple, lists: pa.Table, pairs: pa.Table) -> pa.Table:
        made = [pa.Table.from_arrays([pa.array([], t) for t in kinds], columns)]
        if not lists.num_rows or not pairs.num_rows:
            return made[0]
        floor = np.full(len(names), np.inf)
        floor[np.searchsorted(names, pairs["question_id"].to_numpy())] = pc.fill_null(pairs["floor"], 0.0).to_numpy()
        own = np.searchsorted(corpora, lists["corpus_id"].to_numpy())
        at = np.searchsorted(keys, own * len(dictionary) + pc.index_in(lists["term"], value_set=dictionary).to_numpy())
        each = first[at + 1] - first[at]
        row = np.repeat(np.arange(len(each)), each)
        pair = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[at], each)
        wanted = np.flatnonzero(floor[question[pair]] < np.inf)
        wanted = wanted[np.argsort(question[pair[wanted]], kind="stable")]
        row, pair = row[wanted], pair[wanted]
        posts = lists["posts"].combine_chunks()
        size, begin = posts.value_lengths().to_numpy(), posts.offsets.to_numpy() - posts.offsets[0].as_py()
        post = posts.flatten()
        passage, impact = post.field("passage_id").dictionary_encode(), post.field("impact").to_numpy()
        ids, passage = passage.dictionary, passage.indices.to_numpy()
        asked, place = np.unique(question[pair], return_inverse=True)
        for start, stop in pieces(np.bincount(place, size[row], len(asked)).astype(np.int64), PAIRS):  # whole questions
            some = slice(*np.searchsorted(place, [start, stop]))
            many = size[row[some]]
            on = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[row[some]], many)
            met, of = np.unique(np.repeat(place[some], many) * len(ids) + passage[on], return_inverse=True)
            score = np.round(np.bincount(of, np.repeat(weight[pair[some]], many) * impact[on], len(met)), digits)
            q = asked[met // len(ids)]
            good = np.flatnonzero((score > 0) & (score >= floor[q]))
            good = good[np.lexsort((-score[good], q[good]))]
            _, begins, length = np.unique(q[good], return_index=True, return_counts=True)
            good = good[score[good] >= np.repeat(score[good[begins + np.minimum(k, length) - 1]], length)]  # ties of the k-th stay
            made.append(pa.Table.from_arrays([pa.array(names[q[good]], kinds[0]), ids.take(pa.array(met[good] % len(ids))).cast(kinds[1]), pa.array(score[good])], columns))
        return pa.concat_tables(made)

    return run


def search(questions: DataFrame, indexed: InvertedIndex, k: int, digits: int = 6, first: int = FIRST, block: int = Bm25Config.block) -> Pruned:
    """The k best passages with a positive score of each question (question_id, question[, corpus_id]), ties by passage_id: the rows of
    lexical.search, and which blocks were read for them. block: weighted terms of questions that a task, and the driver, hold at a time."""
    own = F.col("corpus_id") if "corpus_id" in questions.columns else F.lit(0).cast("long")
    asked = questions.where(F.col("question_id").isNotNull() & own.isNotNull()).select(own.alias("corpus_id"), "question_id", F.explode(text.tokens("question")).alias("term"))
    asked = asked.groupBy("corpus_id", "term", "question_id").agg(F.count("*").alias("times"))
    weights = cut(asked.join(indexed.terms, ["corpus_id", "term"]).select("corpus_id", "term", "question_id", (F.col("times") * F.col("idf")).alias("weight")))
    schema = StructType([questions.schema["question_id"], indexed.postings.schema["posts"].dataType.elementType["passage_id"]]).add("score", "double")
    kinds = (*(to_arrow_type(f.dataType) for f in schema.fields[:2]), pa.float64())
    parts, hits, bounds = max(1, -(-weights.count() // block)), None, None
    for i in range(parts):
        part = weights.where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == i)
        found = _search(part, indexed, k, digits, first, schema, kinds)
        hits, bounds = (found.hits, found.bounds) if hits is None else (hits.unionByName(found.hits), bounds.unionByName(found.bounds))
    return Pruned(hits, bounds)


def _search(weights: DataFrame, indexed: InvertedIndex, k: int, digits: int, first: int, schema: StructType, kinds: tuple) -> Pruned:
    """search() for so many weights that they fit a task."""
    best = F.col("weight") * F.when(F.col("weight") >= 0, F.col("top")).otherwise(F.col("low"))
    # a block without the term adds nothing, which a negative weight must not make worse than it is
    maxima = indexed.postings.select("corpus_id", "term", "block", "top", "low").join(F.broadcast(weights), ["corpus_id", "term"])
    bounds = maxima.groupBy("question_id", "block").agg(F.sum(F.greatest(best, F.lit(0.0))).alias("bound"))
    score_block = _scored(weights.toArrow(), k, digits, kinds)
    terms = weights.select("corpus_id", "term").distinct()

    def score(pairs: DataFrame) -> DataFrame:
        floor = F.col("floor") if "floor" in pairs.columns else F.lit(None).cast("double")
        wanted = pairs.select("question_id", F.col("block").alias("of"), floor.alias("floor"))
        blocks = cut(pairs.select(F.col("block").alias("block")).distinct())
        lists = indexed.postings.select("corpus_id", "term", "block", "posts").join(F.broadcast(terms), ["corpus_id", "term"], "left_semi")
        lists = lists.join(F.broadcast(blocks) if blocks.count() <= SMALL_ROWS else blocks, "block", "left_semi")
        return lists.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(score_block, schema)

    return pruned_search(bounds, score, k, first, 2 * 10.0**-digits)
