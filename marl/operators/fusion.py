"""Fusion of two hit lists, reranking, context packing and citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..shared import unused
from .running import running_totals


@dataclass(frozen=True)
class HybridConfig:
    lexical_weight: float = 0.35
    over_fetch: int = 3
    k: int = 20


def min_max(hits: DataFrame) -> DataFrame:
    """Scores of each question's list stretched to 0..1; a list of equal scores becomes all 0."""
    own = Window.partitionBy("question_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return hits.withColumn("score", (F.col("score") - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))


def fuse(lexical: DataFrame, dense: DataFrame, cfg: HybridConfig = HybridConfig(), digits: int = 6) -> DataFrame:
    """(question_id, passage_id, score, rank) of two lists (question_id, passage_id, score, rank); a missing side counts 0.

    Both lists travel to one aggregation; ties go by the rank in the lexical list, then in the dense one.
    """
    sides = [
        min_max(lexical).select("question_id", "passage_id", (F.col("score") * cfg.lexical_weight).alias("part"), F.col("rank").alias("l_rank"), F.lit(None).cast("int").alias("d_rank")),
        min_max(dense).select("question_id", "passage_id", (F.col("score") * (1 - cfg.lexical_weight)).alias("part"), F.lit(None).cast("int").alias("l_rank"), F.col("rank").alias("d_rank")),
    ]
    merged = sides[0].unionByName(sides[1]).groupBy("question_id", "passage_id").agg(F.round(F.sum("part"), digits).alias("score"), F.min("l_rank").alias("l_rank"), F.min("d_rank").alias("d_rank"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.col("l_rank").asc_nulls_last(), F.col("d_rank").asc_nulls_last(), "passage_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k).select("question_id", "passage_id", "score", "rank")


def rerank(hits: DataFrame, scorer: Column, k: int = 4, digits: int = 6) -> DataFrame:
    """The k best hits by a scorer, which replaces the score; ties keep their order."""
    place = unused(hits, "place")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank", "passage_id")
    return hits.withColumn("score", F.round(scorer, digits)).withColumn(place, F.row_number().over(order)).where(F.col(place) <= k).drop("rank").withColumnRenamed(place, "rank")


def packed_hits(hits: DataFrame, question: str, order: list[str], column: str, budget: int = 12_000) -> DataFrame:
    """Hits that go into the prompt: not blank, first of their text, and within the budget up to the first that isn't. For groups that fit a
    task, as the hits of a question do; packed_groups takes groups of any size."""
    digest, copy, total = unused(hits, "digest"), unused(hits, "copy"), unused(hits, "total")
    own = hits.where(F.coalesce(text.strip(column), F.lit("")) != "").withColumn(digest, text.md5_text(column))
    own = own.withColumn(copy, F.row_number().over(Window.partitionBy(question, digest).orderBy(*order))).where(F.col(copy) == 1)
    so_far = F.sum(F.length(column)).over(Window.partitionBy(question).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn(total, so_far).where(F.col(total) <= budget).drop(digest, copy, total)


def packed_groups(hits: DataFrame, question: str, order: list[str], column: str, budget: int = 12_000, each: int = 100_000) -> DataFrame:
    """packed_hits for groups of any size: a group is dealt to tasks by ranges of its order, each task sums its own part, and the parts' sums
    are added up beside them. order must tell all rows of a group apart."""
    digest, total = unused(hits, "digest"), unused(hits, "total")
    own = hits.where(F.coalesce(text.strip(column), F.lit("")) != "")
    first = F.min(F.struct(*order))
    # which copy is the first is settled before texts are moved: a copy's row is short
    copies = own.select(F.col(question).alias(question), text.md5_text(column).alias(digest), *(c for c in order if c != question)).groupBy(question, digest).agg(first.alias("first"))
    names = [unused(hits, f"first{i}") for i in range(len(order))]
    kept = copies.select(F.col(question).alias(digest), *(F.col(f"first.{c}").alias(n) for n, c in zip(names, order)))
    same = F.col(question).eqNullSafe(F.col(digest))
    for n, c in zip(names, order):
        same = same & F.col(c).eqNullSafe(F.col(n))
    lone = own.join(kept, same, "left_semi")
    found = running_totals(lone, [question], order, {total: F.length(column)}, each, {total: budget})
    return found.where(F.col(total) <= budget).drop(total)


def contexts(packed: DataFrame, question: str, order: list[str], column: str) -> DataFrame:
    """One context for each question, its texts in order between rules."""
    body = unused(packed, "text")
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias(body))))
    return packed.groupBy(question).agg(F.transform(listed, lambda x: x[body]).alias("texts")).select(question, F.size("texts").alias("n_texts"), F.array_join("texts", "\n\n---\n\n").alias("context"))


def numbered_blocks(hits: DataFrame, question: str, rank: str, url: str, title: str, column: str, most: int = 5, budget: int = 12_000) -> DataFrame:
    """(question, rank, block): the first hits as numbered blocks with source and title, within the budget."""
    cleaned = text.squeeze_chat(column)
    source, named, content = lexicon.BLOCK_LABELS
    block = F.concat(F.lit("\n["), F.col(rank).cast("string"), F.lit(f"]\n{source}\n"), F.coalesce(F.col(url), F.lit("")), F.lit(f"\n{named}\n"), F.coalesce(F.col(title), F.lit("")), F.lit(f"\n{content}\n"), cleaned, F.lit("\n"))
    rows = hits.where((F.col(rank) <= most) & (cleaned != "")).select(question, F.col(rank).alias("rank"), block.alias("block"))
    total = F.sum(F.length("block")).over(Window.partitionBy(question).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", total).where(F.col("total") <= budget).drop("total")


def citations(hits: DataFrame, question: str, order: list[str], url: str) -> DataFrame:
    """The first hit of each URL of a question, with all its columns."""
    place = unused(hits, "place")
    first = Window.partitionBy(question, url).orderBy(*order)
    return hits.where(F.coalesce(F.col(url), F.lit("")) != "").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)


def sources(hits: DataFrame, question: str = "question_id", fields: tuple[str, ...] = ("rank", "title", "url")) -> DataFrame:
    """sources array<struct<fields, score>> of each question, every hit in the order of the fields, scores to four places,
    halves of the product by 10,000 to even (SQL's round_even)."""
    entry = F.struct(*fields, (F.rint(F.col("score") * 10_000) / 10_000).alias("score"))
    return hits.groupBy(question).agg(F.array_sort(F.collect_list(entry)).alias("sources"))
