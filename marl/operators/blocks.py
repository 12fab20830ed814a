"""Exact top-k over blocks of passages whose best possible score is known: blocks that can't hold a hit are never read.

Every (question, block) pair comes with a bound that no score within it exceeds. The blocks of the highest bounds are scored first; the
k-th best score that they give a question is a floor, and of all other blocks only those whose bound reaches the floor are scored,
too. What is skipped changes nothing in the result: the hits are those of a search of all blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .best import ranked


@dataclass
class Pruned:
    """hits: (question_id, passage_id, score, rank); bounds: (question_id, block, bound, scored) of every pair of a question and a block that
    could hold a hit; scored tells those that were read."""

    hits: DataFrame
    bounds: DataFrame

    def skipped(self) -> tuple[int, int]:
        """(pairs that were not read, all pairs)."""
        row = self.bounds.agg(F.count_if(~F.col("scored")).alias("skipped"), F.count("*").alias("n")).first()
        return row["skipped"], row["n"]


def pruned_search(bounds: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, first: int, slack: float) -> Pruned:
    """bounds: (question_id, block, bound). score: pairs (question_id, block) -> (question_id, passage_id, score); pairs of
    later blocks have a column floor, too, null or a score below which a hit is none. first: blocks of a question
    that are scored to find its floor. slack: how far below the floor a bound may be, for scores that are rounded."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("bound"), "block"))
    bounds = cut(bounds.select("question_id", "block", "bound"))
    opening = cut(bounds.withColumn("place", place).where(F.col("place") <= first).select("question_id", "block"))
    found = cut(ranked(score(opening), k))
    floor = found.where(F.col("rank") == k).select("question_id", F.col("score").alias("floor"))
    rest = bounds.join(opening, ["question_id", "block"], "left_anti").join(floor, "question_id", "left")
    rest = cut(rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - slack)).select("question_id", "block", "floor"))
    hits = ranked(found.drop("rank").unionByName(score(rest)), k)
    read = opening.unionByName(rest.drop("floor")).withColumn("scored", F.lit(True))
    return Pruned(hits, bounds.join(read, ["question_id", "block"], "left").withColumn("scored", F.coalesce("scored", F.lit(False))))
