"""The best hits of each question, kept by every task and merged at the end: no table of all pairs is exchanged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hits that wait in a task, besides those picked before, until the best are picked.
WAITING = 1 << 18


class Best:
    """The k best hits of numbered questions that one task has met, by score, ties by id."""

    def __init__(self, k: int, questions: int) -> None:
        self.k, self.floor = k, np.full(questions, -np.inf)
        self.parts: list[pa.Table] = []
        self.waiting = self.picked = 0

    def add(self, question: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        good = np.flatnonzero(score >= self.floor[question])
        if len(good):
            self.parts.append(pa.table({"question": question[good], "score": score[good], "id": ids.take(pa.array(good))}))
            self.waiting += len(good)
        if self.waiting > WAITING + self.picked:
            self.pick()

    def pick(self) -> pa.Table | None:
        if not self.parts:
            return None
        found = pa.concat_tables(self.parts)
        found = found.take(pc.sort_indices(found, [("question", "ascending"), ("score", "descending"), ("id", "ascending")]))
        question = found["question"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], question[1:] != question[:-1]]))
        rank = np.arange(len(question)) - np.repeat(first, np.diff(np.append(first, len(question))))
        found, question, rank = found.filter(pa.array(rank < self.k)), question[rank < self.k], rank[rank < self.k]
        last = rank == self.k - 1
        self.floor[question[last]] = found["score"].to_numpy()[last]
        self.parts, self.waiting, self.picked = [found.combine_chunks()], 0, len(found)
        return found


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """hits (question_id, passage_id, score) of all tasks: the k best of each question with their rank, ties by passage_id."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "passage_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
