"""Running totals and ranks within groups that are larger than a task.

Rows are dealt to tasks by ranges of (keys, order), whatever the groups' sizes: a hot group gets as many tasks as it needs. Each part of a
group sums up its own rows; what the parts before it come to is added to them. The table of parts has a row for each group in each
task, and nothing of a row but its keys and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, enough_tasks, unused


def running_totals(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], each: int = 100_000, most: dict[str, int] | None = None) -> DataFrame:
    """rows with a column for each sum: its total over the rows of the same keys up to and with this one, by order, which must tell them
    apart. Keys may be null. each: rows of a task, about. most: rows whose own part alone comes to more than that are left out early
    (values must not be negative then)."""
    part, names = unused(rows, "part"), list(sums)
    rows = cut(rows)
    tasks = enough_tasks(rows.sparkSession, rows.count(), each)
    dealt = cut(rows.repartitionByRange(tasks, *keys, *order).withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *(F.sum(v).over(inside).alias(n) for n, v in sums.items()))
    for n, limit in (most or {}).items():
        local = local.where(F.col(n) <= limit)
    parts = dealt.groupBy(*keys, part).agg(*(F.sum(v).alias(n) for n, v in sums.items()))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names_of = lambda c: unused(rows, f"{part}_{c}")
    came = parts.select(*(F.col(c).alias(names_of(c)) for c in (*keys, part)), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(names_of(n)) for n in names))
    same = F.lit(True)
    for c in (*keys, part):
        same = same & F.col(c).eqNullSafe(F.col(names_of(c)))
    return local.join(came, same).select(*rows.columns, *((F.col(n) + F.col(names_of(n))).alias(n) for n in names))


def running_ranks(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank", each: int = 100_000) -> DataFrame:
    """rows with their place in their group, from 1."""
    return running_totals(rows, keys, order, {name: F.lit(1).cast("long")}, each)
