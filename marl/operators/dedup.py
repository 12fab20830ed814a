"""First-copy deduplication by fingerprints. The survivor is the copy with the smallest key; every task puts forward its
own first one before anything is exchanged, so that no group of copies meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..shared import unused


def fingerprint_groups(rows: DataFrame, fingerprint: Column, key: str, *order: str) -> DataFrame:
    """(fingerprint, first, copies): the key that comes first, by order if columns are named."""
    first = F.min_by(key, F.struct(*order)) if order else F.min(key)
    return rows.select(fingerprint.alias("fingerprint"), key, *order).groupBy("fingerprint").agg(first.alias("first"), F.count("*").alias("copies"))


def first_copies(rows: DataFrame, fingerprint: Column, *keys: str) -> DataFrame:
    """One row for each fingerprint: that with the smallest keys; of rows with equal keys that with the smallest hash, of repeated rows one.

    Rows without a fingerprint are copies of one another. Columns of any name stay as they are."""
    own, place = unused(rows, "fingerprint"), unused(rows, "place")
    order = Window.partitionBy(own).orderBy(*(F.col(f"`{k}`") for k in keys), F.xxhash64(*(f"`{c}`" for c in rows.columns)))
    return rows.withColumn(own, fingerprint).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(own, place)


def not_seen(rows: DataFrame, fingerprint: Column, known: DataFrame) -> DataFrame:
    """rows whose fingerprint is not in the table known (fingerprint) of earlier batches. A row without one has not been seen."""
    own = unused(rows, "fingerprint")
    return rows.withColumn(own, fingerprint).join(known.select(F.col("fingerprint").alias(own)), own, "left_anti").drop(own)


def document_prefix(chars: int, column: str = "text") -> Column:
    return text.sha256_text(F.coalesce(F.col(column), F.lit("")), chars)


def chunk_hash(column: str = "chunk_text") -> Column:
    return text.md5_text(text.strip(column))
