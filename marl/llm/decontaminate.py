"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the
token windows of every document, hits verified on the window's words. DataFrame expressions only.

Hashes of windows come from those of words by doubling: windows of 2, 4 and 8 words from two halves each, and a window
of any length from the largest of these that fit. Each window of a document meets the benchmark's windows by a broadcast
join on its hash. The broadcast is bounded in bytes: a larger benchmark is dealt to rounds by the hashes of its windows,
each of which is one more pass over the documents; one round is the same plan.

Defined results: null or wordless text has n_words 0 and no hit; a wordless benchmark item has no window; null item_id is
left out of the items but its windows hit; repeated rows stay rows; an empty documents table gives no rows, an empty
benchmark no hits; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import cut, leave_out

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of benchmark windows (their words, their items, and what a hash table takes besides) that are broadcast at once.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 120


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _joined(left: Column, right: Column, width: int) -> Column:
    """Hashes of neighbouring stretches as one: left[i] with right[i + width]; what has no right neighbour is left out."""
    count = F.size(right) - width
    return F.when(count > 0, F.zip_with(F.slice(left, 1, count), F.slice(right, width + 1, count), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<long>"))


def window_hashes(words: Column, size: int) -> Column:
    """A hash for each window of `size` words, empty if there are fewer words."""

    def grown(power: Column, width: int, have: Column | None, length: int) -> Column:
        # power: hashes of windows of `width` words; have: of `length` words, put together from smaller powers
        now, total = have, length
        if size & width:
            now, total = (power, width) if have is None else (_joined(power, have, width), length + width)
        if total == size:
            return now
        double = _joined(power, power, width)
        if now is None:
            return let(double, lambda p: grown(p, 2 * width, None, 0))
        return let(now, lambda h: let(double, lambda p: grown(p, 2 * width, h, total)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda p: grown(p, 1, None, 0))


def _placed(hashes: Column, size: int) -> Column:
    """array<struct<at, size, hash>> with 1-based places."""
    return F.transform(hashes, lambda h, i: F.struct((i + 1).alias("at"), F.lit(size).alias("size"), h.alias("hash")))


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(hash, size, words, items): each distinct window of n words, or a whole shorter item, with its items."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    wins = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    found = wins.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("size", F.size("words"))
    hashed = reduce(lambda rest, k: F.when(F.col("size") == k, F.get(window_hashes(F.col("words"), k), F.lit(0))).otherwise(rest), range(1, n + 1), F.lit(None).cast("long"))
    return found.select(hashed.alias("hash"), "size", "words", "items")


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, spans, items, contaminated) for every document; spans are 1-based word ranges [from, to)."""
    windows = cut(benchmark_windows(benchmark, n))
    item_bytes = F.coalesce(F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16), F.lit(0))
    spark = documents.sparkSession
    told = windows.groupBy("size").agg(F.sum(F.octet_length(F.array_join("words", " ")) + item_bytes + ROW_BYTES).alias("bytes")).collect()  # n rows at most
    rounds = max(1, -(-sum(r["bytes"] for r in told) // broadcast_bytes))
    sizes = sorted(r["size"] for r in told)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.spark_partition_id() if rounds == 1 else F.lit(0)  # several rounds need not see the same partitions
    source = documents.select("doc_id", F.xxhash64(text).alias("text_key"), part.alias("part"), words_of(text).alias("w"))
    one = "struct<at:int,size:int,hash:long>"
    found = [_placed(window_hashes(F.col("w"), k), k) for k in sizes]
    itself = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("hash"))  # stands for the document, hit or not
    # the arrays are made in a projection of their own: exploding a mere column is compiled, and does not copy the words for each window;
    # outer, though never empty, as else a filter on the size of the array is put first and makes it once more
    scanned = source.withColumn("windows", F.concat(F.array(itself), F.array().cast(f"array<{one}>"), *found))
    parts = []
    for r in range(rounds):
        rows = scanned.select("doc_id", "text_key", "part", "w", F.explode_outer("windows").alias("s")).select("doc_id", "text_key", "part", "w", "s.at", F.col("s.size").alias("n"), "s.hash")
        known = windows if rounds == 1 else windows.where(F.pmod("hash", F.lit(rounds)) == r)
        if r == 0:
            known = known.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("hash"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("items")))
        met = rows.join(F.broadcast(known), "hash").where("size = n and (at = 0 or words = slice(w, greatest(at, 1), n))")
        parts.append(met.select("doc_id", "text_key", "part", F.size("w").cast("long").alias("n_words"), "at", "n", "items"))
    span = F.when(F.col("at") > 0, F.struct(F.col("at").alias("from"), (F.col("at") + F.col("n")).alias("to")))
    # a document's windows are of one partition: in one round a hot document is as many groups as there are partitions that hold it
    grouped = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_key", "part", "n_words").agg(
        F.count_if(F.col("at") == 0).alias("copies"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["to"] - F.greatest(s["from"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["to"]).alias("to")),
        lambda acc: acc["n"],
    )
    counted = grouped.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies", "part")


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """documents without the contaminated ones, with its columns."""
    bad = contamination(documents.select("doc_id", "text"), benchmark, n, share).where("contaminated").select("doc_id", "text_key")
    return leave_out(documents, bad, {"doc_id": F.col("doc_id"), "text_key": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
