"""License scans: an exact set-similarity join of text blocks with license templates. DataFrame expressions only.

Blocks are stretches of `2 * stride` words that begin every `stride` words, so that a notice of up to `stride` words, wrapped over
lines or not, lies whole in one of them. A block matches a template if it holds at least the threshold's share of the template's
distinct words. Words are ordered by their frequency in all documents, rarest first; words outside all templates can't match, so
that one count of the templates' own words gives the order. A match needs `least` common words, of a template of `size` words: its
rarest common word is among the template's first size - least + 1 (prefix filter) and at least `least` words are left from it on,
on both sides (length and positional filters). Only blocks that hold a prefix word are made at all; they meet the templates by an
equality join on it, and what passes the filters is verified on the whole sets.

Beside the method, phrases are looked for word by word. Templates and phrases are parameters that do not grow with the documents;
what is broadcast is made of templates alone, MOST_TEMPLATE_WORDS words at most.

Defined results: null or wordless text has n_words 0, no label and score 0; rows of one text and id are judged alike and stay rows,
with or without an id; equal templates under two labels give both; templates without words match nothing; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .decontaminate import words_of

# Phrases of the contract, and notices of public licenses.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("cc0-1.0", "released under the cc0 1.0 universal public domain dedication"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
# End of fixed values.

#: Distinct words of all templates at most: what is broadcast follows from them.
MOST_TEMPLATE_WORDS = 100_000


@dataclass(frozen=True)
class LicenseConfig:
    """threshold: share of a template's distinct words that a block must hold; stride: words between the beginnings of blocks, which are twice as long."""

    threshold: float = 0.9
    stride: int = 32
    phrases: tuple[tuple[str, str], ...] = PHRASES
    templates: tuple[tuple[str, str], ...] = TEMPLATES

    def least(self, size: int) -> int:
        return math.ceil(self.threshold * size - 1e-9)


def word_sets(cfg: LicenseConfig) -> list[tuple[str, frozenset[str]]]:
    """(label, distinct words) of the templates that have words."""
    import re

    found = [(label, frozenset(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))) for label, text in cfg.templates]
    found = [(label, words) for label, words in found if words]
    if len(frozenset().union(*(w for _, w in found))) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} distinct words")
    return found


def global_order(documents: DataFrame, words: frozenset[str]) -> dict[str, int]:
    """Place of each word by the count of documents that hold it, rarest first, ties by the word. A row for each word comes to the driver."""
    if not words:
        return {}
    # outer, as else a filter on the size of the array is put first and makes it once more
    met = documents.select(F.explode_outer(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(sorted(words))))).alias("w"))
    seen = {r["w"]: r["n"] for r in met.groupBy("w").agg(F.count("*").alias("n")).where("w is not null").collect()}
    return {w: i for i, w in enumerate(sorted(words, key=lambda w: (seen.get(w, 0), w)))}


def _places(words: Column, wanted: list[str]) -> Column:
    """Ascending places, from 0, of words that are wanted."""
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.get(words, i).isin(wanted))


def _stands(words: Column, i: Column, phrase: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase)))


def matches(documents: DataFrame, cfg: LicenseConfig = LicenseConfig()) -> DataFrame:
    """(doc_id, text_key, first, last, label, containment): every text block, as words [first, last), that meets the threshold of a template."""
    sets = word_sets(cfg)
    order = global_order(documents, frozenset().union(*(w for _, w in sets)))
    rows = []
    for number, (label, words) in enumerate(sets):
        ranks, least = sorted(order[w] for w in words), cfg.least(len(words))
        rows += [(ranks[i], i, number, label, ranks, least) for i in range(len(ranks) - least + 1)]
    spark = documents.sparkSession
    index = F.broadcast(spark.createDataFrame(rows, "rank int, i int, template int, label string, ranks array<int>, least int"))  # of templates alone
    by_rank = sorted(order, key=order.get)
    prefix = sorted({by_rank[r[0]] for r in rows})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = F.lit(by_rank)
    stride, nothing = cfg.stride, F.array().cast("array<int>")

    def block(words: Column, first: Column) -> Column:
        own = F.transform(F.array_distinct(F.slice(words, first + 1, 2 * stride)), lambda x: F.array_position(known, x).cast("int") - 1)
        return F.struct(first.alias("first"), F.least(first + 2 * stride, F.size(words)).alias("last"), F.array_sort(F.filter(own, lambda r: r >= 0)).alias("own"))

    def blocks_of(words: Column) -> Column:
        at = F.flatten(F.transform(_places(words, prefix), lambda i: F.array(i - i % stride - stride, i - i % stride)))
        return F.transform(F.array_distinct(F.filter(F.coalesce(at, nothing), lambda first: first >= 0)), lambda first: block(words, first))

    # words are bound in one expression, as a column of them would be made again wherever it is named
    made = documents.select("doc_id", F.xxhash64(text).alias("text_key"), F.explode_outer(let(words_of(text), blocks_of)).alias("block"))
    blocks = made.where("block is not null").select("doc_id", "text_key", "block.*")
    probes = blocks.select("*", F.posexplode("own").alias("j", "rank"))
    met = probes.join(index, "rank").where(F.least(F.size("ranks") - F.col("i"), F.size("own") - F.col("j")) >= F.col("least"))
    common = F.size(F.array_intersect("own", "ranks"))
    found = met.withColumn("common", common).where("common >= least").select("doc_id", "text_key", "first", "last", "template", "label", (F.col("common") / F.size("ranks")).alias("containment"))
    return found.distinct().drop("template")


def scan(documents: DataFrame, cfg: LicenseConfig = LicenseConfig()) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document. Places are those of phrases; labels are
    sorted arrays; the score is 1 with a phrase, else the largest containment of a template in a block that meets the threshold, else 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    phrases = [(label, phrase.split()) for phrase, label in cfg.phrases]
    several = len({p[0] for _, p in phrases}) < len(phrases)

    def standing(words: Column, heads: Column, label: str, phrase: list[str]) -> Column:
        return F.transform(F.filter(heads, lambda i: _stands(words, i, phrase)), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    def placed(words: Column) -> Column:
        heads = _places(words, sorted({p[0] for _, p in phrases}))
        if several:  # phrases that begin alike can stand at one place
            return F.concat(*(standing(words, heads, *p) for p in phrases))
        which = lambda i: reduce(lambda rest, p: F.when(_stands(words, i, p[1]), F.lit(p[0])).otherwise(rest), reversed(phrases), F.lit(None).cast("string"))
        return F.filter(F.transform(heads, lambda i: F.struct(i.alias("at"), which(i).alias("label"))), lambda s: s["label"].isNotNull())

    whole = let(words_of(text), lambda words: F.struct(F.size(words).cast("long").alias("n_words"), placed(words).alias("placed")))
    base = documents.select("doc_id", F.xxhash64(text).alias("text_key"), whole.alias("whole")).select("doc_id", "text_key", "whole.*")
    found = matches(documents, cfg).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    found = found.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["text_key"] == found["_key"]), "left")
    at = F.transform("placed", lambda s: s["at"])
    labels = F.array_distinct(F.transform("placed", lambda s: s["label"]))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("placed").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_sort(labels).alias("base_labels"),
        F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("placed") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
