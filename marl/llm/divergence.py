"""Source divergence audit: how far the word use of each source is from that of its language's other sources.

Two passes over texts that are dealt once to groups of bounded bytes. The first counts, exactly, in how many documents of a language
each term stands: groups send their terms to shards by the term's hash, shards add up and answer each group with those of its own
terms that are kept. The second pads these with a delimiter on both sides, makes an automaton of them for each language of the group
and runs the group's texts, their other characters turned to delimiters, through it, which counts every occurrence. No task holds a
vocabulary of more than a group's text, and none is broadcast. Shards add the counts up to postings (language, source, term, count),
none of them zero, which give everything else:

- a source's p of a term follows from its count and its total, so that all terms that it lacks share one p;
- the value of a pair is a sum over all kept terms. Terms that only one side has are summed by equal counts; terms that both have
  meet in the shard of the term; what neither has is one product;
- ranks of terms are cut to the first ones by each task before they are exchanged.

All arithmetic is in whole numbers: 64 bits where that is proven to do (p is at most SCALE + 1, so a square is below 2**63, and the
values of a pair sum up to at most SCALE**2), decimals of 38 digits for products with counts.

Defined results: null text, lang and source are ''; every row is a document, with or without id, repeated or not; an empty table
gives no rows; a language without kept terms gives pairs of value 0 and no terms; a source alone in its language has no pairs;
ties go by the item's bytes; extra columns are ignored. A text is never split: one task holds the longest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import SMALL_ROWS
from .common import cut, fresh_path
from .text import PrefixHash, flat, gather, long_texts, mix, trimmed, trimmed_pair, words_in

SCALE = 1_000_000_000
#: Bytes of terms stay as they are, A-Z lower-cased; all others become the delimiter.
TERM_BYTES = np.array([i if i >= 0x80 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256)], np.uint8)


@dataclass(frozen=True)
class AuditConfig:
    """least_documents: documents of a language that a kept term stands in; ranks: terms of a source that are told; group_bytes, shard_bytes:
    text for which there is one group, one shard."""

    least_documents: int = 3
    ranks: int = 200
    group_bytes: int = 8 << 20
    shard_bytes: int = 16 << 20


@dataclass
class Words:
    """Texts as words: binary terms, the term of each word, and the row it stands in."""

    terms: pa.BinaryArray
    codes: np.ndarray
    rows: np.ndarray


def _laid(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.BinaryArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(gather(data, starts, lengths))])


def _translated(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(rows["t"])
    return TERM_BYTES[data], offsets


def _words(rows: pa.Table) -> Words:
    data, offsets = _translated(rows)
    starts, stops, counts = words_in(data, offsets)
    coded = _laid(data, starts, stops - starts).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(rows.num_rows), np.diff(counts)))


def _pack(terms: pa.BinaryArray, *numbers: np.ndarray) -> bytes:
    """Terms and arrays of numbers, in few bytes."""
    data, offsets = flat(terms)
    parts = [np.diff(offsets).astype(np.int32), *(n.astype(np.int64) for n in numbers)]
    head = np.array([len(parts), *(x.nbytes for x in parts)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(x.tobytes() for x in parts), data[int(offsets[0]) : int(offsets[-1])].tobytes()]))


def _unpack(blob: bytes) -> tuple[pa.BinaryArray, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    many = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, many + 1)[1:].tolist()
    at, parts = 8 * (many + 1), []
    for i, size in enumerate(sizes):
        kind = np.int64 if i else np.int32
        parts.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    offsets = np.concatenate([[0], np.cumsum(parts[0])]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(parts[0]), [None, pa.py_buffer(offsets), pa.py_buffer(raw[at:])]), parts[1:]


def _by_shard(terms: pa.BinaryArray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its terms), by a hash of the terms' bytes."""
    data, offsets = flat(terms)
    shard = (mix(PrefixHash(data).of(offsets[:-1], offsets[1:])) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut_ = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cut_[:-1].tolist(), cut_[1:].tolist()):
        yield int(shard[order[a]]), order[a:b]


SENT = pa.schema({"shard": pa.int64(), "gid": pa.int64(), "lang": pa.string(), "blob": pa.binary()})


def _sent(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in SENT]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT)], schema=SENT)


def _codes(values: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    coded = values.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers, how often each occurs)."""
    numbers = np.sort(numbers)
    at = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else np.zeros(0, np.int64)
    return numbers[at], np.diff(np.append(at, len(numbers)))


def _ask(shards: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """In how many documents of the group each term stands, to the terms' shards."""
        words = _words(rows)
        langs, lang = _codes(rows["lang"])
        width, out = max(1, len(words.terms)), []
        pair, _ = _runs(words.rows * width + words.codes)  # each term of a document once
        found, df = _runs(lang[pair // width] * width + pair % width)
        for number, name in enumerate(langs):
            own = found // width == number
            terms, n = words.terms.take(pa.array(found[own] % width)), df[own]
            out += [(shard, key[0].as_py(), name, _pack(terms.take(pa.array(at)), n[at])) for shard, at in _by_shard(terms, shards)]
        return _sent(out)

    return run


def _together(parts: list[tuple]) -> tuple[pa.BinaryArray, list[np.ndarray]]:
    """(distinct terms of all parts, the place of each part's terms among them)."""
    coded = pa.concat_arrays([t for t, _ in parts]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    return coded.dictionary, np.split(codes, np.cumsum([len(t) for t, _ in parts])[:-1])


def _answer(least: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Which terms are kept, and in how many documents they stand, to the groups that have them."""
        langs, lang = _codes(rows["lang"])
        gids, blobs, out = rows["gid"].to_pylist(), rows["blob"].to_pylist(), []
        for number, name in enumerate(langs):
            own = np.flatnonzero(lang == number).tolist()
            parts = [_unpack(blobs[i]) for i in own]
            terms, codes = _together(parts)
            df = np.zeros(len(terms), np.int64)
            for code, (_, numbers) in zip(codes, parts):
                df[code] += numbers[0]  # a part has each of its terms once
            for i, code in zip(own, codes):
                kept = code[df[code] >= least]
                if len(kept):
                    out.append((key[0].as_py(), gids[i], name, _pack(terms.take(pa.array(kept)), df[kept])))
        return _sent(out)

    return run


def _recount(shards: int):
    def run(_key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        """Occurrences in a group's texts, by an automaton of the kept terms that stand in it, to the terms' shards. Bytes are taken for characters.

        A blob has the names of as many sources as gid says, then a shard's terms, and for each posting the number of its source, that of its
        term, and its count."""
        from ahocorasick import Automaton

        if not rows.num_rows or not told.num_rows:
            return _sent([])
        langs, lang = _codes(rows["lang"])
        sources, source = _codes(rows["source"])
        asked, blobs = told["lang"].to_pylist(), told["blob"].to_pylist()
        data, offsets = _translated(rows)
        raw, out = data.tobytes(), []
        for number, name in enumerate(langs):
            parts = [_unpack(b) for x, b in zip(asked, blobs) if x == name]
            if not parts:
                continue
            terms = pa.concat_arrays([t for t, _ in parts])
            terms = terms.take(pa.array(np.argsort(-np.concatenate([n[0] for _, n in parts]), kind="stable")))  # the most frequent first: an automaton looks at its branches in this order
            automaton = Automaton()
            for place, term in enumerate(terms.to_pylist()):
                automaton.add_word(f" {term.decode('latin-1')} ", place)
            automaton.make_automaton()
            counts = []
            for who in np.unique(source[lang == number]).tolist():
                own = np.flatnonzero((lang == number) & (source == who)).tolist()
                met = chain.from_iterable(automaton.iter(f" {raw[offsets[i] : offsets[i + 1]].decode('latin-1')} ") for i in own)
                n = np.bincount(np.fromiter(map(itemgetter(1), met), np.int64), minlength=len(terms))
                some = np.flatnonzero(n)
                counts.append((np.full(len(some), who), some, n[some]))
            who, term, n = (np.concatenate(x) for x in zip(*counts))
            place = np.empty(len(terms), np.int64)
            shard_of = np.empty(len(terms), np.int64)
            for shard, at in _by_shard(terms, shards):
                place[at], shard_of[at] = np.arange(len(at)), shard
            order = np.argsort(shard_of[term], kind="stable")
            bounds = np.searchsorted(shard_of[term][order], np.arange(shards + 1))
            for shard, at in _by_shard(terms, shards):
                own = order[bounds[shard] : bounds[shard + 1]]
                if len(own):
                    used, local = np.unique(who[own], return_inverse=True)
                    names = pa.array([sources[i].encode() for i in used.tolist()], pa.binary())
                    both = pa.concat_arrays([names, terms.take(pa.array(at))])
                    out.append((shard, len(names), name, _pack(both, local, place[term[own]], n[own])))
        return _sent(out)

    return run


POSTED = pa.schema({"shard": pa.int64(), "lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "lang_n": pa.int64(), "first": pa.bool_()})


def _post(key: tuple, rows: pa.Table) -> pa.Table:
    """The shard's postings; first: on one posting of each term."""
    langs, lang = _codes(rows["lang"])
    names_in, blobs, parts = rows["gid"].to_pylist(), rows["blob"].to_pylist(), []
    for number, name in enumerate(langs):
        own = np.flatnonzero(lang == number).tolist()
        found = [(t.slice(names_in[i]), t.slice(0, names_in[i]), numbers) for i, (t, numbers) in ((i, _unpack(blobs[i])) for i in own)]
        terms, codes = _together([(t, []) for t, _, _ in found])
        sources, owners = _together([(s, []) for _, s, _ in found])
        pair = np.concatenate([code[n[1]] * len(sources) + owner[n[0]] for code, owner, (_, _, n) in zip(codes, owners, found)])
        pair, of = np.unique(pair, return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, of, np.concatenate([x[2] for _, _, x in found]))
        term = pair // len(sources)
        whole = np.zeros(len(terms), np.int64)
        np.add.at(whole, term, n)
        first = np.concatenate([[True], term[1:] != term[:-1]])
        columns = [pa.array(np.full(len(pair), key[0].as_py())), pa.array([name] * len(pair)), sources.take(pa.array(pair % len(sources))).cast(pa.string()), terms.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(whole[term]), pa.array(first)]
        parts.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, POSTED)], schema=POSTED))
    return pa.concat_tables(parts)


#: (source, other source) values of a shard that are worked on at a time.
STEP = 1 << 20


def _meet(_key: tuple, rows: pa.Table) -> pa.Table:
    """(lang, source, item, value): what terms that both sources have add to the sum over terms that one of them has."""
    found = []
    langs = rows["lang"].combine_chunks().dictionary_encode()
    lang_of = langs.indices.to_numpy()
    for number, lang in enumerate(langs.dictionary.to_pylist()):
        own = rows.filter(pa.array(lang_of == number))
        named = own["source"].combine_chunks().dictionary_encode()
        source, names = named.indices.to_numpy().astype(np.int64), named.dictionary.to_pylist()
        term = own["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(term, kind="stable")
        source, p, p0 = source[order], own["p"].to_numpy()[order], own["p0"].to_numpy()[order]
        begin = np.flatnonzero(np.concatenate([[True], term[order][1:] != term[order][:-1]]))
        size = np.diff(np.append(begin, len(order)))
        start, many = np.repeat(begin, size), np.repeat(size, size)  # of each posting: its term's postings
        sums, ends = np.zeros(len(names) ** 2, np.int64), np.cumsum(many)
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            n = many[at:to]
            left = np.repeat(np.arange(at, to), n)
            right = np.repeat(start[at:to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            a, b, a0, b0 = p[left], p[right], p0[left], p0[right]
            value = (a - b) ** 2 // b - (a - b0) ** 2 // b0 - (a0 - b) ** 2 // b + (a0 - b0) ** 2 // b0
            np.add.at(sums, source[left] * len(names) + source[right], value)
            at = to
        pair = np.flatnonzero(sums)
        pair = pair[pair // len(names) != pair % len(names)]
        found.append(pa.table({"lang": pa.array([lang] * len(pair), pa.string()), "source": pa.array([names[i] for i in pair // len(names)], pa.string()), "item": pa.array([names[i] for i in pair % len(names)], pa.string()), "value": pa.array(sums[pair], pa.int64())}))
    return pa.concat_tables(found)


@dataclass
class Audit:
    """groups: (lang, source, total, terms, kept) for every occurring group, total being the sum of its counts of kept terms, terms how many
    of them it has, kept how many its language keeps; postings: (shard, lang, source, term, n, lang_n), n > 0, lang_n that of the language."""

    groups: DataFrame
    postings: DataFrame
    #: Whether groups are few enough (SMALL_ROWS, counted) to be broadcast to the postings, which then are not exchanged by source.
    few: bool

    def met(self, groups: DataFrame) -> DataFrame:
        return self.postings.join(F.broadcast(groups) if self.few else groups, ["lang", "source"])


def postings(documents: DataFrame, cfg: AuditConfig = AuditConfig()) -> Audit:
    spark = documents.sparkSession
    long_texts(spark)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    total = documents.agg(F.sum(F.length(text))).first()[0] or 0
    groups, shards = (max(1, math.ceil(total / size)) for size in (cfg.group_bytes, cfg.shard_bytes))
    gid = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), named("source"), text), F.lit(groups)).cast("long").alias("gid")
    rows = documents.select(gid, named("lang"), named("source"), text.alias("t"))
    sent = "shard long, gid long, lang string, blob binary"
    answers = rows.groupBy("gid").applyInArrow(trimmed(_ask(shards)), sent).groupBy("shard").applyInArrow(trimmed(_answer(cfg.least_documents)), sent)
    counted = rows.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(trimmed_pair(_recount(shards)), sent)
    path = fresh_path(spark, "postings")
    counted.groupBy("shard").applyInArrow(trimmed(_post), "shard long, lang string, source string, term string, n long, lang_n long, first boolean").write.parquet(path)
    posted = spark.read.parquet(path)
    # a kept term stands in its language's documents, so that the postings hold all of them
    width = posted.groupBy("lang").agg(F.count_if("first").alias("kept"))
    sums = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    found = documents.select(named("lang"), named("source")).distinct().join(sums, ["lang", "source"], "left").join(width, "lang", "left")
    found = cut(found.select("lang", "source", zero("total"), zero("terms"), zero("kept")))
    return Audit(found, posted, found.count() <= SMALL_ROWS)


def share(count: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(SCALE * (count + 1) / (total + kept))."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.call_function("div", wide(F.lit(SCALE)).cast("decimal(10,0)") * wide(count + 1), F.when(total + kept > 0, wide(total + kept)))
    return 1 + over.cast("long")


def weight(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def pairs(found: Audit) -> DataFrame:
    """(lang, source, item, value): for every source and each other one of its language."""
    none = F.lit(0).cast("long")
    left = found.groups.select("lang", "source", F.col("total").alias("ls"), F.col("terms").alias("ts"), F.col("kept").alias("v"), share(none, F.col("total"), F.col("kept")).alias("p0"))
    right = found.groups.select("lang", F.col("source").alias("item"), F.col("total").alias("lt"), F.col("terms").alias("tt"), share(none, F.col("total"), F.col("kept")).alias("q0"))
    every = cut(left.join(right, "lang").where("source <> item"))
    same = cut(found.postings.groupBy("lang", "source", "n").agg(F.count("*").alias("many")))
    mine = every.join(same, ["lang", "source"]).select("lang", "source", "item", (F.col("many") * weight(share(F.col("n"), F.col("ls"), F.col("v")), F.col("q0"))).alias("value"))
    theirs = every.join(same.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("many") * weight(F.col("p0"), share(F.col("n"), F.col("lt"), F.col("v")))).alias("value"))
    sized = found.met(found.groups).select("shard", "lang", "term", "source", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(none, F.col("total"), F.col("kept")).alias("p0"))
    both = sized.groupBy("shard").applyInArrow(trimmed(_meet), "lang string, source string, item string, value long")
    rest = every.select("lang", "source", "item", F.when(F.col("v") > 0, (F.col("v") - F.col("ts") - F.col("tt")) * weight(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))
    return mine.unionByName(theirs).unionByName(both).unionByName(rest).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def terms(found: Audit) -> DataFrame:
    """(lang, source, item, value): terms that a source uses more than its language does."""
    width = found.groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    used = found.met(found.groups.join(width, "lang"))
    shares = used.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return shares.where("p > q").select("lang", "source", "item", weight(F.col("p"), F.col("q")).alias("value"))


def audit(documents: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs, and the first terms, of every source."""
    found = postings(documents, cfg)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    ranked = terms(found).withColumn("rank", rank).where(F.col("rank") <= cfg.ranks)
    parts = pairs(found).withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(ranked.withColumn("part", F.lit("term")))
    return parts.select("lang", "source", "part", "item", "value", "rank")
