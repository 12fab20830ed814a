"""Document cleaning, quality and chunking as expressions over a text column."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import lexicon, text
from ..shared import pieces, unused


@dataclass(frozen=True)
class CleanConfig:
    """script: members of a Java character class. fold: fold word lists as the text they are compared with is folded."""

    script: str = text.ARABIC
    least_chars: int = 80
    least_ratio: float = 0.15
    line_chars: int = 40
    line_ratio: float = 0.20
    noise: tuple[str, ...] = tuple(lexicon.NOISE_LINES)
    education: tuple[str, ...] = tuple(lexicon.EDUCATION_WORDS)
    fold: bool = True

    def lists(self) -> tuple[list[str], list[str]]:
        if not self.fold:
            return list(self.noise), list(self.education)
        table = str.maketrans(lexicon.LETTERS, lexicon.FOLDED_LETTERS)
        return [x.translate(table) for x in self.noise], [x.translate(table) for x in self.education]


@dataclass(frozen=True)
class ChunkConfig:
    chars: int = 750
    overlap: int = 120


def quoted(words: list[str]) -> str:
    special = "\\.[]{}()*+-?^$|"
    return "|".join("".join(f"\\{c}" if c in special else c for c in w) for w in words)


def strip_markup(c: Column | str) -> Column:
    """Tags, URLs, mail addresses and page markers become blanks. Texts without the sign of one are not searched for it."""
    steps = (
        ("<", "<[^>]+>"),
        ("://", f"https?://[^{text.SPACE}]+"),
        ("@", f"(?<![^{text.SPACE}])[^{text.SPACE}]+@[^{text.SPACE}]+"),  # tried once for each word, not at each letter
        ("صفحة", f"\\[?[{text.SPACE}]*صفحة[{text.SPACE}]*\\p{{Nd}}+[{text.SPACE}]*\\]?"),
    )
    c = text.col(c)
    for sign, pattern in steps:
        c = _replaced_if(c, sign, pattern)
    return c


def _replaced_if(c: Column, sign: str, pattern: str) -> Column:
    return text.let(c, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, " ")).otherwise(t))


def _without_noise(c: Column | str, noise: list[str]) -> Column:
    """Stripped lines that are neither empty nor noise. Lines longer than all noise are not compared with it."""
    longest = max(map(len, noise), default=0)
    return F.filter(text.lines(c), lambda x: (x != "") & ((F.length(x) > longest) | ~F.coalesce(x.rlike(f"(?iu)^(?:{quoted(noise)})$"), F.lit(False))))


def noise_lines_removed(c: Column | str, noise: list[str]) -> Column:
    return F.array_join(_without_noise(c, noise), "\n")


def _in_script(lines: Column, script: str, chars: int, ratio: float) -> Column:
    return F.filter(lines, lambda x: (F.length(x) >= chars) & text.reaches(x, script, ratio))


def script_sections(c: Column | str, script: str = text.ARABIC, chars: int = 40, ratio: float = 0.20) -> Column:
    return F.array_join(_in_script(text.lines(c), script, chars, ratio), "\n\n")


def lines_deduplicated(c: Column | str) -> Column:
    return F.array_join(F.array_distinct(F.filter(text.lines(c), lambda x: x != "")), "\n")


def blocks_deduplicated(c: Column | str) -> Column:
    blocks = F.filter(F.transform(F.split(text.col(c), "\\n\\n"), text.strip), lambda x: x != "")
    return F.array_join(F.array_distinct(blocks), "\n\n")


def quality_score(c: Column | str, script: str = text.ARABIC, words: list[str] | None = None) -> Column:
    """Up to 0.90: length, script and words of the field; to two places, halves to even."""
    c = text.col(c)
    hits = sum((F.contains(c, F.lit(w)).cast("int") for w in (words if words is not None else lexicon.EDUCATION_WORDS)), F.lit(0))
    score = (
        F.when(F.length(c) > 500, 0.25).otherwise(0.0)
        + F.when(F.length(c) > 1500, 0.15).otherwise(0.0)
        + F.when(text.script_ratio(c, script) >= 0.3, 0.25).otherwise(0.0)
        + F.least(hits * 0.05, F.lit(0.25))
    )
    return text.two_places(F.least(score, F.lit(1.0)))


def clean_content(c: Column | str, cfg: CleanConfig = CleanConfig()) -> Column:
    """The cleaned text, empty if it isn't valid. The text must be in normal form C."""
    noise, _ = cfg.lists()
    plain = _without_noise(text.fold_letters(strip_markup(F.coalesce(text.col(c), F.lit("")))), noise)
    body = text.let(plain, lambda k: text.let(_in_script(k, cfg.script, cfg.line_chars, cfg.line_ratio), lambda s: F.when(F.size(s) == 0, k).otherwise(s)))
    # lines stay a list from one step to the next: they are stripped and not empty, and so is what they are joined to
    tidy = F.regexp_replace(F.array_join(F.array_distinct(body), "\n"), "\\t[ \\t]*| [ \\t]+", " ")
    return text.let(tidy, lambda t: F.when(text.is_valid_document(t, cfg.script, cfg.least_ratio, cfg.least_chars), t).otherwise(F.lit("")))


def clean_documents(documents: DataFrame, cfg: CleanConfig = CleanConfig(), column: str = "text") -> DataFrame:
    """documents with content, quality and hash (0 and null for invalid texts). Only texts that may not be in normal form C pass Python."""
    _, education = cfg.lists()
    cleaned = documents.withColumn("content", clean_content(text.nfc(column), cfg))
    some = F.col("content") != ""
    return cleaned.withColumn("quality", F.when(some, quality_score("content", cfg.script, education)).otherwise(0.0)).withColumn("hash", F.when(some, text.md5_text("content")))


def _first_above(sums: Column, x: Column, low: Column, high: Column) -> Column:
    """First place in [low, high) at which ascending sums are above x, else high, by bisection."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        above = F.get(sums, mid) > x
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(above, s["low"]).otherwise(mid + 1).alias("low"), F.when(above, mid).otherwise(s["high"]).alias("high")))

    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(high - low, F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(steps, F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")), halve, lambda s: s["low"])


def _running(lengths: Column) -> Column:
    """Prefix sums, by doubling the stretch that each sum covers."""
    powers = F.filter(F.lit([1 << i for i in range(31)]), lambda p: p < F.size(lengths))
    return F.aggregate(powers, lengths, lambda acc, p: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - p), F.lit(0))))


def packed_sentences(sentences: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """array<struct<chunk_index, chunk_total, chunk_text>>: greedy packing of sentences into chunks; each starts with the longest run of whole
    closing sentences of the one before that fits the overlap. Blanks between sentences don't count.

    A chunk is told by its first sentence that is new: where it begins follows from the prefix sums of lengths (the first sentence from
    which what stands before fits the overlap), and so does where the next one has its first new sentence (the first that exceeds the
    size). So chunks are a chain of pointers, each found by bisection, and no sentence is looked at one by one."""

    def chain(s: Column, sums: Column) -> Column:
        n = F.size(s)
        before = lambda i: F.when(i > 0, F.get(sums, i - 1)).otherwise(0)

        def step(acc: Column, _: Column) -> Column:
            end = _first_above(sums, before(acc["first"]) + cfg.chars, acc["new"] + 1, n)

            def told(b: Column) -> Column:
                rest = before(b) - cfg.overlap
                first = F.when(rest <= 0, F.lit(0)).otherwise(_first_above(sums, rest - 1, F.lit(0), b) + 1)
                return F.struct(F.concat(acc["made"], F.array(F.struct(acc["first"].alias("first"), b.alias("end")))).alias("made"), first.alias("first"), b.alias("new"))

            return F.when(acc["new"] >= n, acc).otherwise(text.let(end, told))

        none = F.array().cast("array<struct<first:int,end:int>>")
        zero = F.lit(0)
        # two chunks in a row hold more new text than a chunk's size without the overlap
        most = F.least(n, F.floor(2 * before(n) / max(1, cfg.chars - cfg.overlap)).cast("int") + 2) if cfg.chars > cfg.overlap else n
        ranges = F.aggregate(F.sequence(F.lit(0), most), F.struct(none.alias("made"), zero.alias("first"), zero.alias("new")), step, lambda acc: acc["made"])

        def laid(made: Column) -> Column:
            return F.transform(
                made,
                lambda r, i: F.struct(i.alias("chunk_index"), F.size(made).alias("chunk_total"), F.array_join(F.slice(s, r["first"] + 1, r["end"] - r["first"]), " ").alias("chunk_text")),
            )

        return text.let(ranges, laid)

    return text.let(F.coalesce(sentences, F.array().cast("array<string>")), lambda s: text.let(_running(F.transform(s, lambda x: F.length(x))), lambda sums: chain(s, sums)))


#: Columns that chunk_documents makes; a document's own of these names give way.
CHUNK_COLUMNS = ("chunk_id", "chunk_index", "chunk_total", "characters", "chunk_text")


def chunk_documents(cleaned: DataFrame, cfg: ChunkConfig = ChunkConfig(), column: str = "content", key: str = "doc_id") -> DataFrame:
    """A row for each chunk: the document's columns as they are but for the text itself (column), then chunk_id (key_index; null without a key),
    chunk_index, chunk_total, characters and chunk_text. Documents without a sentence have no chunk."""
    kept = [c for c in cleaned.columns if c != column and c not in CHUNK_COLUMNS]
    made, one = unused(cleaned, "chunks"), unused(cleaned, "chunk")
    # the array is made in a projection of its own: exploding a mere column is compiled. Outer, as else a filter on its size makes it once more
    whole = cleaned.select(*kept, packed_sentences(text.split_sentences(column), cfg).alias(made))
    rows = whole.select(*kept, F.explode_outer(made).alias(one)).where(F.col(one).isNotNull())
    return _told(rows.select(*kept, *(F.col(one)[c].alias(c) for c in ("chunk_index", "chunk_total", "chunk_text"))), kept, key)


def _told(rows: DataFrame, kept: list[str], key: str) -> DataFrame:
    named = F.concat(F.col(key).cast("string"), F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id")
    return rows.select(*(f"`{c}`" for c in kept), named, "chunk_index", "chunk_total", F.length("chunk_text").alias("characters"), "chunk_text")


#: Bytes of texts that a task cleans in one go.
BYTES = 1 << 20
#: Members of a character class that Java and Python read alike: letters, digits, code points, and ranges of them.
PLAIN = re.compile(r"(?:(?:\\u[0-9A-Fa-f]{4}|[A-Za-z0-9])(?:-(?:\\u[0-9A-Fa-f]{4}|[A-Za-z0-9]))?)+")
_MARKUP = (("<", re.compile(r"<[^>]+>")), ("://", re.compile(r"https?://\S+")), ("@", re.compile(r"(?<!\S)\S+@\S+")), ("صفحة", re.compile(r"\[?\s*صفحة\s*\d+\s*\]?")))
_STOP, _BLANKS = re.compile(r"[.!؟](\s+)"), re.compile(r"\t[ \t]*| [ \t]+")


def _cleaner(cfg: CleanConfig):
    """clean_content for one text, which need not be in normal form C."""
    noise = cfg.lists()[0]
    longest, dull = max(map(len, noise), default=0), re.compile("|".join(map(re.escape, noise)), re.IGNORECASE)
    others, letters = re.compile(f"[{cfg.script}]+"), str.maketrans(lexicon.LETTERS, lexicon.FOLDED_LETTERS)
    foldable, marks = re.compile(f"[{lexicon.LETTERS}{text.DIACRITICS[1:-1]}]"), re.compile(text.DIACRITICS)

    def reaches(x: str, least: float) -> bool:
        size = max(len(x), 1)
        beginning = x[: int(size * 2 * least) + 1]  # most texts need not be read to their end
        return (len(beginning) - len(others.sub("", beginning))) / size >= least or (len(x) - len(others.sub("", x))) / size >= least

    def run(x: str) -> str:
        x = x if x.isascii() else unicodedata.normalize("NFC", x)
        for sign, pattern in _MARKUP:
            x = pattern.sub(" ", x) if sign in x else x
        if not x.isascii() and foldable.search(x):
            x = marks.sub("", x.translate(letters))
        lines = [s for line in x.splitlines() if (s := line.strip()) and (len(s) > longest or not dull.fullmatch(s))]
        own = [s for s in lines if len(s) >= cfg.line_chars and reaches(s, cfg.line_ratio)]
        x = _BLANKS.sub(" ", "\n".join(dict.fromkeys(own or lines)))
        return x if len(x) >= max(1, cfg.least_chars) and reaches(x, cfg.least_ratio) else ""

    return run


def _sentences(x: str, longer_than: int = 5) -> list[str]:
    at, found = 0, []
    for stop in _STOP.finditer(x):
        found.append(x[at : stop.start(1)].strip())
        at = stop.end()
    found.append(x[at:].strip())
    return [s for s in found if len(s) > longer_than]


def _packed(sentences: list[str], cfg: ChunkConfig) -> list[str]:
    """packed_sentences for one text."""
    sums = [0, *accumulate(map(len, sentences))]
    first, new, made = 0, 0, []
    while new < len(sentences):
        end = bisect_right(sums, sums[first] + cfg.chars, new + 2) - 1
        made.append(" ".join(sentences[first:end]))
        rest = sums[end] - cfg.overlap
        first, new = 0 if rest <= 0 else bisect_right(sums, rest - 1, 1, end + 1), end
    return made


def _chunked(names: list[str], cleaning: CleanConfig, chunking: ChunkConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaned = _cleaner(cleaning)
        for whole in batches:
            for start, stop in pieces(pc.fill_null(pc.binary_length(whole.column(0)), 0).to_numpy(), BYTES):
                batch = whole.slice(start, stop - start)
                chunks = [_packed(_sentences(cleaned((x or b"").decode("utf-8", "replace"))), chunking) for x in batch.column(0).to_pylist()]
                many = np.array([len(c) for c in chunks])
                row = np.repeat(np.arange(len(many)), many)
                index = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                made = [pa.array(index, pa.int32()), pa.array(many[row], pa.int32()), pa.array([x for c in chunks for x in c], pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns[1:]), *made], names)

    return run


def chunk_texts(documents: DataFrame, cleaning: CleanConfig = CleanConfig(), chunking: ChunkConfig = ChunkConfig(), column: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of chunk_documents over clean_documents, without content, quality and hash: texts are cleaned and cut by Arrow batches, which takes
    a fraction of the expressions' time. Scripts that are told by more than letters and ranges go by the expressions."""
    gone = (column, "content", "quality", "hash")
    if not PLAIN.fullmatch(cleaning.script):
        cleaned = clean_documents(documents, cleaning, column)
        return chunk_documents(cleaned.select("content", *(f"`{c}`" for c in documents.columns if c not in gone)), chunking, "content", key)
    kept = [f for f in documents.schema.fields if f.name not in gone and f.name not in CHUNK_COLUMNS]
    schema = StructType([*kept, StructField("chunk_index", IntegerType()), StructField("chunk_total", IntegerType()), StructField("chunk_text", StringType())])
    # by numbers: mapInArrow takes no column with a dot in its name
    rows = documents.select(F.col(column).cast("string").cast("binary").alias("text"), *(F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(kept)))
    numbered = StructType([StructField(f"_{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return _told(rows.mapInArrow(_chunked(numbered.names, cleaning, chunking), numbered).toDF(*schema.names), [f.name for f in kept], key)
