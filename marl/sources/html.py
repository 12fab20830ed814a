"""Text of HTML pages with the standard library's parser, by Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..shared import pieces

DROPPED = frozenset(("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg"))
KEPT = frozenset(("p", "article", "section"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BLANK = re.compile(r"\s+")
#: Bytes of HTML that a task reads in one go.
BYTES = 1 << 20


class _Reader(HTMLParser):
    """A tree walk without a tree: open elements are a stack; every kept element collects the text below it."""

    def __init__(self, once: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.once, self.stack, self.found = once, [], []
        self.title, self.described, self.in_title = [], "", False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "meta":
            told = dict(attrs)
            if (told.get("name") or "").lower() == "description" and not self.described:
                self.described = told.get("content") or ""
        if tag == "title" and not self.title:
            self.in_title = True
        if tag in VOID:
            return
        parts = None
        if tag in KEPT and not (self.once and any(x[1] is not None for x in self.stack)):
            parts = []
            self.found.append(parts)
        self.stack.append((tag, parts, tag in DROPPED or bool(self.stack and self.stack[-1][2])))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        if self.stack and self.stack[-1][2]:
            return
        for _, parts, _ in self.stack:
            if parts is not None:
                parts.append(data)


def extract(html: str | None, longer_than: int = 50, once: bool = False) -> tuple[str, str]:
    """(title, text): title, description, and the text of every p, article and section longer than a limit, on one line.

    Kept elements within kept elements repeat their text; once: only the outermost count.
    """
    if not html:
        return "", ""
    reader = _Reader(once)
    reader.feed(html)
    reader.close()
    clean = lambda parts: BLANK.sub(" ", " ".join(parts)).strip()
    title = clean(reader.title)
    body = [t for t in map(clean, reader.found) if len(t) > longer_than]
    return title, BLANK.sub(" ", " ".join(x for x in (title, reader.described, *body) if x)).strip()


def _extracted(names: list[str], once: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in pieces(pc.fill_null(pc.binary_length(whole.column(0)), 0).to_numpy(), BYTES):
                batch = whole.slice(start, stop - start)
                found = [extract(h, once=once) for h in batch.column(0).to_pylist()]
                made = [pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names)

    return run


def extract_pages(pages: DataFrame, once: bool = False) -> DataFrame:
    """pages with title and content in place of html; all other columns stay, a title or content of their own gives way."""
    kept = [f for f in pages.schema.fields if f.name not in ("html", "title", "content")]
    schema = StructType([*kept, StructField("title", StringType()), StructField("content", StringType())])
    return pages.select(F.col("html").cast("string"), *(F.col(f"`{f.name}`") for f in kept)).mapInArrow(_extracted(schema.names, once), schema)
