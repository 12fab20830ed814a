"""WARC archives with a two-level capture index.

Writing: pages become gzipped WARC/1.1 records, one gzip member each, in files of the shared folder. Of equal
payloads one page is archived in full and the others as revisit records that refer to it. Indexing: captures are
sorted by reversed-host URL key and page id over the whole archive, written as compressed blocks, and a sparse
directory keeps the first key of every block; the first keys of the index parts form the level above. Lookup: a
key is routed to its part by binary search in the upper level, to its block by binary search in that part's
directory, then the block and the records are fetched by range reads.

Defined results: null html is an empty payload, null url an empty key, a line break of a url is written as %0A or %0D; equal payloads refer to the largest page_id
among them, whose repeated rows are all responses; pages without page_id are responses unless an equal payload has
one; repeated rows are captures of their own; an empty table gives an empty archive; extra columns are ignored.
Files go through pyarrow's file systems; archives of a failed attempt are left unreferenced.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import SMALL_ROWS
from .common import cut, fresh_path, look_up
from .text import long_texts

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)(:\d+)?([^#]*)")


@dataclass(frozen=True)
class WarcConfig:
    """date: WARC-Date of all records; block: captures of an index block; level: of compression; roll: bytes after which a new file begins."""

    date: str = "2020-01-01T00:00:00Z"
    block: int = 512
    level: int = 6
    roll: int = 256 << 20


def url_key(url: str | None) -> str:
    """com,example,www:8080)/path?query for http://www.example.com:8080/path?query; other strings stay."""
    found = URL.match(url or "")
    if not found or not found[1]:
        return url or ""
    rest = found[3] or "/"
    return ",".join(reversed(found[1].lower().split("."))) + (found[2] or "") + ")" + (rest if rest.startswith("/") else "/" + rest)


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts by URL key, then page id."""
    at = "-" if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{url_key(url)} {at}".replace("\n", "%0A").replace("\r", "%0D")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _clean(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, cfg: WarcConfig) -> bytes:
    """One record, compressed as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", cfg.date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if is_revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Date", cfg.date)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    whole = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(cfg.level, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def read_archive(path: str, piece: int = 1 << 20) -> Iterator[bytes]:
    """All records of a file from front to back, uncompressed, for use without an index. One record is held at a time."""
    system, where = fs.FileSystem.from_uri(path)
    with system.open_input_stream(where, compression=None) as f:
        unpack, found, rest = zlib.decompressobj(31), [], b""
        while rest or (rest := f.read(piece)):
            found.append(unpack.decompress(rest))
            rest = unpack.unused_data
            if unpack.eof:
                yield b"".join(found)
                unpack, found = zlib.decompressobj(31), []


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(root: str, cfg: WarcConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        sink, name, offset = None, "", 0
        for batch in batches:
            found = []
            for page_id, url, payload, revisit, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if sink is None or offset >= cfg.roll:
                    if sink is not None:
                        sink.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = system.open_output_stream(f"{folder}/{name}", compression=None)
                payload = payload or b""
                record = build_record(page_id, url, payload, sha1_base32(payload), refers_to, revisit, cfg)
                sink.write(record)
                found.append((capture_key(url, page_id), name, offset, len(record)))
                offset += len(record)
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(("key", "file", "at", "size"), map(list, zip(*found)))))
        if sink is not None:
            sink.close()

    return run


def _index(root: str, cfg: WarcConfig):
    """Writes the sorted captures of a task as one part: blocks, then the part's block directory; yields a row of the upper level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        sink, lines, directory, offset, name = None, [], [], 0, f"{uuid.uuid4().hex}.idx"

        def close_block() -> None:
            nonlocal offset
            packed = zlib.compress("\n".join(lines).encode())
            sink.write(packed)
            directory.append((lines[0].rsplit("\t", 1)[0], offset, len(packed)))
            offset += len(packed)
            lines.clear()

        for batch in batches:
            for key, file, at, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if sink is None:
                    system.create_dir(folder, recursive=True)
                    sink = system.open_output_stream(f"{folder}/{name}", compression=None)
                lines.append(f"{key}\t{json.dumps([file, at, size], separators=(',', ':'))}")
                if len(lines) >= cfg.block:
                    close_block()
        if sink is not None:
            if lines:
                close_block()
            packed = zlib.compress(json.dumps(directory).encode())
            sink.write(packed)
            sink.close()
            yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "part": [name], "at": [offset], "size": [len(packed)]})

    return run


@dataclass(frozen=True)
class Archive:
    """root: folder of the archives; parts: upper level of the index, one row for each index part (as many as sorting used partitions)."""

    root: str
    parts: tuple[tuple[str, str, int, int], ...]


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to): the payload's largest page_id is the response."""
    long_texts(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    key = cut(rows.select("page_id", F.sha2("payload", 256).alias("hash")))
    several = key.groupBy("hash").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    revisits = look_up(key, several, "hash", "n", key.count()).where("page_id is null or page_id <> last").select(F.col("page_id").alias("id"), "hash", "last").distinct()
    revisits = cut(revisits)  # what was decided is narrow: up to SMALL_ROWS of it, counted, goes to the payloads, which then are not exchanged
    revisits = F.broadcast(revisits) if revisits.count() <= SMALL_ROWS else revisits
    hashed = rows.withColumn("own", F.sha2("payload", 256))
    met = hashed.join(revisits, hashed["page_id"].eqNullSafe(revisits["id"]) & (hashed["own"] == revisits["hash"]), "left")
    return met.select("page_id", "url", "payload", F.col("last").isNotNull().alias("revisit"), F.col("last").alias("refers_to"))


def write(spark: SparkSession, pages: DataFrame, root: str | None = None, cfg: WarcConfig = WarcConfig()) -> Archive:
    root = root or fresh_path(spark, "warc")
    captures = cut(decide(pages).mapInArrow(_write(root, cfg), "key string, file string, at long, size long"))
    ordered = captures.repartitionByRange("key", "file", "at").sortWithinPartitions("key", "file", "at")
    parts = cut(ordered.mapInArrow(_index(root, cfg), "first string, part string, at long, size long"))
    return Archive(root, tuple(sorted(tuple(r) for r in parts.collect())))


@lru_cache(maxsize=64)
def _directory(root: str, part: str, at: int, size: int) -> list:
    return json.loads(zlib.decompress(_range(root, part, at, size)))


def _range(root: str, name: str, at: int, size: int) -> bytes:
    system, folder = fs.FileSystem.from_uri(root)
    with system.open_input_file(f"{folder}/{name}") as f:
        return f.read_at(size, at)


def find(archive: Archive, keys: list[str]) -> Iterator[tuple[str, str, int, int]]:
    """(key, file, offset, size) of the captures of sorted keys: upper level, block directory and block by binary search."""
    firsts = [p[0] for p in archive.parts]
    read, block = None, []
    for key in keys:
        # captures of a key may begin in the part and block before the first one that starts with it
        for part in archive.parts[max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]:
            directory = _directory(archive.root, *part[1:])
            heads = [d[0] for d in directory]
            for i in range(max(0, bisect_left(heads, key) - 1), bisect_right(heads, key)):
                if read != (part[1], i):
                    lines = zlib.decompress(_range(archive.root, part[1], *directory[i][1:])).decode().split("\n")
                    block, read = [x.rsplit("\t", 1) for x in lines], (part[1], i)
                for k, where in block[bisect_left(block, key, key=lambda x: x[0]) : bisect_right(block, key, key=lambda x: x[0])]:
                    yield (k, *json.loads(where))


def lookup(archive: Archive, wanted: DataFrame) -> DataFrame:
    """wanted: (url, page_id). A row for each capture of one of these pairs: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    Index keys leave out what doesn't tell captures apart in practice (scheme, http and https, fragments); the records' own URLs decide."""
    firsts = [p[0] for p in archive.parts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(0).to_pylist()
            keys = [capture_key(u, p) for u, p in zip(urls, batch.column(1).to_pylist())]
            parts = [max(0, bisect_right(firsts, k) - 1) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.string()), pa.array(map(_clean, urls), pa.string())], ["part", "key", "url"])

    def page_of(told: str) -> int | None:
        own = told[len("<urn:page:") : -1]
        return None if own == "none" else int(own)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(archive.root)
        for batch in batches:
            asked: dict[str, set[str]] = {}
            for key, urls in zip(batch.column("key").to_pylist(), batch.column("urls").to_pylist()):
                asked[key] = set(urls)
            places = sorted((f, at, size, key) for key, f, at, size in find(archive, sorted(asked)))
            rows, bytes_held = [], 0
            for file, own in groupby(places, key=lambda x: x[0]):
                with system.open_input_file(f"{folder}/{file}") as source:
                    for _, at, size, key in own:
                        head, http, payload = parse_record(zlib.decompress(source.read_at(size, at), 31))
                        if head["WARC-Target-URI"] not in asked[key]:
                            continue
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        n = int(http["Content-Length"])
                        if kind == "response" and (n != len(payload) or digest != sha1_base32(payload)):
                            raise ValueError(f"damaged record at {file}:{at}")
                        rows.append((page_of(head["WARC-Record-ID"]), n, digest, kind, page_of(head["WARC-Refers-To"]) if kind == "revisit" else None, payload))
                        bytes_held += len(payload)
                        if bytes_held > 16 << 20:
                            yield _rows(rows)
                            rows, bytes_held = [], 0
            yield _rows(rows)

    long_texts(wanted.sparkSession)
    routed = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(route, "part int, key string, url string")
    # a stated number of partitions: keys are small, what they make a task read isn't, so they must not be put together by size
    tasks = max(len(firsts), int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return routed.groupBy("part", "key").agg(F.collect_set("url").alias("urls")).repartition(tasks, "part", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("key").mapInArrow(fetch, SCHEMA)


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _rows(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
