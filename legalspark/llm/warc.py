"""WARC files as a Python data source, and a writer for tables of pages (operator 5).

``spark.read.format("warc").load(folder)`` gives one row a record. The driver plans partitions of whole files, small
ones together up to ``splitBytes``. Predicates on the record type and on headers are pushed down (with
spark.sql.python.filterPushdown.enabled): a task reads a record's WARC header first, then, if a predicate asks for it,
the HTTP header, and skips the block of a record that fails: in plain files by seeking past it, so that its payload is never
read; in gzip ones, which have no index, by inflating and dropping it. With the option ``payload`` "false" no payload is
kept. Payloads are the bytes of the HTTP body, without undoing a transfer or content encoding.

Options: ``payload`` (true), ``splitBytes`` (64 MB), ``batchBytes`` (8 MB of payload a batch). Files end in .warc or
.warc.gz; others are ignored, an empty folder gives no rows. Headers that are absent are null; names are matched
without case; of repeated ones the first counts; a WARC-Block-Digest is not checked. A record that is cut off or has no
sound Content-Length ends its file with an error, or quietly after the records before it with ``mode`` "DROPMALFORMED".
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from .shared import as_long, new_path

SCHEMA = "warc_type string, record_id string, date string, target_uri string, content_type string, content_length bigint, http_status int, http_type string, page_id string, null_payload boolean, file string, offset bigint, payload binary"
_FIELDS = {"warc_type": b"warc-type", "record_id": b"warc-record-id", "date": b"warc-date", "target_uri": b"warc-target-uri", "content_type": b"content-type", "page_id": b"x-page-id"}
_HTTP = {"http_status", "http_type"}
_HEADER = {*_FIELDS, "content_length", "null_payload", *_HTTP}
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("warc_type", "record_id", "date", "target_uri", "content_type")]
    + [("content_length", pa.int64()), ("http_status", pa.int32()), ("http_type", pa.string()), ("page_id", pa.string()), ("null_payload", pa.bool_()), ("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())]
)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


@dataclass
class Test:
    column: str
    kind: str
    value: Any = field(default=None)
    negated: bool = False

    def __call__(self, row: dict[str, Any]) -> bool:
        x, v = row.get(self.column), self.value
        if self.kind in ("IsNull", "EqualNullSafe"):
            return (x == v) != self.negated
        if x is None:  # a comparison with null is neither true nor false
            return self.negated and self.kind == "IsNotNull"
        return self.negated != {
            "EqualTo": lambda: x == v, "In": lambda: x in v, "GreaterThan": lambda: x > v, "GreaterThanOrEqual": lambda: x >= v, "LessThan": lambda: x < v, "LessThanOrEqual": lambda: x <= v,
            "StringStartsWith": lambda: x.startswith(v), "StringEndsWith": lambda: x.endswith(v), "StringContains": lambda: v in x, "IsNotNull": lambda: True,
        }[self.kind]()


_KINDS = (EqualTo, EqualNullSafe, IsNull, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains, IsNotNull)


def headers(lines: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    last = None
    for line in lines.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last is not None:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        last = None
        if colon and name.strip().lower() not in out:
            last = name.strip().lower()
            out[last] = value.strip().decode("utf-8", "replace")
    return out


class Cut(Exception):
    """The file ends within a record."""


class Stream:
    """A file read in order, of which parts can be skipped."""

    def __init__(self, raw: Any, packed: bool):
        self.f = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if packed else io.BufferedReader(raw, 1 << 16) if isinstance(raw, io.RawIOBase) else raw
        self.packed, self.at = packed, 0

    def read(self, n: int) -> bytes:
        out = self.f.read(n)
        self.at += len(out)
        return out

    def line(self) -> bytes:
        out = self.f.readline()
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        """Past n bytes, of which a plain file reads but the last, to see that they are there."""
        if not self.packed and n > 1:
            self.f.seek(n - 1, 1)
            self.at += n - 1
            n = 1
        while n > 0:
            got = len(self.read(min(n, 1 << 16)))
            if not got:
                raise Cut
            n -= got

    def head(self) -> bytes:
        """Lines up to an empty one."""
        out = []
        while (line := self.line()) not in (b"\r\n", b"\n"):
            if not line:
                raise Cut
            out.append(line)
        return b"".join(out)


def records(stream: Stream, tests: list[Test], payload: bool, strict: bool = True) -> Iterator[dict[str, Any]]:
    """Rows of the records that pass."""
    try:
        yield from _records(stream, tests, payload, strict)
    except (Cut, EOFError):
        if strict:
            raise ValueError(f"the file ends within a record, at {stream.at}") from None


def _records(stream: Stream, tests: list[Test], payload: bool, strict: bool) -> Iterator[dict[str, Any]]:
    early = [t for t in tests if t.column not in _HTTP]
    late = [t for t in tests if t.column in _HTTP]
    while True:
        line = stream.line()
        if not line:
            return
        if not line.strip():
            continue
        offset = stream.at - len(line)
        if not line.startswith(b"WARC/"):
            if strict:
                raise ValueError(f"no WARC record at {offset}: {line[:40]!r}")
            return
        known = headers(stream.head())
        try:
            length = int(known[b"content-length"])
            if length < 0:
                raise ValueError
        except (KeyError, ValueError):
            if strict:
                raise ValueError(f"the record at {offset} has no sound Content-Length") from None
            return
        row: dict[str, Any] = {c: known.get(h) for c, h in _FIELDS.items()} | {"content_length": length, "offset": offset, "null_payload": known.get(b"x-null-payload") == "true"}
        if not all(t(row) for t in early):
            stream.skip(length)
            continue
        left = length
        if (row["content_type"] or "").startswith("application/http"):
            begun = stream.at
            status = stream.line()
            http = headers(stream.head()) if status.strip() else {}
            left -= stream.at - begun
            parts = status.split()
            row["http_status"] = int(parts[1]) if len(parts) > 1 and parts[0].startswith(b"HTTP/") and parts[1].isdigit() else None
            row["http_type"] = http.get(b"content-type")
        if not all(t(row) for t in late) or not payload:
            stream.skip(left)
            if all(t(row) for t in late):
                yield row
            continue
        body = stream.read(max(0, left))
        if len(body) < left:
            raise Cut
        row["payload"] = None if row["null_payload"] else body
        yield row


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.batch = int(options.get("batchbytes", options.get("batchBytes", 8 << 20)))
        self.strict = options.get("mode", "FAILFAST").upper() != "DROPMALFORMED"
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = f.child if isinstance(f, Not) else f
            column = own.attribute[0] if getattr(own, "attribute", None) and len(own.attribute) == 1 else None
            if isinstance(own, _KINDS) and column in _HEADER:
                self.tests.append(Test(column, type(own).__name__, getattr(own, "value", None), own is not f))
            else:
                yield f

    def partitions(self) -> list[Files]:
        place, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else fs.FileSystem.from_uri("file://" + self.path)
        found = sorted((f.path, f.size or 0) for f in place.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        out: list[list[str]] = []
        room = 0
        for p, size in found:
            if not out or size > room:
                out.append([])
                room = self.split
            out[-1].append(p)
            room -= size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        place, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else fs.FileSystem.from_uri("file://" + self.path)
        rows: list[dict[str, Any]] = []
        size = 0
        for path in partition.paths:
            packed = path.endswith(".gz")
            with place.open_input_file(path) as raw:
                for row in records(Stream(raw if packed else io.BufferedReader(_Raw(raw), 1 << 18), packed), self.tests, self.payload, self.strict):
                    row["file"] = path
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size >= self.batch:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class _Raw(io.RawIOBase):
    """An Arrow file for io.BufferedReader."""

    def __init__(self, f: Any):
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, b: Any) -> int:
        got = self.f.read(len(b))
        b[: len(got)] = got
        return len(got)

    def seek(self, at: int, whence: int = 0) -> int:
        if whence == 1:
            at += self.f.tell()
        elif whence == 2:
            at += self.f.size()
        self.f.seek(at)
        return at

    def tell(self) -> int:
        return self.f.tell()


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _clean(value: str) -> bytes:
    """A header value; line ends are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A").encode()


def record(kind: str, uri: str | None, content_type: str, block: bytes, *extra: tuple[str, str]) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid4()).encode() + b">", b"WARC-Date: 2024-01-01T00:00:00Z"]
    if uri is not None:
        lines.append(b"WARC-Target-URI: " + _clean(uri))
    lines += [f"{k}: {v}".encode() for k, v in extra]
    lines += [b"Content-Type: " + content_type.encode(), b"Content-Length: " + str(len(block)).encode(), b"", block, b"", b""]
    return b"\r\n".join(lines)


def page_records(page_id: int | None, url: str | None, html: str | None) -> Iterator[bytes]:
    """A request and a response record."""
    extra = [] if page_id is None else [("X-Page-ID", str(page_id))]
    yield record("request", url, "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n", *extra)
    body = b"" if html is None else html.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    yield record("response", url, "application/http; msgtype=response", block, *extra, *([("X-Null-Payload", "true")] if html is None else []))


def write_pages(pages: DataFrame, folder: str, packed: bool = False, file_bytes: int = 32 << 20) -> int:
    """Writes (page_id, url, html) as WARC files of about file_bytes of text; gives the number of records.

    A task writes under a new name and moves the file to its own place when whole, so a task that runs twice leaves
    one copy.
    """
    from pyspark import TaskContext

    place, path = fs.FileSystem.from_uri(folder)
    place.create_dir(path, recursive=True)  # also for a table without rows

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = fs.FileSystem.from_uri(folder)
        part, k, n, out, name, held = TaskContext.get().partitionId(), 0, 0, None, "", 0

        def close() -> None:
            out.close()
            place.move(name, f"{path}/part-{part:06d}-{k:04d}.warc{'.gz' * packed}")

        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, held = f"{path}/.{uuid.uuid4().hex}.tmp", 0
                    out = place.open_output_stream(name, compression=None)
                    out.write(gzip.compress(record("warcinfo", None, "application/warc-fields", b"format: WARC File Format 1.1\r\n"), 1) if packed else record("warcinfo", None, "application/warc-fields", b"format: WARC File Format 1.1\r\n"))
                for r in page_records(page_id, url, html):
                    out.write(gzip.compress(r, 1) if packed else r)
                    n, held = n + 1, held + len(r)
                if held >= file_bytes:
                    close()
                    out, k = None, k + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows = pages.select(as_long("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(files, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html) of the response records; others are skipped unread."""
    register(spark)
    rows = spark.read.format("warc").load(folder).where("warc_type = 'response' and http_status = 200")
    return rows.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), F.decode("payload", "UTF-8").alias("html"))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, html_md5, html_bytes) of all pages, written as WARC files to the shared folder and read back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_pages(pages, folder if "://" in folder else "file://" + folder)
    register(spark)
    rows = spark.read.format("warc").load(folder if "://" in folder else "file://" + folder).where("warc_type = 'response' and http_status = 200")
    return rows.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), F.md5("payload").alias("html_md5"), F.octet_length("payload").cast("bigint").alias("html_bytes"))


ORACLE = "SELECT CAST(page_id AS BIGINT) AS page_id, url, md5(html) AS html_md5, CAST(strlen(html) AS BIGINT) AS html_bytes FROM pages"
