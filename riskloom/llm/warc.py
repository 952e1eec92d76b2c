"""WARC archives: a writer on Spark's text sink and a Python data source to read.

Writing: a record is one string, and records end with two line breaks, so the
text sink with that separator writes valid WARC files to any file system.  Of
equal payloads one is kept as a response, the others become revisit records.

Reading: the planner makes a partition of each file.  A task parses a
record's headers first; pushed-down predicates on the record type and other
header columns are settled there, and the block of a record that is not
wanted is skipped without decoding it.  The option ``payload`` set to
``false`` skips all blocks.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator
from posixpath import basename

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringStartsWith,
)

from riskloom.llm.common import broadcast_if_small, table
from riskloom.sources.storage import fresh_path, materialise

SEPARATOR = "\r\n\r\n"
ID_PREFIX = "urn:riskloom:page:"
DATE = "1970-01-01T00:00:00Z"
MIN_PAYLOAD = 0
BATCH_BYTES = 4 << 20
SCHEMA = (
    "record_type string, record_id string, target_uri string, page_id long, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary"
)
_ARROW = pa.schema([
    ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


# ------------------------------------------------------------------- writing
def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32, five bytes at a time."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    """A header line; nothing for null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """One WARC record (column ``value``) per input row, without its separator.

    Of equal payloads of ``min_payload`` bytes or more, the rows with the
    largest id are responses (repeated rows all), the others revisits; smaller
    payloads are all responses.  A null payload is empty; a null id revisits a
    row with an id, if there is one; other columns are ignored.
    """
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    # SHA-1 can be made to collide, so size and a second hash must agree as well.
    same = ["digest", "size", "check"]
    rows = rows.withColumn("check", F.xxhash64("html"))
    latest = rows.where(F.col("size") >= min_payload).groupBy(*same).agg(F.max("page_id").alias("latest"), F.count("*").alias("rows"))
    latest = materialise(latest.where("rows > 1 and latest is not null").drop("rows"), "warc-repeats")
    rows = rows.join(broadcast_if_small(latest), same, "left")
    again = F.coalesce(F.col("latest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("latest"))), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(SEPARATOR))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20")
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
            _header("WARC-Record-ID", F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
            _header("WARC-Date", F.lit(DATE)),
            _header("WARC-Target-URI", url),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            _header("X-Payload-Length", F.col("size")),
            _header("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _header("WARC-Refers-To", F.when(again, F.concat(F.lit(f"<{ID_PREFIX}"), F.col("latest").cast("string"), F.lit(">")))),
            _header("Content-Type", F.lit("application/http; msgtype=response")),
            _header("Content-Length", F.octet_length(block)),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", **options) -> None:
    """Write ``pages`` as WARC files; ``options`` as of ``record_texts``.  Without
    compression ("none") readers seek past blocks that they do not want."""
    record_texts(pages, **options).write.option("lineSep", SEPARATOR).option("compression", compression).text(path)


# ------------------------------------------------------------------- reading
def _number(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix(ID_PREFIX)
    return int(text) if text.lstrip("-").isdigit() else None


def _columns(headers: dict[str, str]) -> dict:
    record = headers.get("warc-record-id")
    length = headers.get("x-payload-length")
    return {
        "record_type": headers.get("warc-type"), "record_id": record, "target_uri": headers.get("warc-target-uri"), "page_id": _number(record),
        "payload_digest": (headers.get("warc-payload-digest") or "").rpartition(":")[2] or None, "payload_bytes": int(length) if length else None,
        "refers_to": _number(headers.get("warc-refers-to")),
    }


_TESTS = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v,
    StringStartsWith: lambda x, v: x.startswith(v),
}


def _supported(test: Filter) -> bool:
    if isinstance(test, Not):
        return _supported(test.child)
    return isinstance(test, (*_TESTS, IsNull, IsNotNull)) and len(test.attribute) == 1 and test.attribute[0] in _ARROW.names[:-1]


def _holds(test: Filter, row: dict) -> bool | None:
    """Three-valued, as in SQL."""
    if isinstance(test, Not):
        inner = _holds(test.child, row)
        return None if inner is None else not inner
    value = row[test.attribute[0]]
    if isinstance(test, (IsNull, IsNotNull)):
        return (value is None) == isinstance(test, IsNull)
    return None if value is None else _TESTS[type(test)](value, test.value)


def records(stream: io.BufferedIOBase, tests: Iterable[Filter] = (), payload: bool = True) -> Iterator[dict]:
    """The wanted records of a stream; blocks of others are passed over unread."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        row = _columns(headers)
        length = int(headers.get("content-length", 0))
        if not all(_holds(t, row) for t in tests):
            stream.seek(length, io.SEEK_CUR)
            continue
        if payload:
            block = stream.read(length)
            http = headers.get("content-type", "").startswith("application/http")
            row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
        else:
            stream.seek(length, io.SEEK_CUR)
            row["payload"] = None
        yield row


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            if _supported(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        system, path = _located(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        names = sorted(x.path for x in found if x.type == fs.FileType.File and x.size and not basename(x.path).startswith(("_", ".")))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        return [_File(prefix + n) for n in names] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, path = _located(partition.path)
        rows, held = [], 0
        with system.open_input_file(path) as raw:
            buffered = io.BufferedReader(raw, 1 << 20)
            stream = _Forward(io.BufferedReader(gzip.GzipFile(fileobj=buffered), 1 << 20)) if path.endswith(".gz") else buffered
            for row in records(stream, self.tests, self.payload):
                rows.append(row)
                held += 200 + len(row["payload"] or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class _Forward:
    """A zipped stream, which seeks forward by passing over bytes, in small steps."""

    def __init__(self, stream: io.BufferedReader):
        self.readline, self.read = stream.readline, stream.read

    def seek(self, size: int, _whence: int) -> None:
        while size > 0:
            part = self.read(min(size, 1 << 20))
            if not part:
                raise EOFError("a record is cut off")
            size -= len(part)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload`` = false reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the files under ``path``, with predicate push-down, for
    which this turns the session's setting on (the reader needs it)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    read, whole = read_archives(spark, path), F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(~whole, F.col("refers_to")).alias("refers_to"),
    )
