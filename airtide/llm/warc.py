"""WARC archives as a PySpark Python data source, read and written.

``register(spark)`` makes ``spark.read.format("warc")`` and ``df.write.format("warc")`` known. Files are plain
(``compression=none``) or have one gzip member for each record. Members carry their length in an "SL" extra field, so
that a reader skips an unwanted payload without decoding it; archives without that field, and members that hold several
records, are read as well.

Reading plans partitions of whole files, small ones together up to ``partition_bytes``. Predicates on the record type and
on headers are pushed down to the reader: a record's headers are parsed first, and its payload is decoded only if they
pass and the asked-for schema has the column ``payload``. ``read(spark, path, ("record_type", "=", "response"))`` pushes
them as an option of the table. Spark's own push-down keeps what it pushed with the table and not with the scan, so that
two scans of one DataFrame both get the filters of the last (seen with 4.1.2); it is used only with the option
``single_scan=true``, for a DataFrame that is scanned once.

Writing makes files of up to ``file_bytes`` under a temporary name in each task, which the commit renames; a task that is
repeated after a lost executor leaves no second copy, and an abort removes what was written.

Defined results: a null payload is written empty. An empty table gives an archive folder without records. Columns other
than those of ``WRITE_COLUMNS`` are ignored. In foreign archives header lines that are none are left out, a digest or
length that cannot be read is null, and after a record without a length reading goes on at the next line that begins one.
Of pages with equal payloads, those that share the largest page_id are responses; a null page_id is below all others.
"""

from __future__ import annotations

import base64
import binascii
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import HOT_KEYS, stored, workspace

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, "
    "refers_to string, content_length long, payload_length long, payload binary"
)
WRITE_COLUMNS = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload_length", "payload")
#: Payloads from this length on are stored once.
REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the formats.
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = b"\x1f\x8b\x08"
_BEGIN = re.compile(rb"(?:\A|\n)(?=WARC/[0-9.]+)")
_BLOCK = 1 << 16
#: Bits of the filter by which pages whose payload nobody shares stay out of a join; it is broadcast as 2**22 / 64 rows at most.
FILTER_BITS = 1 << 22


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with its own length and that of its content in an SL field."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    whole = 10 + 2 + 12 + len(packed) + 8
    if whole >= 1 << 32 or len(data) >= 1 << 32:
        return _GZIP + b"\0\0\0\0\0\0\xff" + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"SL" + struct.pack("<HII", 8, whole, len(data))
    return _GZIP + b"\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data))


def record(kind: str, record_id: str, uri: str | None, digest: str | None, refers_to: str | None, length: int | None, payload: bytes | None) -> bytes:
    """One WARC record. ``digest`` is hexadecimal SHA-1. A revisit keeps the HTTP headers and leaves the payload out."""
    payload = b"" if kind == "revisit" or payload is None else payload
    block = _HTTP % (len(payload) if length is None else length) + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if digest is not None:
        head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):  # a folded line
            if name:
                found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
        else:
            name = ""
    return found


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


class _Plain:
    """Content of a file without compression, from the current place on."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.held = file, b""

    def upto_blank(self) -> bytes | None:
        """The bytes before the next empty line; None at the end."""
        at = -1
        while (at := self.held.find(b"\r\n\r\n", max(0, at))) < 0:
            more = self.file.read(_BLOCK)
            if not more:
                return None
            at = len(self.held) - 3
            self.held += more
        head, self.held = self.held[:at], self.held[at + 4 :]
        return head

    def take(self, n: int) -> bytes:
        parts = [self.held[:n]]
        self.held, n = self.held[n:], n - len(parts[0])
        if n > 0:
            parts.append(self.file.read(n))
        return b"".join(parts)

    def leave(self, n: int) -> None:
        """Go on behind the next n bytes, the rest of a record."""
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.held))
            self.held = b""


class _Members:
    """Content of a file of gzip members, each of one record or more."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.raw, self.begin = file, b"", 0
        self._open()

    def _open(self) -> bool:
        """Begin with the member that stands next; whether there is one."""
        if len(self.raw) < 24:
            self.raw += self.file.read(24 - len(self.raw))
        head = self.raw[:24]
        sized = len(head) == 24 and head[3] == 4 and head[12:14] == b"SL"
        self.length, self.size = struct.unpack("<II", head[16:24]) if sized else (None, None)
        self.inflate, self.held, self.read = zlib.decompressobj(31), b"", 0
        return bool(head)

    def _more(self) -> bool:
        """Inflate some more of the member; whether there was any."""
        if self.inflate.eof:
            return False
        data = self.raw or self.file.read(_BLOCK if self.length is None else min(_BLOCK, max(1, self.begin + self.length - self.file.tell())))
        self.raw = b""
        if not data:
            return False
        self.held += self.inflate.decompress(data)
        self.raw = self.inflate.unused_data
        return True

    def _follow(self) -> bool:
        """Go to the next member once this one is used up."""
        self.begin = self.file.tell() - len(self.raw)
        return self._open()

    def upto_blank(self) -> bytes | None:
        at = 0
        while (at := self.held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.held) - 3)
            if not self._more():
                if not self._follow():
                    return None
                at = 0
        head, self.held = self.held[:at], self.held[at + 4 :]
        self.read += at + 4
        return head

    def take(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n:
            self.held = b""
            if not self._more():
                break
            parts.append(self.held)
            size += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        self.read += min(n, len(whole))
        return whole[:n]

    def leave(self, n: int) -> None:
        if self.size is not None and self.read + n >= self.size:  # by the length that the member states, without inflating the rest
            self.begin += self.length
            self.file.seek(self.begin)
            self.raw = b""
            self._open()
            return
        while n > 0:
            if not self.held and not self._more():
                return
            part = min(n, len(self.held))
            self.held, self.read, n = self.held[part:], self.read + part, n - part


_FIELD = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}


def _value(head: dict[str, str], column: str) -> str | int | None:
    if column == "content_length":
        return _number(head.get("content-length"))
    got = head.get(_FIELD[column])
    if column == "payload_digest" and got is not None:
        name, _, code = got.partition(":")
        try:
            return base64.b32decode(code.upper()).hex() if name.lower() == "sha1" and len(code) == 32 else code.lower()
        except binascii.Error:
            return None
    return got


def records(file: pa.NativeFile, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(headers, payload length, payload) of the records whose headers pass ``wanted``."""
    start = file.read(3)
    file.seek(0)
    source = _Members(file) if start == _GZIP else _Plain(file)
    while (top := source.upto_blank()) is not None:
        begin = _BEGIN.search(top)
        if begin is None:  # what stands between records
            continue
        head = _headers(top[begin.end() :])
        n = _number(head.get("content-length"))
        if not wanted(head):
            source.leave((n or 0) + 4 * (n is not None))
            continue
        http, stated, used, data = head.get("content-type", "").startswith("application/http"), n or 0, 0, None
        if http and n:
            inner = source.upto_blank() or b""
            used = len(inner) + 4
            stated = _number(_headers(inner).get("content-length"))
            stated = n - used if stated is None else stated
        if with_payload:
            data, used = source.take((n or 0) - used), n or 0
            stated = stated if http else len(data)
        yield head, stated, data
        source.leave((n or 0) - used + 4 * (n is not None))


#: Tests of a header's value by the name of a comparison; a header that is absent passes none.
_TESTS = {
    "=": lambda v, x: v == x, "in": lambda v, x: v in x, "prefix": lambda v, x: v.startswith(x), ">": lambda v, x: v > x, ">=": lambda v, x: v >= x,
    "<": lambda v, x: v < x, "<=": lambda v, x: v <= x, "present": lambda v, x: True,
}
_NAMES = {EqualTo: "=", In: "in", StringStartsWith: "prefix", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "present"}
Predicate = tuple[str, str, object]


def _passes(predicates: list[Predicate]):
    def passes(head: dict[str, str]) -> bool:
        return all((v := _value(head, column)) is not None and _TESTS[test](v, x) for column, test, x in predicates)

    return passes


@dataclass
class WarcPartition(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.filters: list[Predicate] = [(c, t, x) for c, t, x in json.loads(options.get("filters", "[]"))]
        if odd := [f for f in self.filters if not self._able(f[0]) or f[1] not in _TESTS]:
            raise ValueError(f"predicates that headers cannot answer: {odd}")
        self.single = options.get("single_scan", "false") == "true"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))

    @staticmethod
    def _able(column: str) -> bool:
        return column in _FIELD or column == "content_length"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if self.single and type(f) in _NAMES and len(f.attribute) == 1 and self._able(f.attribute[0]):
                self.filters.append((f.attribute[0], _NAMES[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[WarcPartition]:
        system, path = filesystem(self.path)
        info = system.get_file_info(path)
        every = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        found = sorted((x.path, x.size) for x in every if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and ".warc" in x.base_name)
        out: list[WarcPartition] = []
        held = self.partition_bytes
        for name, size in found:
            if held + size > self.partition_bytes:
                out.append(WarcPartition([]))
                held = 0
            out[-1].files.append(name)
            held += size
        return out or [WarcPartition([])]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        schema = to_arrow_schema(self.schema)
        wanted, payload = _passes(self.filters), "payload" in schema.names
        rows: list[list] = []
        held = 0
        for name in partition.files:
            with system.open_input_file(name) as file:
                for head, length, data in records(file, wanted, payload):
                    rows.append([data if c == "payload" else length if c == "payload_length" else _value(head, c) for c in schema.names])
                    held += 500 + len(data or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = filesystem(self.path)
        folder = f"{path}/_temporary-{self.job}"
        system.create_dir(folder)
        files: list[str] = []
        out = None
        for batch in iterator:
            for row in zip(*(batch.column(n).to_pylist() for n in WRITE_COLUMNS)):
                if out is None:
                    files.append(f"{folder}/{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out = system.open_output_stream(files[-1], compression=None)
                data = record(*row)
                out.write(member(data) if self.gzip else data)
                if out.tell() >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = filesystem(self.path)
        if self.overwrite:
            old = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
            for x in old:
                if x.type == fs.FileType.File and ".warc" in x.base_name:
                    system.delete_file(x.path)
        system.create_dir(path)
        for message in messages:
            for name in message.files if message else []:
                system.move(name, f"{path}/{os.path.basename(name)}")
        self._clear(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        folder = f"{path}/_temporary-{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        missing = set(WRITE_COLUMNS) - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read(spark: SparkSession, path: str, *predicates: Predicate) -> DataFrame:
    """The records whose headers pass all predicates (column, one of ``=``, ``in``, ``prefix``, ``>``, ``>=``, ``<``, ``<=``, ``present``, value)."""
    register(spark)
    return spark.read.format("warc").option("filters", json.dumps(predicates)).load(path)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Rows to write: of equal payloads of ``REVISIT_BYTES`` or more, the one with the largest page_id is response, the others revisit it."""
    rows = pages.select("page_id", F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumns(
        {"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    # Which pages share a payload is found by digests alone. Payloads only move where their digest may be shared and is not hot.
    groups = rows.where(F.col("payload_length") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    shared = stored(groups.where("n > 1"), "warc-shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(1, total // HOT_KEYS)  # fewer than HOT_KEYS digests
    slot = F.pmod(F.xxhash64("payload_digest"), F.lit(FILTER_BITS))
    cells = shared.where(~hot).select(slot.alias("s")).distinct().groupBy(F.floor(F.col("s") / 64).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    marked = rows.withColumn("s", slot).withColumn("cell", F.floor(F.col("s") / 64)).join(F.broadcast(cells), "cell", "left")
    marked = marked.join(F.broadcast(shared.where(hot).select("payload_digest", F.struct("kept").alias("hot"))), "payload_digest", "left")
    may = F.coalesce(F.expr("shiftrightunsigned(bits, cast(s % 64 as int)) & 1 = 1"), F.lit(False)) & (F.col("payload_length") >= REVISIT_BYTES) & F.col("hot").isNull()
    names = ["page_id", "url", "payload", "payload_length", "payload_digest"]
    long = F.col("payload_length") >= REVISIT_BYTES
    near = marked.where(~may).select(*names, F.when(long, F.col("hot.kept")).alias("kept"), (F.col("hot").isNotNull() & long).alias("shared"))
    far = marked.where(may).select(*names).join(shared.where(~hot).select("payload_digest", "kept", F.lit(True).alias("shared")), "payload_digest", "left")
    joined = near.unionByName(far.withColumn("shared", F.coalesce("shared", F.lit(False))))
    again = F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("kept"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"),
        "payload_digest", F.when(again, name(F.col("kept"))).alias("refers_to"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_table(pages: DataFrame) -> DataFrame:
    """The contract's digest: write every page, then read the archives back."""
    spark = pages.sparkSession
    register(spark)
    path = workspace(spark, "warc")
    records_of_pages(pages).write.format("warc").mode("append").save(path)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    back = spark.read.format("warc").load(path)
    full = F.col("record_type") == "response"
    return back.select(
        page(F.col("record_id")).alias("page_id"), F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"),
        F.col("target_uri").alias("url"),
    )


def archive_sql() -> str:
    """The same for DuckDB."""
    return f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE octet_length(b) >= {REVISIT_BYTES} GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to, url
FROM p LEFT JOIN g USING (payload_digest)"""
