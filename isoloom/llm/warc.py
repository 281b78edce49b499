"""WARC archives as a PySpark data source, and pages written with revisit records for equal payloads.

Reading: the driver plans one partition per file. Filters on the record type and on header columns are
pushed into the reader, which parses a record's headers first; the payload of a record that is filtered
out, or whose payload nobody asked for, is neither decoded nor, where the archive says how long its
compressed members are, inflated.

Writing: a task streams its rows into archives of its own, one gzip member per record, each member with
the "sl" field that gives its length. Only the names that tasks report are committed, to a manifest of each
write, so archives left by lost or repeated tasks are never read, and appended writes add to those before.

Paths may have any scheme that Arrow knows (s3a and s3n are read as s3); :func:`write_pages` and :func:`read_pages` complete a path
without one from the cluster's default file system. An archive is read as a stream; a record is held whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from isoloom.shared import materialise

MANIFEST = "_archives-"
_FROM_HEADER = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
COLUMNS = {**dict.fromkeys(_FROM_HEADER, pa.string()), "content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}
SCHEMA = ", ".join([*(f"{c} string" for c in _FROM_HEADER), "content_length long, payload_length long, payload binary"])
_MEMBER = struct.Struct("<2sBBIBBH2sHII")  # gzip header with FEXTRA and its one subfield
_ROLL = 256 << 20


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = path.partition(":/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest) if colon else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of the cluster's default file system where it has none."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path if ":/" in path else name.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(name).toString()


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member whose header says how long it is, compressed and not."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record, which has the HTTP headers of the response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url and url.strip() else []), f"WARC-Payload-Digest: sha1:{sha1}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            found[name := name.strip().lower()] = value.strip()
    return found


class _Stream:
    """Records of one archive, plain or gzip: headers are given first, blocks only when asked for."""

    def __init__(self, source, step: int = 1 << 20):
        self.source, self.step, self.data, self.at = source, step, b"", 0

    def held(self) -> int:
        return len(self.data) - self.at

    def more(self, n: int = 0) -> bool:
        raw = self.source.read(max(self.step, n))
        self.data, self.at = self.data[self.at :] + raw, 0
        return bool(raw)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def _need(self, n: int) -> bool:
        while self.held() < n:
            if not self.more(n - self.held()):
                return False
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
        while self._need(2) or self.held():
            if self.data.startswith(b"\x1f\x8b", self.at):
                yield from self._gzip()
            elif self.data[self.at] in b"\r\n":
                self.at += 1
            else:
                yield from self._plain()

    def _plain(self) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
        while (end := self.data.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                raise ValueError("an archive ends inside a record's headers")
        head = _headers(self.take(end - self.at))
        self.at += 4
        n, read = int(head["content-length"]), []

        def block() -> bytes:
            if not self._need(n):
                raise ValueError("an archive ends inside a record")
            read.append(True)
            return self.take(n)

        yield head, block
        if not read:
            self._pass(n)

    def _pass(self, n: int) -> None:
        here = min(n, self.held())
        self.at, n = self.at + here, n - here
        if n and self.source.seekable():
            self.source.seek(self.source.tell() + n)
        while n and not self.source.seekable() and (raw := self.source.read(min(n, self.step))):
            n -= len(raw)

    def _gzip(self) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
        size = 0
        if self._need(_MEMBER.size):
            *_, flags, _, _, _, extra, name, n, size, _ = _MEMBER.unpack_from(self.data, self.at)
            size = size if flags == 4 and extra == 12 and name == b"sl" and n == 8 else 0
        if size and self._need(size):  # one member, its length known
            whole = self.take(size)
            inflate = zlib.decompressobj(-15)
            start = inflate.decompress(whole[_MEMBER.size :], 1 << 12)
            while b"\r\n\r\n" not in start and inflate.unconsumed_tail:
                start += inflate.decompress(inflate.unconsumed_tail, 1 << 12)
            head, _, body = start.partition(b"\r\n\r\n")
            head = _headers(head)
            yield head, lambda: (body + inflate.decompress(inflate.unconsumed_tail))[: int(head["content-length"])]
        else:
            yield from _Stream(_Member(self))


class _Member:
    """The inflated bytes of the gzip member that comes next in ``outer``."""

    def __init__(self, outer: _Stream):
        self.outer, self.inflate = outer, zlib.decompressobj(31)

    def seekable(self) -> bool:
        return False

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                if not self.outer.held() and not self.outer.more():
                    raise ValueError("an archive ends inside a compressed record")
                raw = self.outer.take(self.outer.held())
            out.append(self.inflate.decompress(raw, n))
            n -= len(out[-1])
            if self.inflate.eof:  # what follows is the next member
                self.outer.data, self.outer.at = self.inflate.unused_data, 0
        return b"".join(out)


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.verify = options.get("verify", "false").lower() == "true"
        self.wanted: dict[str, list[set]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in _FROM_HEADER and isinstance(f, EqualTo):
                self.wanted.setdefault(column, []).append({f.value})
            elif column in _FROM_HEADER and isinstance(f, In):
                self.wanted.setdefault(column, []).append(set(f.value))
            elif column in _FROM_HEADER and isinstance(f, IsNotNull):
                self.wanted.setdefault(column, [])
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _filesystem(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [_File(self.path)]
        names = [i.path.rpartition("/")[2] for i in system.get_file_info(fs.FileSelector(path))]
        if manifests := [n for n in names if n.startswith(MANIFEST)]:
            names = []
            for m in manifests:
                with system.open_input_stream(f"{path}/{m}") as f:
                    names += json.loads(f.read())
        return [_File(f"{self.path.rstrip('/')}/{n}") for n in sorted(names) if n.endswith((".warc", ".warc.gz"))] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, COLUMNS[c]) for c in self.columns])
        rows: list[list] = []
        held = 0
        if partition.path:
            system, path = _filesystem(partition.path)
            with system.open_input_file(path) as source:
                for head, block in _Stream(source):
                    row = self._row(head, block)
                    if row is not None:
                        rows.append(row)
                        held += 200 + sum(len(x) for x in row if isinstance(x, bytes))
                    if held > 16 << 20:
                        yield self._batch(rows, schema)
                        rows, held = [], 0
        yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def _row(self, head: dict[str, str], block) -> list | None:
        values: dict = {c: head.get(h) for c, h in _FROM_HEADER.items()}
        for column, sets in self.wanted.items():
            if values[column] is None or any(values[column] not in s for s in sets):
                return None
        values["content_length"] = int(head["content-length"])
        if self.verify or {"payload", "payload_length"} & set(self.columns):
            http = "application/http" in head.get("content-type", "")
            revisit = values["record_type"] == "revisit"
            start, _, body = block().partition(b"\r\n\r\n") if http else (b"", b"", block())
            values["payload"] = None if revisit else body
            values["payload_length"] = int(_headers(start).get("content-length", 0)) if revisit else len(body)
            if self.verify and not revisit and values["payload_digest"] not in (None, f"sha1:{digest(body)}"):
                raise ValueError(f"payload of {values['record_id']} doesn't have its digest")
        return [values.get(c) for c in self.columns]


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (page_id, url, html, payload_sha1 in hexadecimal, refers_to).

    Appended writes keep what is there; with ``overwrite`` the archives committed before are taken out after the commit.
    """

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.date, self.overwrite = options["path"], options.get("date", "1970-01-01T00:00:00Z"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = _filesystem(self.path)
        names, out, size = [], None, 0
        for b in iterator:
            columns = [b.column(n) for n in ("page_id", "url", "html", "payload_sha1", "refers_to")]
            for page_id, url, html, sha1, refers_to in zip(*columns, strict=True):
                if out is None or size > _ROLL:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    system.create_dir(path, recursive=True)
                    out, size = system.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                payload = (html.as_py() or "").encode("utf-8", "replace")
                name = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                data = member(record(page_id.as_py(), url.as_py(), payload, name, refers_to.as_py(), self.date))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        old = [i.path for i in system.get_file_info(fs.FileSelector(path)) if i.path.rpartition("/")[2].startswith(MANIFEST)] if self.overwrite else []
        with system.open_output_stream(f"{path}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for manifest in old:
            with system.open_input_stream(manifest) as f:
                names = json.loads(f.read())
            system.delete_file(manifest)
            for n in names:
                system.delete_file(f"{path}/{n}")

    def abort(self, messages: list) -> None:
        system, path = _filesystem(self.path)
        for n in (n for m in messages if m for n in m.names):
            system.delete_file(f"{path}/{n}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; ask for fewer columns with ``.schema(...)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """One record per row of ``pages(page_id, url, html)``, html in UTF-8 as payload (null: empty).

    Of the records with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is
    a response, the others revisit it; smaller payloads are all responses. Rows that repeat the smallest
    page_id are all responses. A null or blank url leaves its header out; a null page_id has an empty name and comes back
    null. An empty table leaves no archive. Pages already committed to ``path`` stay; other columns aren't read.
    """
    register(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("payload_sha1", F.sha1(F.encode("html", "utf-8")))
    large = rows.where(F.octet_length("html") >= least_bytes)
    first = large.groupBy("payload_sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_sha1", "first")
    # Written first, so that adaptive execution can split the pages of a payload that very many have.
    rows = rows.join(materialise(first, "responses"), "payload_sha1", "left")
    refers = F.when((F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows.select("page_id", "url", "html", "payload_sha1", refers.alias("refers_to")).write.format("warc").mode("append").save(qualified(pages.sparkSession, path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records written by :func:`write_pages`: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads of responses are decoded and checked against their digests; of revisits only the headers are read.
    An empty archive, as of an empty table, has no rows. Payloads are whole, however long; repeated pages are records of their own.
    """
    register(spark)
    records = spark.read.format("warc").schema(SCHEMA.rpartition(",")[0]).option("verify", "true").load(qualified(spark, path))
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1).try_cast("long")
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.expr("substr(payload_digest, 6)").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )
