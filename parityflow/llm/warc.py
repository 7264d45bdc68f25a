"""WARC files as a Spark data source, read and written.

``spark.read.format("warc")`` plans whole files: small ones share a partition up to ``partitionBytes``,
the largest come first. A record's header is parsed first; predicates on header columns are pushed
into the scan and tested on it, and the payload of a record that fails them is neither decoded nor,
where its length is known, read: plain files are skipped by Content-Length, compressed ones by the
``sl`` field of their gzip members (other members are inflated without being kept). With
``payload=false`` every payload is skipped that way. A header says its length, so a broken record
raises an error that names file and offset instead of being passed over.

``df.write.format("warc")`` writes one record a row, each its own gzip member (``compression=none``
for plain files). Tasks write under a staging folder; the job's commit moves the files of the
attempts that count, so repeated or lost attempts leave nothing behind.

Columns: ``record_id, record_type, target_uri, date, refers_to, payload_digest, payload_length,
payload``; reading adds ``headers`` (all named fields) and ``file``. Null columns are left out of the
header. A null payload is written as an empty one. Revisits have no payload of their own; their digest and length
are those of the record they refer to. Line breaks in header values become spaces. An empty table
gives a folder without records; repeated rows give repeated records.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from parityflow.session import materialised, shared_dir

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_length long, payload binary, headers map<string,string>, file string"
)
# Named fields of the format, by column
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: profile of such revisits
PAYLOAD_LENGTH = "X-Payload-Length"  #: an extension field, so that a revisit tells the length of what it stands for

PARTITION_BYTES = 128 << 20
FILE_BYTES = 1 << 30  #: a task begins a new file behind this size
CHUNK = 64 << 10
BATCH_BYTES = 4 << 20  #: payload of a batch handed to Spark


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of a plain path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """WARC files under ``path`` and their sizes; names that begin with a dot or underscore are not part of the data."""
    system, root = _place(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    visible = (f for f in found if f.type == fs.FileType.File and not re.search(r"/[._]", f.path[len(root) :]))
    start = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((start + f.path, f.size) for f in visible if f.base_name.endswith((".warc", ".warc.gz")))


class Plain:
    """Records of an uncompressed file."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.at = io.BufferedReader(_Raw(stream), CHUNK), size, 0

    def header(self) -> bytes | None:
        """The next record's header, or None at the end."""
        if self.at >= self.size:
            return None
        self.stream.seek(self.at)
        lines = []
        while (line := self.stream.readline()).strip():
            lines.append(line)
        if not line:
            raise ValueError(f"the record at {self.at} has no end of its header")
        self.at += sum(map(len, lines)) + len(line)
        return b"".join(lines)

    def block(self, length: int) -> bytes:
        self.stream.seek(self.at)
        data = self.stream.read(length)
        if len(data) < length:
            raise ValueError(f"the record at {self.at} is cut off")
        self.at += length + 4
        return data

    def skip(self, length: int) -> None:
        self.at += length + 4


class _Raw(io.RawIOBase):
    """A seekable raw stream over a file of ``pyarrow.fs``."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def seekable(self):
        return True

    def readinto(self, buffer):
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, at, whence=0):
        return self.stream.seek(at, whence)

    def tell(self):
        return self.stream.tell()


class Zipped:
    """Records of a file of gzip members, one record each."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.at = io.BufferedReader(_Raw(stream), CHUNK), size, 0

    def header(self) -> bytes | None:
        if self.at >= self.size:
            return None
        self.stream.seek(self.at)
        head = self.stream.peek(20)[:20]
        self.member = None
        if len(head) == 20 and head[3] & 4 and head[12:16] == b"sl\x08\x00":
            self.member = struct.unpack("<I", head[16:20])[0]
        self.inflate, self.raw = zlib.decompressobj(31), 0
        self.waiting = b""
        data = b""
        while b"\r\n\r\n" not in data:
            more = self._more(4096)
            if not more:
                raise ValueError(f"the record at {self.at} has no end of its header")
            data += more
        head, _, self.rest = data.partition(b"\r\n\r\n")
        return head

    def _more(self, most: int) -> bytes:
        while not self.inflate.eof:
            if not self.waiting:
                self.waiting = self.stream.read(CHUNK if self.member is None else min(CHUNK, self.member - self.raw))
                self.raw += len(self.waiting)
                if not self.waiting:
                    return b""
            out = self.inflate.decompress(self.waiting, most)
            self.waiting = self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def _finish(self) -> None:
        self.at += self.raw - len(self.inflate.unused_data)

    def block(self, length: int) -> bytes:
        parts, held = [self.rest], len(self.rest)
        while more := self._more(1 << 20):
            parts.append(more)
            held += len(more)
        if not self.inflate.eof:
            raise ValueError(f"the record at {self.at} is cut off")
        self._finish()
        return b"".join(parts)[:length]

    def skip(self, length: int) -> None:
        if self.member is not None:
            self.at += self.member
            return
        while self._more(1 << 20):
            pass
        self._finish()


def parsed(head: bytes) -> dict[str, str]:
    """Named fields of a header; folded lines are joined, the last of several equal names counts."""
    version, _, rest = head.partition(b"\n")
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a record: {version[:40]!r}")
    named, last = {}, None
    for line in rest.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and last:
            named[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            named[last] = value.strip()
    return named


def record_columns(named: dict[str, str]) -> dict[str, str | None]:
    """The header columns of a record."""
    folded = {k.lower(): v for k, v in named.items()}
    found = {column: folded.get(name.lower()) for column, name in FIELDS.items()}
    for column in ("record_id", "target_uri", "refers_to"):
        if (v := found[column]) and v.startswith("<") and v.endswith(">"):
            found[column] = v[1:-1]
    return found


def payload_of(block: bytes, kind: str | None) -> bytes:
    """The entity of an HTTP message, or the whole block of other content."""
    if kind and kind.lower().replace(" ", "").startswith("application/http"):
        head, mark, body = block.partition(b"\r\n\r\n")
        return body if mark else b""
    return block


#: predicates that are tested on a header, each as a function of its value and the literal
TESTS = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
    GreaterThan: lambda v, x: v.encode() > x.encode(),
    GreaterThanOrEqual: lambda v, x: v.encode() >= x.encode(),
    LessThan: lambda v, x: v.encode() < x.encode(),
    LessThanOrEqual: lambda v, x: v.encode() <= x.encode(),
    IsNotNull: lambda v, x: True,
}


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(self.files)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in FIELDS and type(f) in TESTS:
                self.tests.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        out, size = [Files()], 0
        for f in sorted(listed(self.path), key=lambda f: (-f[1], f[0])):
            if out[-1].files and size + f[1] > self.most:
                out.append(Files())
                size = 0
            out[-1].files.append(f)
            size += f[1]
        return out

    def wanted(self, columns: dict[str, str | None]) -> bool:
        return all(columns[c] is not None and TESTS[kind](columns[c], x) for c, kind, x in self.tests)

    def records(self, path: str, size: int) -> Iterator[tuple]:
        system, inner = _place(path)
        with system.open_input_file(inner) as stream:
            reader = Zipped(stream, size) if path.endswith(".gz") else Plain(stream, size)
            while (head := reader.header()) is not None:
                named = parsed(head)
                length = int(next(v for k, v in named.items() if k.lower() == "content-length"))
                columns = record_columns(named)
                if not self.wanted(columns):
                    reader.skip(length)
                    continue
                payload = None
                if not self.payload or columns["record_type"] == "revisit":
                    reader.skip(length)
                else:
                    kind = next((v for k, v in named.items() if k.lower() == "content-type"), None)
                    payload = payload_of(reader.block(length), kind)
                told = named.get(PAYLOAD_LENGTH)
                measured = len(payload) if payload is not None else int(told) if told else None
                yield (*columns.values(), measured, payload, list(named.items()), path)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.string()]
        names = [*FIELDS, "payload_length", "payload", "headers", "file"]
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for path, size in partition.files:
            for row in self.records(path, size):
                rows.append(row)
                held += len(row[7] or b"") + 1000
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def record(row: dict) -> bytes:
    """A row as a record."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    revisit = kind == "revisit"
    http = kind in ("response", "revisit")
    digest = row.get("payload_digest") or "sha256:" + hashlib.sha256(payload).hexdigest()
    length = row.get("payload_length") if row.get("payload_length") is not None else len(payload)
    block = b""
    if http:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if not revisit:
        block += payload
    bracket = {c: f"<{row[c]}>" for c in ("record_id", "refers_to") if row.get(c) is not None}
    named = {c: row.get(c) for c in FIELDS} | {"record_type": kind, "payload_digest": digest} | bracket
    lines = ["WARC/1.1", *(f"{FIELDS[c]}: {_one_line(v)}" for c, v in named.items() if v is not None)]
    if revisit:
        lines.append(f"WARC-Profile: {IDENTICAL}")
    lines.append(f"Content-Type: {'application/http; msgtype=response' if http else 'application/octet-stream'}")
    lines += [f"{PAYLOAD_LENGTH}: {length}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose ``sl`` field tells its own length and that of ``data``, so that readers can step over it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    if size >= 1 << 32 or len(data) >= 1 << 32:  # the field cannot tell such lengths
        head = b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff"
    else:
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.zipped = options.get("compression", "gzip") != "none"
        self.level = int(options.get("level", 1))
        self.most = int(options.get("fileBytes", FILE_BYTES))
        self.job = uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, staging = _place(self.staging)
        system.create_dir(staging, recursive=True)
        attempt, files, out, size = TaskContext.get().taskAttemptId(), [], None, 0
        try:
            for batch in iterator:
                for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        files.append(f"{self.job}-{attempt:08d}-{len(files):04d}.warc{'.gz' * self.zipped}")
                        out, size = system.open_output_stream(f"{staging}/{files[-1]}", compression=None), 0
                    data = record(row)
                    size += out.write(member(data, self.level) if self.zipped else data) or 0
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        _, staging = _place(self.staging)
        system.create_dir(root, recursive=True)
        old = [f for f, _ in listed(self.path)] if self.overwrite else []
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{staging}/{name}", f"{root}/{name}")
        for f in old:
            system.delete_file(_place(f)[1])
        self._clear(system, staging)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.staging))

    def _clear(self, system: fs.FileSystem, staging: str) -> None:
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take predicates."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    register(records.sparkSession)
    records.write.format("warc").option("compression", compression).mode("append").save(path)


LEAST_REVISITED = 100  #: bytes of a payload from which equal ones are written once


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as records to be written: of equal payloads of ``LEAST_REVISITED`` bytes or more, the smallest id is the response.

    Pages without an id are responses, as are all rows that share the smallest id. What repeats is
    found on digests alone; the table of repeated digests is written first, so that its measured
    size decides whether it is broadcast to the pages or the pages are dealt by digest.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("id"), F.col(f"`{url}`").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = (F.octet_length("payload") >= LEAST_REVISITED) & F.col("id").isNotNull()
    digests = rows.filter(long_enough).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = materialised(digests.filter("n > 1").select("digest", "first"))
    joined = rows.join(repeated, (rows["digest"] == repeated["digest"]) & long_enough, "left").drop(repeated["digest"])
    again = F.col("first") < F.col("id")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        name(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.when(again, name(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC files under ``path`` (a new folder of the shared one, if none is named) and read them back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), path)
    return read_warc(spark, path)
