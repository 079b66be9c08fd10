"""WARC as a Python data source: writer and reader.

Writer: archives of at most ``ROLL`` bytes and a record, so that a reader can deal
them out; one gzip member per record. A member's extra field
(``WL``) holds its length, so a reader steps over records without inflating them;
other tools ignore it. Archives have attempt-unique names and only those in the
manifest that the driver commits count: a lost executor leaves no records behind.

Reader: a partition is one archive, or the plain ``.warc`` / ``.warc.gz`` files of a
folder without manifest. Of each record the headers are parsed first, from the
first inflated bytes. Predicates on header columns (``record_type``, ``page_id``,
``target_uri``, ``payload_digest``, ``refers_to``), pushed down by Spark or given as
options ``record_type`` and ``uri_prefix``, are tested there; payloads of other
records are neither inflated further nor decoded. ``payload=false`` returns no
payloads; ``verify=true`` recomputes digests and lengths from the payloads. Gzip
members of other tools may hold any number of records, and records may go across
members: such a file is inflated as one stream, of which at most a record is held.

Paths may have any scheme that pyarrow's file systems know. Defined cases: an archive
that ends within a record or a member raises ValueError with its path; an archive
without records gives no rows; columns of ``pages`` other than page_id, url and html,
whatever their names, play no part; an empty table gives an empty archive; html of any
length that Spark holds (below 2 GiB) fits a member.
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
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from ..session import materialize, shared_path, ship

SCHEMA = "page_id long, record_type string, target_uri string, payload_digest string, refers_to long, payload_bytes long, payload binary"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
RECORD = "urn:page:"
MANIFEST = "_manifest.json"
STAMP = "1970-01-01T00:00:00Z"
BATCH_BYTES = 8 << 20
ROLL = 256 << 20


def _storage(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; revisits hold no payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {STAMP}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if uri is not None:
        head.insert(3, "WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds the member's whole length."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 12 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"WL", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _storage(self.path)
        out, names = None, []
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")]
                for i in range(batch.num_rows):
                    if out is not None and out.tell() >= ROLL:
                        out.close()
                        out = None
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{names[-1]}", compression=None)
                    page_id, uri, html, refers_to, revisit = (c[i].as_py() for c in columns)
                    out.write(member(record(page_id, uri, (html or "").encode(), refers_to, revisit)))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, root = _storage(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list) -> None:
        fs, root = _storage(self.path)
        for m in messages:
            for name in m.names if m else []:
                fs.delete_file(f"{root}/{name}")


@dataclass
class Archive(ds.InputPartition):
    path: str


class Stream:
    """Bytes of a file's gzip members, or plain ones, one after another from ``at``."""

    STEP = 1 << 16

    def __init__(self, f: pa.NativeFile, at: int, path: str):
        f.seek(at)
        self.file, self.path = f, path
        self.held, self.rest, self.inflater = bytearray(), b"", None
        self.zipped = None

    def _more(self) -> bool:
        raw = self.rest or self.file.read(self.STEP)
        if self.inflater is None or self.inflater.eof:
            if self.zipped:
                raw = raw.lstrip(b"\0")  # padding between members
            if not raw:
                return False
            if self.zipped is None:
                self.zipped = raw[:2] == b"\x1f\x8b"
            self.inflater = zlib.decompressobj(31) if self.zipped else None
        elif not raw:
            raise ValueError(f"{self.path} ends within a gzip member")
        if not self.zipped:
            self.held += raw
            return True
        self.held += self.inflater.decompress(raw, 1 << 20)
        self.rest = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        return True

    def first(self, n: int) -> bytes:
        """The next n bytes (fewer at the end), which stay."""
        while len(self.held) < n and self._more():
            pass
        return bytes(self.held[:n])

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self._more():
                raise ValueError(f"{self.path} ends within a record")
        del self.held[:n]


def _head(first: Callable[[int], bytes], path: str) -> bytes | None:
    """A record's headers with the blank line that ends them; None at the end."""
    n = 2048
    while b"\r\n\r\n" not in (head := first(n)):
        if len(head) < n:
            if head.strip(b"\r\n"):
                raise ValueError(f"{path} ends within a record's headers")
            return None
        n *= 4
    return head[: head.index(b"\r\n\r\n") + 4]


def _records(f: pa.NativeFile, size: int, path: str) -> Iterator[tuple[bytes, Callable[[], bytes]]]:
    """Headers of each record, and a function that gives its block."""
    at = 0
    while at < size:
        f.seek(at)
        mark = f.read(20)
        if not (mark[:4] == b"\x1f\x8b\x08\x04" and mark[12:14] == b"WL"):
            break
        length = struct.unpack("<I", mark[16:20])[0]
        if at + length > size:
            raise ValueError(f"{path} ends within a gzip member")

        def first(n: int, at: int = at, length: int = length) -> bytes:
            f.seek(at)
            return zlib.decompressobj(31).decompress(f.read(length if n < 0 else min(length, n)), max(0, n))

        head = _head(first, path)
        if head is not None:
            yield head, lambda first=first, head=head: first(-1)[len(head) :]
        at += length
    else:
        return
    stream = Stream(f, at, path)
    while True:
        while stream.first(2) == b"\r\n":  # blank lines between records
            stream.skip(2)
        head = _head(stream.first, path)
        if head is None:
            return
        length = int(_headers(head)["content-length"])
        stream.skip(len(head))
        yield head, lambda: stream.first(length)
        stream.skip(length)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _number(ref: str | None) -> int | None:
    tail = (ref or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _passes(row: dict, tests: list[tuple[str, str, object]]) -> bool:
    for column, kind, value in tests:
        x = row[column]
        if kind == "notnull":
            ok = x is not None
        elif kind == "prefix":
            ok = x is not None and x.startswith(value)
        elif kind == "in":
            ok = x is not None and x in value
        else:
            ok = x is not None and {"eq": x == value, "gt": x > value, "ge": x >= value, "lt": x < value, "le": x <= value}[kind]
        if not ok:
            return False
    return True


class Reader(ds.DataSourceReader):
    HEADER_COLUMNS = frozenset(COLUMNS[:5])

    def __init__(self, path: str, options: dict):
        self.path = path
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []
        if "record_type" in options:
            self.tests.append(("record_type", "eq", options["record_type"]))
        if "uri_prefix" in options:
            self.tests.append(("target_uri", "prefix", options["uri_prefix"]))

    def pushFilters(self, filters: list) -> Iterator:
        kinds = {ds.EqualTo: "eq", ds.In: "in", ds.GreaterThan: "gt", ds.GreaterThanOrEqual: "ge", ds.LessThan: "lt", ds.LessThanOrEqual: "le", ds.StringStartsWith: "prefix", ds.IsNotNull: "notnull"}
        for f in filters:
            kind = kinds.get(type(f))
            if kind and len(f.attribute) == 1 and f.attribute[0] in self.HEADER_COLUMNS:
                self.tests.append((f.attribute[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        fs, root = _storage(self.path)
        info = fs.get_file_info(f"{root}/{MANIFEST}")
        if info.type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = json.loads(f.read())
            return [Archive(f"{self.path.rstrip('/')}/{n}") for n in names] or [Archive("")]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        return [Archive(prefix + x.path) for x in found if x.path.endswith((".warc", ".warc.gz"))] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = _storage(partition.path)
        kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        size = fs.get_file_info(path).size
        with fs.open_input_file(path) as f:
            for head, block_of in _records(f, size, partition.path):
                h = _headers(head)
                row = {
                    "page_id": _number(h.get("warc-record-id")),
                    "record_type": h.get("warc-type"),
                    "target_uri": h.get("warc-target-uri"),
                    "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    "refers_to": _number(h.get("warc-refers-to")),
                    "payload_bytes": int(h["x-payload-length"]) if "x-payload-length" in h else None,
                    "payload": None,
                }
                if not _passes(row, self.tests):
                    continue
                if row["record_type"] != "revisit" and (self.payload or self.verify):
                    block = block_of()[: int(h["content-length"])]
                    body = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                    if self.verify:
                        row |= {"payload_digest": digest(body), "payload_bytes": len(body)}
                    if self.payload:
                        row["payload"] = body
                        held += len(body)
                rows.append(row)
                if held >= BATCH_BYTES or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """The session's ``warc`` format, with predicate push-down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit: of pages with equal payloads of at
    least ``min_bytes`` bytes, the smallest page_id is stored and others revisit it.

    Null html is an empty payload; rows that repeat the smallest page_id are all
    stored; a null page_id is never referred to. Only ids and hashes are grouped;
    the html moves once, by page_id.
    """
    body = F.coalesce(pages["html"], F.lit(""))
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", body.alias("html"))
    hashed = own.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    small = materialize(hashed.where(F.octet_length("html") >= min_bytes).select("page_id", "sha"), "payloads")
    first = materialize(small.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n"), "first")
    again = small.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    a = again.select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "refers_to")
    joined = hashed.join(a, hashed["page_id"].eqNullSafe(a["again_id"]) & (hashed["sha"] == a["again_sha"]), "left")
    return joined.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    planned(pages, min_bytes).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` in shared storage, read back with verified digests."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_pages(pages, path)
    return spark.read.format("warc").option("payload", "false").option("verify", "true").load(path)
