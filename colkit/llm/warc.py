"""WARC archives as a PySpark Python data source, for reading and writing.

Reading: one partition per archive file.  Filters on the record type and on headers are pushed into the reader, which
parses a record's headers first; the payload of a record that is not wanted is skipped, not decoded.  In archives
that this module writes each record is a gzip member whose extra field ``sl`` holds its lengths, so that
skipping is a seek; other ``.warc.gz`` files and plain ``.warc`` files are read as well.

Writing: each task writes files of its own; the commit names them in a manifest, so that files of failed or repeated
tasks are not read.  Paths are opened with pyarrow's file systems, so any store that these reach will do.

Options: ``path``; ``payload`` ("false": no payloads are read); ``level`` (compression level); ``max_file_bytes``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import Scratch, columns, new_path, written

SCHEMA = "record_id string, row_id long, record_type string, target_uri string, date string, content_type string, payload_digest string, refers_to string, content_length long, payload_length long, payload binary"
#: Column of each header that a filter can name.
HEADERS = {"record_id": "warc-record-id", "row_id": "x-row-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
MANIFEST = "_manifest"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_BLOCK, _BATCH_BYTES = 1 << 16, 8 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def header_safe(value: str) -> str:
    """Line ends cannot stand in a header: they are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


# --- writing -------------------------------------------------------------------------------------------------------


def record(row: dict) -> bytes:
    """One record.  row: row_id, record_type, target_uri, payload_digest, payload, refers_to."""
    payload = row["payload"] or b""
    kind = row["record_type"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.get('payload_length', len(payload))}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}"]
    if row["row_id"] is not None:
        lines.append(f"X-Row-ID: {row['row_id']}")
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {header_safe(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:row:{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member with its compressed and uncompressed length in the extra field ``sl``."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.level, self.most = options["path"], int(options.get("level", "3")), int(options.get("max_file_bytes", str(256 << 20)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = open_fs(self.path)
        store.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in (r for at in range(0, batch.num_rows, 50) for r in batch.slice(at, 50).to_pylist()):
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                data = member(record(row), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, path = open_fs(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write("".join(f"{name}\n" for m in messages if m for name in m.files).encode())

    def abort(self, messages) -> None:
        store, path = open_fs(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.delete_file(f"{path}/{name}")


# --- reading -------------------------------------------------------------------------------------------------------


class Archive:
    """The records of one file: headers first, then the block if it is asked for."""

    def __init__(self, raw):
        self.raw, self.zipped = raw, raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        self.plain: bytearray = bytearray()  # decoded, not yet used
        self.z, self.rest, self.end = None, b"", False

    def _more(self) -> bool:
        """Decodes some more bytes; at a member's end goes on with the next."""
        if not self.zipped:
            data = self.raw.read(_BLOCK)
            self.plain += data
            return bool(data)
        while True:
            if not self.rest:
                self.rest = self.raw.read(_BLOCK)
                if not self.rest:
                    return False
            if self.z is None:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.rest, _BLOCK)
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = None
            self.plain += got
            if got:
                return True

    def _take(self, n: int) -> bytes:
        while len(self.plain) < n and self._more():
            pass
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def _drop(self, n: int) -> None:
        while n:
            k = min(n, len(self.plain))
            del self.plain[:k]
            n -= k
            if n and not self.zipped:
                self.raw.seek(n, 1)
                return
            if n and not self._more():
                return

    def _member_length(self, at: int) -> int:
        """From the extra field ``sl`` of the member that starts at ``at``; 0 if it has none."""
        self.raw.seek(at)
        head = self.raw.read(24)
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            return struct.unpack("<I", head[16:20])[0]
        return 0

    def records(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        """(headers, block) of the records for whose headers ``wanted`` gives "block" or "head"."""
        at = 0
        while True:
            length = self._member_length(at) if self.zipped and not self.plain and self.z is None and not self.end else 0
            if length:
                self.raw.seek(at)
                self.rest = b""
                z = zlib.decompressobj(31)
                head = bytearray(z.decompress(self.raw.read(min(length, 2048)), 1024))  # headers first
                while (cut := head.find(b"\r\n\r\n")) < 0:
                    data = z.unconsumed_tail or self.raw.read(_BLOCK)
                    if not data:
                        return
                    head += z.decompress(data, 1024)
                headers = parse_headers(bytes(head[:cut]))
                how = wanted(headers)
                if how == "block":
                    size = int(headers.get("content-length", 0))
                    tail = self.raw.read(max(0, at + length - self.raw.tell()))
                    head += z.decompress(z.unconsumed_tail + tail)
                    yield headers, bytes(head[cut + 4 : cut + 4 + size])
                elif how:
                    yield headers, None
                at += length  # a seek: what is left of the member is not decoded
                self.raw.seek(at)
                continue
            if not self.end:
                self.raw.seek(at)
                self.rest, self.end = b"", True
            while self.plain[:2] == b"\r\n" or len(self.plain) < 2:
                if self.plain[:2] == b"\r\n":
                    del self.plain[:2]
                elif not self._more():
                    return
            while (cut := self.plain.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    return
            headers = parse_headers(self._take(cut + 4)[:-4])
            size = int(headers.get("content-length", 0))
            how = wanted(headers)
            if how == "block":
                yield headers, self._take(size)
            else:
                self._drop(size)
                if how:
                    yield headers, None


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def http_payload(block: bytes) -> tuple[bytes, int | None]:
    """(what follows the HTTP headers, their Content-Length)."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return block, None
    length = parse_headers(head).get("content-length")
    return body, int(length) if length and length.isdigit() else None


def value_of(headers: dict[str, str], column: str):
    value = headers.get(HEADERS[column])
    if value is None:
        return None
    if column == "row_id":
        return int(value) if value.lstrip("-").isdigit() else None
    if column == "payload_digest":
        return value.partition(":")[2] or value
    if column in ("record_id", "refers_to"):
        return value.strip("<>").removeprefix("urn:row:")
    return value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((name, (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            else:
                yield f

    def partitions(self):
        store, path = open_fs(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [InputPartition(path)]
        names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(path)))
        if MANIFEST in names:
            with store.open_input_stream(f"{path}/{MANIFEST}") as f:
                names = f.read().decode().split()
        return [InputPartition(f"{path}/{n}") for n in names if n.endswith((".warc", ".warc.gz"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        store, _ = open_fs(self.path)
        tests = self.tests

        def wanted(headers: dict) -> str:
            if not all(value_of(headers, c) in values for c, values in tests):
                return ""
            return "block" if self.payload else "head"

        rows, size = [], 0
        with store.open_input_file(partition.value) as raw:
            for headers, block in Archive(raw).records(wanted):
                body, length = http_payload(block) if block is not None else (None, None)
                kind = headers.get("warc-type")
                if body is not None and length is None:
                    length = len(body)
                rows.append([*(value_of(headers, c) for c in HEADERS), int(headers.get("content-length", 0)), length, None if kind == "revisit" else body])
                size += 500 + len(body or b"")
                if size >= _BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "colkit_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``."""
    register(spark)
    return spark.read.format("colkit_warc").option("payload", str(payload).lower()).load(path)


def archive_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100) -> None:
    """Writes a record per row of ``pages`` to archives under ``path``.

    Of rows with equal payloads of at least ``min_revisit`` bytes that with the smallest id is a response and others
    revisit it; smaller payloads are all responses.  Null html is an empty payload; a null url leaves the
    target URI out; rows with the smallest id that repeat are all responses; a null id is never revisited.

    Only ids and digests are grouped.  Revisits are few and keyed by (id, digest), so no task gets a group
    of equal payloads together.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = columns(pages, row_id=id_col, url=url_col, html=html_col).select(F.col("row_id").cast("long").alias("row_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    with Scratch(pages.sparkSession):
        sizes = written(rows.where(F.octet_length("payload") >= min_revisit).select("row_id", "digest"), "warc-digests")
        first = written(sizes.groupBy("digest").agg(F.min("row_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to"), "warc-first")
        revisits = sizes.join(first, "digest").where(~F.col("row_id").eqNullSafe(F.col("refers_to"))).select("row_id", "digest", "refers_to").distinct()
        revisits = written(revisits, "warc-revisits").select(F.col("row_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
        kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
        out = rows.join(revisits, F.col("row_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select(
            "row_id", kind.alias("record_type"), F.col("url").alias("target_uri"), F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"), F.when(kind == "response", F.col("payload")).alias("payload"), "refers_to"
        )
        out.write.format("colkit_warc").mode("append").save(path)


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the records back."""
    path = new_path(pages.sparkSession, "warc")
    archive_pages(pages, path, **names)
    return read_warc(pages.sparkSession, path)
