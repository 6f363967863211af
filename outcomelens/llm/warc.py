"""WARC archives as a Python data source.

``register(spark)`` makes ``format("warc")`` known for reading and writing.

Writing: each task writes files of its own under a name that holds its attempt; the driver lists the files of the
tasks that succeeded in a manifest, one for each write, so files that lost executors leave behind are never read. An append
adds a manifest; an overwrite replaces those it finds, and their files. Every record is a gzip member whose extra field tells its
compressed length.

Reading: a partition per file. Headers are inflated and parsed first; predicates on the record type and other columns that only
headers tell are pushed down and decided on them, and the payload of a record that fails, or of any record if option
``payload`` is ``false``, is skipped by its length without being inflated (members without a length field are
inflated, not decoded). Length and digest of a payload are computed where it is decoded, so predicates on them stay with Spark;
without payloads they are what headers tell, or null. A member that is cut off or damaged raises an error with file and offset; so do plain
``.warc`` files in a folder without manifests.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from ..sources.scratch import Scratch
from .common import bounded, keyed, store_of

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, "
    "refers_to string, payload binary"
)
#: The header that each readable column but the payload comes from. The last two names are the source's own.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
#: The columns that nothing but a header tells: predicates on them are decided before a payload is inflated.
TOLD = ("record_id", "record_type", "target_uri", "refers_to")
#: Name of a manifest, before what tells writes apart.
MANIFEST = "_MANIFEST"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
#: A task begins a new file once one has this size, so that files stay fit for one reading task.
FILE_BYTES = 256 << 20
_EXTRA = b"sl"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _bare(digest: str) -> str:
    """Base32 of a SHA-1 given in hexadecimal digits; base32 stays as it is."""
    return base64.b32encode(bytes.fromhex(digest)).decode() if len(digest) == 40 else digest


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return " ".join(value.split())


def record_bytes(row: dict) -> bytes:
    """One record from a row with the readable columns; a revisit carries no payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": row["record_id"],
        "WARC-Date": DATE,
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": "sha1:" + (_bare(row["payload_digest"]) if row["payload_digest"] else digest_of(payload)),
        "X-Payload-Length": str(row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)),
        "WARC-Refers-To": row["refers_to"] if revisit else None,
        "WARC-Profile": IDENTICAL if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = [f"{name}: {_clean(value)}" for name, value in head.items() if value is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field 'sl' holds its whole length and the record's."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = _EXTRA + struct.pack("<HII", 8, size if size < 1 << 32 else 0, len(record) & 0xFFFFFFFF)  # 0: not told
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Member:
    """A record being read: its first bytes are inflated, the rest only on demand."""

    def __init__(self, source, first: bytes):
        self.source, self.begin = source, source.tell() - len(first)
        self.size = None
        if len(first) >= 24 and first[3] == 4 and first[12:14] == _EXTRA:
            self.size = struct.unpack("<I", first[16:20])[0]
        self.inflater = zlib.decompressobj(31)
        self.text = self.inflater.decompress(first)

    def more(self, step: int = 1 << 16) -> bool:
        data = self.source.read(step)
        if data:
            self.text += self.inflater.decompress(data)
        return bool(data) and not self.inflater.eof

    def until(self, mark: bytes) -> int:
        while (at := self.text.find(mark)) < 0:
            if self.inflater.eof or not self.more():
                return self.text.find(mark)
        return at

    def rest(self) -> bytes:
        parts = [self.text]
        # all that is left of the member where its length is told, and no more
        step = max(1, self.begin + self.size - self.source.tell()) if self.size else 1 << 16
        while not self.inflater.eof and (data := self.source.read(step)):
            parts.append(self.inflater.decompress(data))
        self.text = b"".join(parts)
        if not self.inflater.eof:
            raise EOFError("cut off")
        return self.text

    def leave(self, inflated: bool) -> None:
        """Moves the file to the next member."""
        if self.size and not inflated:
            self.source.seek(self.begin + self.size - 1)
            if not self.source.read(1):
                raise EOFError("cut off")
            return
        while not self.inflater.eof and (data := self.source.read(1 << 18)):
            self.inflater.decompress(data)
        if not self.inflater.eof:
            raise EOFError("cut off")
        self.source.seek(self.source.tell() - len(self.inflater.unused_data))


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines) if value}


def _columns(headers: dict[str, str]) -> dict:
    row = {column: headers.get(name.lower()) for column, name in HEADERS.items()}
    row["payload_digest"] = (row["payload_digest"] or "").rpartition(":")[2] or None
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else None
    return row


def records(source, accept, payload: bool = True, name: str = "archive") -> Iterator[dict]:
    """Rows of the accepted records of an open archive of gzip members.

    A payload is what follows the HTTP headers of the block. Its length, where no header tells it, and its
    digest, where a response is decoded, are computed from it. A member without a whole record raises ValueError.
    """
    begin = source.tell()
    while first := source.read(1 << 12):
        try:
            row = _record(_Member(source, first), accept, payload)
        except (EOFError, zlib.error) as e:
            raise ValueError(f"{name}: the member at byte {begin} is not whole: {e}") from e
        if row is not None:
            yield row
        begin = source.tell()


def _record(one: _Member, accept, payload: bool) -> dict | None:
    """The row of a member's record if it is accepted; the file moves to the next member."""
    end = one.until(b"\r\n\r\n")
    if end < 0:
        if one.inflater.eof and not one.text:  # an empty member
            one.leave(True)
            return None
        raise EOFError("no complete header")
    headers = _parse(one.text[:end])
    row = _columns(headers)
    if not accept(row):
        one.leave(False)
        return None
    row["payload"] = None
    if payload and row["record_type"] != "revisit":
        length = int(headers.get("content-length", 0))
        block = one.rest()[end + 4 : end + 4 + length]
        if len(block) < length:
            raise EOFError("shorter than its Content-Length")
        http = block.startswith(b"HTTP/")
        row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
        row["payload_bytes"] = len(row["payload"])
        row["payload_digest"] = digest_of(row["payload"])
        one.leave(True)
    else:
        one.leave(False)
    return row


def _manifests(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and x.base_name.startswith(MANIFEST))


def _listed(store: fs.FileSystem, manifest: str) -> list[str]:
    with store.open_input_stream(manifest) as f:
        return json.loads(f.read())


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.wanted: dict[str, list] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):
        """Takes equality, membership and presence tests on columns that headers tell; the rest stays with Spark."""
        for one in filters:
            path = getattr(one, "attribute", ())
            column = path[0] if len(path) == 1 else None
            if column in TOLD and isinstance(one, (EqualTo, In)):
                values = [one.value] if isinstance(one, EqualTo) else list(one.value)
                had = self.wanted.get(column)
                self.wanted[column] = [v for v in values if had is None or v in had]
            elif column in TOLD and isinstance(one, IsNotNull):
                self.present.add(column)
            else:
                yield one

    def partitions(self) -> list[_File]:
        store, folder = store_of(self.path)
        if manifests := _manifests(store, folder):
            names = sorted(name for manifest in manifests for name in _listed(store, manifest))
            return [_File(f"{self.path.rstrip('/')}/{name}") for name in names]
        found = store.get_file_info(fs.FileSelector(folder))
        names = sorted(x.base_name for x in found if x.is_file and x.base_name.endswith((".warc.gz", ".warc")))
        if plain := [name for name in names if name.endswith(".warc")]:
            raise ValueError(f"{self.path}: archives of gzip members are read, not {plain[0]}")
        return [_File(f"{self.path.rstrip('/')}/{name}") for name in names]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in HEADERS] + [("payload", pa.binary())]
        )
        wanted = {column: set(values) for column, values in self.wanted.items()}

        def accept(row: dict) -> bool:
            if any(row[column] is None for column in self.present):
                return False
            return all(row[column] in values for column, values in wanted.items())

        if partition is None:  # what Spark passes if there are no files
            return
        store, path = store_of(partition.path)
        rows, size = [], 0
        with store.open_input_file(path) as source:
            for row in records(source, accept, self.payload, partition.path):
                rows.append(row)
                size += len(row["payload"] or b"") + 256
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.most, self.overwrite = options["path"], int(options.get("fileBytes", FILE_BYTES)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        task, names, out = TaskContext.get(), [], None
        for batch in iterator:
            for k in range(len(batch)):  # a record at a time: payloads may be long
                row = {name: batch.column(name)[k].as_py() for name in (*HEADERS, "payload")}
                if out is None or out.tell() >= self.most:
                    if out:
                        out.close()
                    names.append(f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names)}-{uuid4().hex[:8]}.warc.gz")
                    out = store.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                out.write(member(record_bytes(row)))
        if out:
            out.close()
        return _Written(names)

    def commit(self, messages) -> None:
        """A manifest of this write. After an overwrite the ones before it go, then the files they list."""
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        old = _manifests(store, folder) if self.overwrite else []
        with store.open_output_stream(f"{folder}/{MANIFEST}-{uuid4().hex}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        gone = [name for manifest in old for name in _listed(store, manifest)]
        for path in [*old, *(f"{folder}/{name}" for name in gone)]:
            if store.get_file_info(path).is_file:
                store.delete_file(path)

    def abort(self, messages) -> None:
        store, folder = store_of(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{folder}/{name}")


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
    """Makes the format known. Spark pushes predicates to Python sources only with a session setting, which stays on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def page_records(pages: DataFrame, scratch: Scratch, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Responses and revisits of the rows of (page_id, url, html), to be written with ``format("warc")``.

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at least ``least`` bytes the
    one with the smallest page_id is the response, the others revisit it; rows that repeat that page_id are
    responses too. Smaller payloads are all responses. A null page_id is never the smallest unless all are null,
    and its record id ends in ``null``. A null url gives no target. Other columns are ignored.

    Payloads are not dealt out to compare them: their digests are, a row per task and digest however often it repeats. Revisits are
    made of what is left of a row without its payload, and responses are the rows that no revisit stands for.
    """
    rows = keyed(pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")), scratch)
    told = rows.select("_file", "_at", "page_id", "url", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    told = scratch.table(told, "digests")
    long = told.where(F.col("payload_bytes") >= least)
    first = long.groupBy("sha", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select(F.col("sha").alias("_sha"), F.col("payload_bytes").alias("_bytes"), "first")
    first = bounded(scratch.table(first, "first"))
    again = told.join(first, (F.col("sha") == F.col("_sha")) & (F.col("payload_bytes") == F.col("_bytes")))
    again = scratch.table(again.where(~F.col("page_id").eqNullSafe(F.col("first"))).drop("_sha", "_bytes"), "again")
    nothing = F.lit(None).cast("string")
    revisits = again.select(
        _urn(F.col("page_id")).alias("record_id"),
        F.lit("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.col("sha").alias("payload_digest"),
        "payload_bytes",
        _urn(F.col("first")).alias("refers_to"),
        F.lit(None).cast("binary").alias("payload"),
    )
    responses = rows.join(bounded(again.select("_file", "_at")), ["_file", "_at"], "left_anti").select(
        _urn(F.col("page_id")).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        nothing.alias("payload_digest"),  # the writer computes it
        F.lit(None).cast("long").alias("payload_bytes"),
        nothing.alias("refers_to"),
        "payload",
    )
    return responses, revisits


def page_of(urn):
    """The page_id in a record id, null where it is not a number."""
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archive(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and returns what a read of them gives.

    Responses are read with their payloads, whose length and digest are computed anew; revisits by their headers.
    """
    spark = pages.sparkSession
    register(spark)
    folder = scratch.folder("warc")
    for records in page_records(pages, scratch, least):
        records.write.format("warc").mode("append").save(folder)
    read = lambda payload: spark.read.format("warc").option("payload", payload).load(folder)
    revisits = read("false").where("record_type = 'revisit'")
    return read("true").where("record_type = 'response'").unionByName(revisits)
