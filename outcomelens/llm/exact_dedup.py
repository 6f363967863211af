"""Exact deduplication by Grace hashing.

1. Each scan task collapses the equal texts it meets in a bounded open-addressing table, so a text that a third
   of all rows share costs one row per task from here on. The rows are written once.
2. One row per local text is shuffled by a hash of its text. A task puts its records into an open-addressing
   table that compares complete contents. When the table is full, records that match no resident are spilled
   to partition files by further bits of their hash, and each file is worked off the same way, recursively.
3. Classes join back to the rows by the local text's number, which one scan task at most shares.

Spill files lie in the shared folder and go with their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch
from .common import bounded, store_of

#: Content a table holds before it spills (or, in a scan, starts anew).
TABLE_BYTES = 64 << 20
#: Files a table spills to.
FANOUT = 16


class OpenTable:
    """Open addressing with linear probing; equality is that of the whole content."""

    def __init__(self, room: int):
        self.room, self.held = room, 0
        self._start(1 << 10)
        self.entries: list[tuple[int, bytes, int]] = []

    def _start(self, slots: int) -> None:
        self.slots, self.mask = [-1] * slots, slots - 1

    @property
    def full(self) -> bool:
        return self.held >= self.room

    def find(self, code: int, content: bytes) -> int:
        """The value stored with this content, or -1."""
        at = code & self.mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == code and entry[1] == content:
                return entry[2]
            at = (at + 1) & self.mask
        return -1

    def add(self, code: int, content: bytes, value: int) -> None:
        """Stores a content that find() did not find."""
        self.entries.append((code, content, value))
        self.held += len(content) + 64
        if 2 * len(self.entries) > len(self.slots):
            self._start(2 * len(self.slots))
            for k in range(len(self.entries)):
                self._place(k)
        else:
            self._place(len(self.entries) - 1)

    def _place(self, k: int) -> None:
        at = self.entries[k][0] & self.mask
        while self.slots[at] >= 0:
            at = (at + 1) & self.mask
        self.slots[at] = k


def hash_code(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content)


class SpillFiles:
    """Record files of one table: number and content, one file per value of the hash's next bits."""

    schema = pa.schema([("number", pa.int64()), ("content", pa.binary())])

    def __init__(self, store: fs.FileSystem, folder: str, fanout: int, batch_bytes: int = 1 << 20):
        self.store, self.folder, self.fanout, self.batch_bytes = store, folder, fanout, batch_bytes
        self.waiting: list[list[tuple[int, bytes]]] = [[] for _ in range(fanout)]
        self.bytes = [0] * fanout
        self.out: dict[int, tuple] = {}
        store.create_dir(folder, recursive=True)

    def add(self, part: int, number: int, content: bytes) -> None:
        self.waiting[part].append((number, content))
        self.bytes[part] += len(content) + 16
        if self.bytes[part] >= self.batch_bytes:
            self._flush(part)

    def _flush(self, part: int) -> None:
        if not (rows := self.waiting[part]):
            return
        if part not in self.out:
            sink = self.store.open_output_stream(f"{self.folder}/{part}")
            self.out[part] = (sink, pa.ipc.new_stream(sink, self.schema))
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
        self.out[part][1].write_batch(pa.record_batch(columns, schema=self.schema))
        self.waiting[part], self.bytes[part] = [], 0

    def close(self) -> list[int]:
        for part in range(self.fanout):
            self._flush(part)
        for sink, writer in self.out.values():
            writer.close()
            sink.close()
        return sorted(self.out)

    def read(self, part: int) -> Iterator[tuple[int, bytes]]:
        with self.store.open_input_stream(f"{self.folder}/{part}") as source, pa.ipc.open_stream(source) as batches:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        self.store.delete_file(f"{self.folder}/{part}")


def grace(
    records: Iterable[tuple[int, bytes]], store: fs.FileSystem, folder: str, room: int, fanout: int, level: int = 0
) -> Iterator[tuple[int, int]]:
    """(number, number of the first record with equal content) of every record.

    A full table keeps its residents: what equals one is settled, the rest is spilled. Each level settles one
    content at least, so this ends even if all hash codes are equal; memory is a table per level and a batch per file.
    """
    table, spill = OpenTable(room), None
    for number, content in records:
        code = hash_code(content)
        first = table.find(code, content)
        if first >= 0:
            yield number, first
        elif not table.full:
            table.add(code, content, number)
            yield number, number
        else:
            spill = spill or SpillFiles(store, f"{folder}/{level}", fanout)
            # each level deals by a hash of its own
            spill.add(xxhash.xxh3_64_intdigest(content, seed=level + 1) % fanout, number, content)
    if spill:
        del table
        for part in spill.close():
            yield from grace(spill.read(part), store, f"{folder}/{level}-{part}", room, fanout, level + 1)


def _collapse(room: int, text_at: int):
    """Adds to a task's rows: their number, the number of the first equal text in reach, and the SHA-256."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        table = OpenTable(room)
        for batch in batches:
            rows, firsts, sums = [], [], []
            for text in batch.column(text_at).to_pylist():
                content = (text or "").encode()
                code = hash_code(content)
                first = table.find(code, content)
                if first < 0:
                    if table.full:
                        table = OpenTable(room)
                    table.add(code, content, number)
                    first = number
                rows.append(number)
                firsts.append(first)
                sums.append(hashlib.sha256(content).hexdigest())
                number += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, pa.int64()), pa.array(firsts, pa.int64()), pa.array(sums, pa.string())],
                names=[*batch.schema.names, "row", "first", "sha"],
            )

    return scan


def _classes(folder: str, room: int, fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = store_of(folder)
        path = f"{path}/{task.partitionId()}-{task.taskAttemptId()}"

        def records() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield number, (text or "").encode()

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            columns = [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["first", "class"])

        found: list[tuple[int, int]] = []
        try:
            for pair in grace(records(), store, path, room, fanout):
                found.append(pair)
                if len(found) == 10_000:
                    yield batch_of(found)
                    found = []
            yield batch_of(found)
        finally:
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_dir(path)

    return run


def _grouped(docs: DataFrame, scratch: Scratch, text: str, doc_id: str, room: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """The rows as a table of c0, c1, ..., row, first, sha; and (first, keep_row, keep_id, group_size)."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    where = docs.columns.index(text)
    body, key = f"c{where}", f"c{docs.columns.index(doc_id)}"
    schema = T.StructType(
        [
            *plain.schema.fields,
            T.StructField("row", T.LongType()),
            T.StructField("first", T.LongType()),
            T.StructField("sha", T.StringType()),
        ]
    )
    rows = scratch.table(plain.mapInArrow(_collapse(room, where), schema), "collapsed")
    local = rows.where("row = first").select("first", F.coalesce(body, F.lit("")).alias("content"))
    folder = scratch.folder("grace")
    classes = scratch.table(
        local.repartition(F.xxhash64("content")).mapInArrow(_classes(folder, room, fanout), "first long, class long"), "classes"
    )
    # a null doc_id ranks below all others; of repeated rows the last one stays
    best = F.max(F.struct(F.col(key).isNotNull(), F.col(key).alias("id"), "row")).alias("best")
    sums = rows.groupBy("first").agg(best, F.count("*").alias("n")).join(classes, "first")
    whole = sums.groupBy("class").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    groups = classes.join(whole, "class").select(
        "first", F.col("best.row").alias("keep_row"), F.col("best.id").alias("keep_id"), "group_size"
    )
    return rows, groups


def mark_duplicates(
    docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", room: int = TABLE_BYTES, fanout: int = FANOUT
) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts may have any length and are equal when identical; null equals the empty text. The row with the largest doc_id of a group stays;
    of rows that repeat it exactly one is kept, and null ids rank lowest. Other columns are ignored.
    """
    rows, groups = _grouped(docs.select(doc_id, text), scratch, text, doc_id, room, fanout)
    return rows.select("c0", "row", "first", "sha").join(groups, "first").select(
        F.col("c0").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", room: int = TABLE_BYTES, fanout: int = FANOUT
) -> DataFrame:
    """The rows that stay, with all their columns as they were."""
    rows, groups = _grouped(docs, scratch, text, doc_id, room, fanout)
    # few rows go as a rule: then the texts need no second shuffle
    members = rows.select("row", "first").join(groups.select("first", "keep_row"), "first")
    dropped = scratch.table(members.where("row <> keep_row").select("row"), "dropped")
    return rows.join(bounded(dropped), "row", "left_anti").select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)]
    )
