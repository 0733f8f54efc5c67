"""Exchanging numpy columns: rows of (bucket, kind, payload), payload being several arrays, compressed.

One row carries what a block of input has for a bucket, so that exchanges move few rows; there are several buckets to a
partition, and their number follows the input's size.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from worklore.llm.common import fanout, input_bytes

SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
DDL = "bucket int, kind int, payload binary"
BLOCK_BYTES = 2 << 20
#: what a task holds before it deals, as text and as columns; input to a row at least, on average
BLOCKS_BYTES, HELD_BYTES, ROW_BYTES = 16 << 20, 48 << 20, 1 << 10
#: names that a task counts at a time, keeps, and reports
COUNTED, ROOM, REPORTED = 1 << 20, 1 << 16, 1 << 12
Columns = list[np.ndarray]


def encode(columns: Columns) -> bytes:
    head = np.asarray([len(columns[0]), *(ord(c.dtype.char) for c in columns)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(bytes([len(columns)]) + head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def decode(payload: bytes) -> Columns:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    head = np.frombuffer(raw, "<i8", raw[0] + 1, 1)
    at, out = 1 + 8 * len(head), []
    for code in head[1:].tolist():
        dtype = np.dtype(chr(code))
        out.append(np.frombuffer(raw, dtype, int(head[0]), at))
        at += dtype.itemsize * int(head[0])
    return out


def merge(parts: list[Columns]) -> Columns:
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def deal(bucket: np.ndarray, columns: Columns, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """A row for each bucket that has entries."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    columns = [c[order] for c in columns]
    for start, end in zip(cuts, [*cuts[1:], len(b)], strict=True):
        yield int(b[start]), kind, encode([c[start:end] for c in columns])


def freed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows; when they have gone, what it freed goes back to the system. Workers outlive their tasks, and would keep
    it from the stages that come after."""
    try:
        yield from rows
    finally:
        del rows
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Until it is left, jobs send Python no more than so many rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(rows, int(before or 0)) if int(before or 0) > 0 else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Dealer:
    """Holds columns of several kinds until they fill HELD_BYTES, then deals them out, a row for each kind and bucket."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, Columns]]] = {}
        self.size = 0

    def add(self, kind: int, bucket: np.ndarray, columns: Columns) -> None:
        if len(bucket):
            self.parts.setdefault(kind, []).append((bucket, columns))
            self.size += bucket.nbytes + sum(c.nbytes for c in columns)

    def full(self) -> bool:
        return self.size >= HELD_BYTES

    def batches(self) -> Iterator[pa.RecordBatch]:
        for kind in sorted(self.parts):
            parts = self.parts.pop(kind)
            rows = list(deal(np.concatenate([p for p, _ in parts]), merge([c for _, c in parts]), kind))
            del parts
            yield batch(rows)
        self.size = 0


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def collected(batches: Iterator[pa.RecordBatch]) -> dict[int, list]:
    """kind -> decoded payloads of one partition, whose size is bounded by the choice of `exchange`."""
    out: dict[int, list] = {}
    for b in batches:
        for kind, payload in zip(b.column("kind").to_pylist(), b.column("payload"), strict=True):
            out.setdefault(kind, []).append(decode(payload.as_py()))
    return out


def counts(docs: DataFrame, bytes_each: int = 8 << 20) -> tuple[int, int]:
    """(partitions, buckets) for exchanges whose volume follows that of docs. A task deals a row to each bucket, so there are
    no more buckets than leave ROW_BYTES of input to a row: rows follow the data, not the product of tasks and buckets."""
    n, size = fanout(docs, bytes_each), input_bytes(docs)
    tasks = max(len(docs.inputFiles()), -(-size // BLOCKS_BYTES))
    return n, max(min(n, docs.sparkSession.sparkContext.defaultParallelism), min(n, size // (ROW_BYTES * max(1, tasks))))


def exchange(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "bucket")


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each; a single longer text is a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.frombuffer(b.column(column).buffers()[1], np.int32)[b.column(column).offset :][: b.num_rows + 1].astype(np.int64)
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
            yield b.slice(start, min(stop, b.num_rows) - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all texts' UTF-8 bytes, end to end; n+1 offsets). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit value."""
    return ((mix(x.astype(np.uint64)) >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def new_groups(*columns: np.ndarray) -> np.ndarray:
    """True where any column differs from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class Frequent:
    """Counts of a task's names in bounded room, by the mergeable form of Misra and Gries' summary: beyond `room`, the
    largest count that is to go is taken off all. A name's count is never above the true one."""

    def __init__(self, counted: int = COUNTED, room: int = ROOM):
        self.counted, self.room = counted, room
        self.names, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.n = self.seen = self.again = 0

    def add(self, names: np.ndarray) -> None:
        self.held.append(names)
        self.n += len(names)
        if self.n >= self.counted:
            self.merge()

    def merge(self) -> None:
        fresh, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.held]), return_counts=True)
        self.seen, self.again = self.seen + self.n, self.again + int(n[n > 1].sum())
        self.held, self.n = [], 0
        names = np.concatenate([self.names, fresh])
        order = np.argsort(names, kind="stable")
        names, counts = names[order], np.concatenate([self.counts, n])[order]
        starts = np.flatnonzero(new_groups(names))
        if len(starts):
            names, counts = names[starts], np.add.reduceat(counts, starts)
        if len(names) > self.room:
            counts = counts - np.partition(counts, len(counts) - self.room - 1)[len(counts) - self.room - 1]
            names, counts = names[counts > 0], counts[counts > 0]
        self.names, self.counts = names, counts

    def reported(self) -> tuple[np.ndarray, np.ndarray]:
        if self.n:
            self.merge()
        top = np.argsort(-self.counts, kind="stable")[:REPORTED]
        top = top[self.counts[top] > 2]
        return self.names[top], self.counts[top]
