"""The binary wire form of points, to and from rows.

A record is three little-endian words: address, time and payload. Bit 0 of the
address marks an extended record, whose payload word is the length of the bytes
that follow. A blob is any sequence of records.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.u64 import order_key

RECORD, RECORD_BYTES = "<QQQ", 24

#: Rows of a decoded blob: payload of simple points, data of extended ones; seq is batch_id * 2**32 + position.
DECODED = T.StructType([
    T.StructField("address", T.LongType()), T.StructField("time", T.LongType()), T.StructField("payload", T.LongType()),
    T.StructField("data", T.BinaryType()), T.StructField("seq", T.LongType()),
])

ARROW = pa.schema([(n, pa.binary() if n == "data" else pa.int64()) for n in DECODED.names])

#: Rows handed on at a time.
ROWS = 1 << 16


class InvalidPayload(ValueError):
    """A blob that ends within a record."""


def parse(blob: bytes) -> Iterator[tuple[int, int, int, bytes | None]]:
    """Address, time, payload word and, of extended points, bytes of each record."""
    view, at, size = memoryview(blob), 0, len(blob)
    while at < size:
        if size - at < RECORD_BYTES:
            raise InvalidPayload(f"{size - at} bytes at offset {at} are no record")
        address, time, payload = struct.unpack_from(RECORD, view, at)
        at += RECORD_BYTES
        if address & 1:
            if payload > size - at:
                raise InvalidPayload(f"{payload} bytes announced at offset {at}, {size - at} left")
            yield address, time, payload, bytes(view[at : at + payload])
            at += payload
        else:
            yield address, time, payload, None


def build(address: int, time: int, payload: int | bytes) -> bytes:
    """One record; bytes make an extended one. The address must have the parity of the kind."""
    if isinstance(payload, bytes) != bool(address & 1):
        raise ValueError("the address has the parity of the other kind")
    if isinstance(payload, bytes):
        return struct.pack(RECORD, address, time, len(payload)) + payload
    return struct.pack(RECORD, address, time, payload)


def _simple_run(blob: memoryview) -> np.ndarray:
    return np.frombuffer(blob[: len(blob) // RECORD_BYTES * RECORD_BYTES], "<u8").reshape(-1, 3)


def decoded(batch_id: int, blob: bytes) -> Iterator[pa.RecordBatch]:
    """A blob as batches of rows; stretches of simple points are taken as they lie."""
    view, at, pos = memoryview(blob), 0, 0
    parts: list[tuple[np.ndarray, list[bytes | None]]] = []
    held, ahead = 0, 8

    def batch() -> pa.RecordBatch:
        words = np.concatenate([w for w, _ in parts]).astype("<u8").view("<i8")
        data = [d for _, ds in parts for d in ds]
        first = pos - len(words)
        simple = (words[:, 0] & 1) == 0
        return pa.RecordBatch.from_arrays([
            pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(words[:, 2], mask=~simple), pa.array(data, pa.binary()),
            pa.array((batch_id << 32) + np.arange(first, pos, dtype=np.int64)),
        ], DECODED.names)

    while at < len(blob):
        rest = view[at:]
        words = _simple_run(rest[: ahead * RECORD_BYTES])
        odd = np.flatnonzero(words[:, 0] & 1)
        n = int(odd[0]) if len(odd) else len(words)
        # Look further ahead the longer the stretch of simple points.
        ahead = 8 if len(odd) else min(ROWS, 2 * ahead)
        if n:
            parts.append((words[:n], [None] * n))
            at, pos, held = at + n * RECORD_BYTES, pos + n, held + n
        elif not len(words):
            raise InvalidPayload(f"{len(rest)} bytes at offset {at} are no record")
        else:
            # Extended records follow each other: each says where the next one begins.
            heads, data = [], []
            while len(blob) - at >= RECORD_BYTES and len(data) < ROWS:
                head = struct.unpack_from(RECORD, view, at)
                if not head[0] & 1:
                    break
                at, size = at + RECORD_BYTES, head[2]
                if size > len(blob) - at:
                    raise InvalidPayload(f"{size} bytes announced at offset {at}, {len(blob) - at} left")
                heads.append(head)
                data.append(bytes(view[at : at + size]))
                at += size
            parts.append((np.array(heads, "<u8"), data))
            pos, held = pos + len(data), held + len(data)
        if held >= ROWS:
            yield batch()
            parts, held = [], 0
    if held:
        yield batch()


def decode(blobs: DataFrame) -> DataFrame:
    """Rows of DECODED from batch_id LONG, blob BINARY; a blob that ends within a record fails the job.

    batch_id must be below 2**31. Null and empty blobs have no rows; a null
    batch_id counts as 0. A blob is decoded by one task, several at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for batch_id, blob in zip(batch.column("batch_id").to_pylist(), batch.column("blob").to_pylist()):
                yield from decoded(batch_id or 0, blob or b"")

    return blobs.select("batch_id", "blob").mapInArrow(run, DECODED)


def simple_points(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("address").bitwiseAND(F.lit(1)) == 0).select("address", "time", "payload", "seq")


def extended_points(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("address").bitwiseAND(F.lit(1)) == 1).select("address", "time", F.col("data").alias("payload"), "seq")


def _binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    """Strings of bytes that lie one after the other."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def _with_bytes(words: np.ndarray, payload: pa.Array) -> pa.Array:
    """Records of words (address, time, to be set to the length) and payloads, null ones as empty."""
    payload = pa.concat_arrays([payload]).fill_null(b"")
    held = np.frombuffer(payload.buffers()[1], np.int32, len(payload) + 1, payload.offset * 4).astype(np.int64)
    words[:, 2] = np.diff(held)
    offsets = np.r_[0, np.cumsum(RECORD_BYTES + words[:, 2])]
    head = offsets[:-1, None] + np.arange(RECORD_BYTES)
    out, body = np.empty(offsets[-1], np.uint8), np.ones(offsets[-1], bool)
    out[head] = words.view(np.uint8).reshape(-1, RECORD_BYTES)
    body[head] = False
    data = payload.buffers()[2]
    if data is not None:
        out[body] = np.frombuffer(data, np.uint8)[held[0] : held[-1]]
    return _binary(offsets, out.tobytes())


def _joined(records: pa.Array) -> bytes:
    """All records of an array, one after the other."""
    if not len(records):
        return b""
    held = np.frombuffer(records.buffers()[1], np.int32, len(records) + 1, records.offset * 4)
    return records.buffers()[2].slice(int(held[0]), int(held[-1] - held[0])).to_pybytes()


def records(points: DataFrame) -> DataFrame:
    """points with their wire record: simple ones with a LONG payload, extended ones with a BINARY payload.

    Null payloads of extended points are written as empty; points with a null
    address, time or simple payload have no record and are left out.
    """
    extended = isinstance(points.schema["payload"].dataType, T.BinaryType)
    known = points.filter(F.col("address").isNotNull() & F.col("time").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.empty((batch.num_rows, 3), "<i8")
            for i, c in enumerate(("address", "time")):
                words[:, i] = batch.column(c).to_numpy(zero_copy_only=False)
            if extended:
                out = _with_bytes(words, batch.column("payload"))
            else:
                words[:, 2] = batch.column("payload").to_numpy(zero_copy_only=False)
                out = _binary(np.arange(0, words.nbytes + 1, RECORD_BYTES), words.tobytes())
            yield batch.append_column("record", out)

    rows = known if extended else known.filter(F.col("payload").isNotNull())
    return rows.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("record", T.BinaryType())]))


def blobs(points: DataFrame) -> DataFrame:
    """blob BINARY: the records of points, as many together as come in one Arrow batch. See records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_joined(batch.column("record"))], pa.binary())], ["blob"])

    return records(points.select("address", "time", "payload")).select("record").mapInArrow(run, "blob binary")


def batch_blobs(simple: DataFrame, extended: DataFrame) -> DataFrame:
    """batch_id LONG, blob BINARY: the records of both kinds of points that were written in one batch, in order of seq.

    seq = batch_id * 2**32 + position; rows with a null seq are left out. A
    blob is put together while its sorted records stream by. See records.
    """
    both = [records(x.select("address", "time", "payload", "seq").filter(F.col("seq").isNotNull())).select("seq", "record") for x in (simple, extended)]
    rows = both[0].unionByName(both[1]).withColumn("batch_id", F.shiftright("seq", 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def blob() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["batch_id", "blob"])

        for batch in batches:
            ids = batch.column("batch_id").to_numpy()
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
            for a, b in zip(start, [*start[1:], len(ids)]):
                if held and ids[a] != at:
                    yield blob()
                    held = []
                at = int(ids[a])
                held.append(_joined(batch.column("record").slice(a, b - a)))
        if held:
            yield blob()

    return rows.repartition("batch_id").sortWithinPartitions("batch_id", "seq").mapInArrow(run, "batch_id long, blob binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of DECODED from files in wire form, batches numbered by the order of their names."""
    files = spark.read.format("binaryFile").load(path)
    # One row per file: names are numbered without their contents.
    order = Window.orderBy("path")
    ids = files.select("path").withColumn("batch_id", F.row_number().over(order).cast("long") - 1)
    return decode(files.join(ids, "path").select("batch_id", F.col("content").alias("blob")))


def to_wire(points: DataFrame) -> Iterator[bytes]:
    """The wire form of points by (time, address), a partition at a time, fetched ahead."""
    ordered = records(points.select("address", "time", "payload")).orderBy(order_key(F.col("time")), order_key(F.col("address")))
    for row in ordered.select("record").toLocalIterator(prefetchPartitions=True):
        yield bytes(row["record"])

