"""Irregular readings onto the regular grid of their windows.

Each grid slot is evaluated by weighted local polynomial regression (degree 1)
with the Epanechnikov kernel, at the middle of the slot. Readings are indexed
by their slot, once each; the few slots whose kernel reaches a reading follow
from it. Windows are cut into chunks of slots, and each chunk adds up the
weighted moments of its slots as its readings stream by. Only the readings of
the outermost slots of a chunk go to the chunk beside it, too.

The kernel reaches whole slots (its half width is an odd number of half steps)
and is a polynomial there, so what many readings in one slot contribute to it
and to its neighbours follows from nine sums over them. A task first adds up
the readings of such slots, so a source with most of the readings, or a slot
with millions, sends few rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.u64 import order_key
from tideline.operators.arrow_blocks import blocks
from tideline.session import bounded_join, materialise, shuffle_partitions

#: Half width of the kernel, in steps of the window: an odd number of halves.
BANDWIDTH = 1.5
#: Least effective number of readings for an estimate.
MIN_SUPPORT = 1.5
#: Share of its upper bound below which the determinant of the normal equations is taken for that of one time only.
FLAT = 1e-6
#: Sum of weights up to which there is none.
NONE = 1e-9
#: Width of the time cells by which readings find their window: 2**46 ns, 19.5 hours.
CELL_BITS = 46
#: Slots in a chunk, the unit of work; a kernel must not reach farther.
SLOT_CHUNK = 4096
#: Window cells up to which they are broadcast (about 100 bytes each); beyond, both sides are shuffled.
BROADCAST_CELLS = 200_000
#: Rows of a task among which readings of a slot are added up before the shuffle, if there are so many of them.
BLOCK_ROWS, MANY = 1 << 18, 8
#: Slots that are evaluated at a time.
AT_ONCE = 1 << 18

_MAX = (1 << 63) - 1


def proper_windows(windows: DataFrame) -> DataFrame:
    """Distinct windows with slots: window_id, address, start_time, step_ns, n_slots, first, last.

    first and last are the order keys of the first time and the last time that
    belong to the window. Windows with a null (but window_id), with no slots or
    with a step below 1 have no slots and are dropped; repeated rows count once.
    A window ends with the last word, and 2**63 - 1 ns after its start.
    """
    w = windows.select("window_id", "address", "start_time", "step_ns", "n_slots").filter(
        F.col("address").isNotNull() & F.col("start_time").isNotNull() & (F.col("step_ns") > 0) & (F.col("n_slots") > 0)
    )
    first = order_key(F.col("start_time"))
    span = F.coalesce(F.try_multiply(F.col("step_ns"), F.col("n_slots")), F.lit(_MAX))
    last = F.coalesce(F.try_add(first, span - 1), F.lit(_MAX))
    return w.distinct().withColumn("first", first).withColumn("last", last)


def in_windows(points: DataFrame, windows: DataFrame, *extra: str) -> DataFrame:
    """Readings with the window they lie in, and their offset in it in ns.

    points: address, time and the extra columns; windows: from proper_windows,
    maybe with more columns. Windows of one address must not overlap.
    """
    cells = windows.withColumn(
        "cell", F.explode(F.sequence(F.shiftright("first", CELL_BITS), F.shiftright("last", CELL_BITS)))
    )
    p = points.select(
        F.col("address").alias("p_address"), F.col("time").alias("p_time"), *(F.col(c).alias(f"p_{c}") for c in extra)
    ).filter(F.col("p_address").isNotNull() & F.col("p_time").isNotNull())
    key = order_key(F.col("p_time"))
    p = p.withColumn("p_key", key).withColumn("p_cell", F.shiftright("p_key", CELL_BITS))
    on: Column = (
        (F.col("p_address") == F.col("address")) & (F.col("p_cell") == F.col("cell"))
        & (F.col("p_key") >= F.col("first")) & (F.col("p_key") <= F.col("last"))
    )
    joined = bounded_join(p, cells, on, "inner", BROADCAST_CELLS, F.col("p_time"))
    return joined.withColumn("offset", F.col("p_key") - F.col("first")).drop("cell", "p_cell", "p_key", "p_address")


#: Rows on their way to a chunk: a reading (slot in the chunk, ns into the slot, payload), sums over readings of a
#: slot (sums, a null), or the chunk itself (slot FIRST, slots in it, step, sums: where it lies).
_CELL = "wid long, chunk long, slot int, a long, b long, sums binary"
FIRST = -(1 << 30)
_PLACE = "<qqqqq?"
RESULT = "window_id long, address long, slot long, slot_time long, readings long, support double, value double, missing boolean"


def _sums(u: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows (n, u, u2, u3, u4, y, uy, u2y, u3y) of readings at u, from -0.5 to 0.5 steps off the middle of their slot."""
    u2 = u * u
    return np.stack([np.ones(len(u)), u, u2, u2 * u, u2 * u2, y, u * y, u2 * y, u2 * u * y])


def _indexed(halo: int, length: int, least: int):
    """Rows (wid, step, slots, offset, payload) to cells; readings near the border of a chunk also as cells of the next; chunks have `length` slots, slots with `least` readings are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, BLOCK_ROWS):
            wid, step, slots, offset, y = (table.column(c).to_numpy() for c in ("wid", "step_ns", "n_slots", "offset", "payload"))
            own = offset // step
            rest = offset - own * step
            order = np.lexsort((own, wid))
            new = np.r_[True, (np.diff(wid[order]) != 0) | (np.diff(own[order]) != 0)]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, len(order)])
            group = np.cumsum(new) - 1
            dense = size >= least
            one = order[~dense[group]]
            part = [np.stack([wid[one], own[one], rest[one], y[one]]), np.zeros((4, 0), np.int64)]
            sums: list[bytes | None] = [None] * len(one)
            if dense.any():
                many = order[dense[group]]
                at = np.r_[0, np.cumsum(size[dense])[:-1]]
                total = np.add.reduceat(_sums(rest[many] / step[many] - 0.5, y[many].astype(np.float64)), at, axis=1)
                zero = np.zeros(len(at), np.int64)
                part[1] = np.stack([wid[many][at], own[many][at], zero, zero])
                sums += [np.ascontiguousarray(c).tobytes() for c in total.T]
            cells = np.concatenate(part, axis=1)
            sums = pa.array(sums, pa.binary())
            last = np.concatenate([slots[one], slots[many][at] if dense.any() else np.zeros(0, np.int64)]) - 1
            yield from _out(cells, cells[1] // length, sums, np.arange(cells.shape[1]))
            inside = cells[1] % length
            chunks = cells[1] // length
            for to, near in ((chunks - 1, (inside < halo) & (chunks > 0)), (chunks + 1, (inside >= length - halo) & (chunks < last // length))):
                yield from _out(cells, to, sums, np.flatnonzero(near))

    def _out(cells: np.ndarray, chunk: np.ndarray, sums: pa.Array, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(at):
            wid, own, a, b = cells[:, at]
            columns = [pa.array(wid), pa.array(chunk[at]), pa.array((own - chunk[at] * length).astype(np.int32)), pa.array(a), pa.array(b), sums.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(columns, ["wid", "chunk", "slot", "a", "b", "sums"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (wid, chunk, slots of it, step, window_id, address, start_time, its first slot) to cells that say where the chunk lies."""
    for batch in batches:
        wid, chunk, width, step, window_id, address, start, before = (batch.column(c) for c in ("wid", "chunk", "width", "step_ns", "window_id", "address", "start_time", "before"))
        place = [
            struct.pack(_PLACE, i or 0, a, s, st, c, i is None)
            for i, a, s, st, c in zip(*(x.to_pylist() for x in (window_id, address, start, step, before)))
        ]
        first = pa.array(np.full(batch.num_rows, FIRST, np.int32))
        yield pa.RecordBatch.from_arrays([wid, chunk, first, width, step, pa.array(place, pa.binary())], ["wid", "chunk", "slot", "a", "b", "sums"])


def _moments(u: np.ndarray, y: np.ndarray, j: int, h: float) -> np.ndarray:
    """Rows (w, wd, wdd, wy, wdy, ww) that readings add to the slot j before theirs; h: square of the kernel's half width."""
    d = u + j
    w = np.maximum(0.0, 1 - d * d / h)
    wd = w * d
    return np.stack([w, wd, wd * d, w * y, wd * y, w * w])


def _moments_of_sums(sums: np.ndarray, j: int, h: float) -> np.ndarray:
    """The same of readings that were added up."""
    n, u, u2, u3, u4, y, uy, u2y, u3y = sums
    d, d2 = u + j * n, u2 + 2 * j * u + j * j * n
    d3 = u3 + 3 * j * u2 + 3 * j**2 * u + j**3 * n
    d4 = u4 + 4 * j * u3 + 6 * j**2 * u2 + 4 * j**3 * u + j**4 * n
    dy, d2y = uy + j * y, u2y + 2 * j * uy + j * j * y
    d3y = u3y + 3 * j * u2y + 3 * j**2 * uy + j**3 * y
    return np.stack([n - d2 / h, d - d3 / h, d2 - d4 / h, y - d2y / h, dy - d3y / h, n - 2 * d2 / h + d4 / (h * h)])


def _evaluated(bandwidth: float, min_support: float):
    """Cells, sorted by chunk and slot, to the slots of the grid."""
    halo, h = int(bandwidth), bandwidth * bandwidth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The chunk that may go on in the next batch: its key, place, step, moments of its slots and readings in them.
        held: tuple | None = None
        for batch in batches:
            wid, chunk, slot, a, b = (batch.column(c).to_numpy() for c in ("wid", "chunk", "slot", "a", "b"))
            if not len(wid):
                continue
            sums = batch.column("sums")
            start = np.flatnonzero(np.r_[True, (np.diff(wid) != 0) | (np.diff(chunk) != 0)])
            done: list[tuple] = []
            size = 0
            for s, e in zip(start, np.r_[start[1:], len(wid)]):
                key = (wid[s], chunk[s])
                if held is None or held[0] != key:
                    if held is not None:
                        done.append(held)
                        size += len(held[4])
                        held = None
                        if size >= AT_ONCE:
                            yield _grid(done, h, min_support)
                            done, size = [], 0
                    if slot[s] != FIRST:
                        continue  # beyond the window's last word
                    held = (key, struct.unpack(_PLACE, sums[int(s)].as_py()), int(b[s]), np.zeros((6, int(a[s]))), np.zeros(int(a[s]), np.int64))
                    s += 1
                if s < e:
                    _, _, step, moments, readings = held
                    width = len(readings)
                    at = slot[s:e].astype(np.int64)
                    summed = sums.slice(s, e - s).is_valid().to_numpy(zero_copy_only=False)
                    own = (at >= 0) & (at < width)
                    readings += np.bincount(at[own & ~summed], minlength=width)
                    one, many = np.flatnonzero(~summed), np.flatnonzero(summed)
                    u, y = a[s:e][one] / step - 0.5, b[s:e][one].astype(np.float64)
                    added = np.array([np.frombuffer(sums[int(s + r)].as_py(), np.float64) for r in many]).T if len(many) else np.zeros((9, 0))
                    np.add.at(readings, at[many][own[many]], np.rint(added[0][own[many]]).astype(np.int64))
                    for j in range(-halo, halo + 1):
                        for to, v in ((at[one] - j, _moments(u, y, j, h)), (at[many] - j, _moments_of_sums(added, j, h))):
                            here = (to >= 0) & (to < width)
                            if here.any():
                                for row, x in zip(moments, v):
                                    row += np.bincount(to[here], x[here], minlength=width)
            if done:
                yield _grid(done, h, min_support)
        if held is not None:
            yield _grid([held], h, min_support)

    return run


def _grid(chunks: list[tuple], h: float, min_support: float) -> pa.RecordBatch:
    """Slots of whole chunks from their moments."""
    w, wd, wdd, wy, wdy, ww = np.concatenate([c[3] for c in chunks], axis=1)
    readings = np.concatenate([c[4] for c in chunks])
    # Readings at the very ends of the kernel have no weight, but for rounding.
    some = w > NONE
    det = w * wdd - wd * wd
    flat = det <= FLAT * w * w * h
    with np.errstate(divide="ignore", invalid="ignore"):
        support = np.where(some & (ww > 0), w * w / ww, 0.0)
        estimate = np.where(flat, wy / w, (wdd * wy - wd * wdy) / det)
    known = some & (support >= min_support)
    place = np.array([c[1] for c in chunks], object)
    width = [len(c[4]) for c in chunks]
    each = np.repeat(np.arange(len(chunks)), width)
    window_id, address, start, step, before = (place[:, i].astype(np.int64)[each] for i in range(5))
    slot = before + np.concatenate([np.arange(n) for n in width])
    with np.errstate(over="ignore"):
        time = start + slot * step
    columns = [
        pa.array(window_id, mask=place[:, 5].astype(bool)[each]), pa.array(address), pa.array(slot), pa.array(time), pa.array(readings),
        pa.array(support), pa.array(estimate, mask=~known), pa.array(~known),
    ]
    return pa.RecordBatch.from_arrays(columns, ["window_id", "address", "slot", "slot_time", "readings", "support", "value", "missing"])


def regular_grid(points: DataFrame, windows: DataFrame, bandwidth: float = BANDWIDTH, min_support: float = MIN_SUPPORT) -> DataFrame:
    """One row per slot of every window.

    points: address, time, payload (LONG words; payload signed). Readings with
    a null in any of them are none; all others count, also repeated ones.
    windows: window_id, address, start_time, step_ns, n_slots. bandwidth: half
    width of the kernel in steps, an odd number of halves (0.5, 1.5, 2.5 ...).

    Result: window_id, address, slot, slot_time, readings (in the slot itself),
    support (effective number of readings in the kernel, square of the sum of
    weights over the sum of squares, 0 without any), value, missing. Where the
    support does not reach min_support the slot is missing and has no value,
    whether or not it has a reading of its own; all other slots have the
    regression's estimate at their middle, the weighted mean if the kernel
    holds a single time. Empty points leave all slots missing; empty windows
    give no rows. Other columns are not read.
    """
    if bandwidth < 0.5 or (bandwidth * 2) % 2 != 1:
        raise ValueError(f"the kernel's half width is no odd number of half steps: {bandwidth}")
    if bandwidth > SLOT_CHUNK:
        raise ValueError(f"the kernel reaches beyond the {SLOT_CHUNK} slots of a chunk: {bandwidth}")
    spark = points.sparkSession
    # Numbered once, in the written table: one row per window.
    w = materialise(proper_windows(windows).withColumn("wid", F.monotonically_increasing_id()), "windows")
    reads = in_windows(points.select("address", "time", "payload").filter(F.col("payload").isNotNull()), w.select("address", "first", "last", "wid", "step_ns", "n_slots"), "payload")
    cells = reads.select("wid", "step_ns", "n_slots", "offset", F.col("p_payload").alias("payload")).mapInArrow(_indexed(int(bandwidth), SLOT_CHUNK, MANY), _CELL)
    # The window's last time may be the last word there is; slots beyond it do not exist.
    slots = F.least(F.col("n_slots"), F.expr("(last - first) div step_ns + 1"))
    parts = w.withColumn("slots", slots).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {SLOT_CHUNK}"))))
    before = F.col("chunk") * SLOT_CHUNK
    width = F.least(F.lit(SLOT_CHUNK).cast("long"), F.col("slots") - before)
    places = parts.select("wid", "chunk", width.alias("width"), "step_ns", "window_id", "address", "start_time", before.alias("before")).mapInArrow(_chunks, _CELL)
    ordered = cells.unionByName(places).repartition(shuffle_partitions(spark, points, w), "wid", "chunk").sortWithinPartitions("wid", "chunk", "slot")
    return ordered.mapInArrow(_evaluated(bandwidth, min_support), RESULT)
