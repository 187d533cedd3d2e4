"""Results per key when a few keys hold most rows.

Rows are range partitioned by the composite of key and secondary order, by
sampled quantiles, so a heavy key simply spans several partitions of usual
size. Within a partition each key is one contiguous run of sorted rows and is
reduced to a partial state. Only the first and the last key of a partition can
go on in a neighbour; their partial states, at most two a partition, are
stitched in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.u64 import order_key
from tideline.operators.arrow_blocks import blocks, emit
from tideline.session import materialise, shuffle_partitions

#: Sorted rows reduced at a time.
BLOCK_ROWS = 1 << 18

#: Partial state of a run of rows of one key. Times are order keys of words; a
#: sum is kept as high * 2**32 + low, which is exact for any LONGs.
STATE = (
    "address long, edge boolean, n long, first_time long, last_time long, widest_gap long, "
    "n_payload long, sum_high long, sum_low long, mean double, spread double, lowest long, highest long"
)
_I64 = np.iinfo(np.int64)


def _gaps(t: np.ndarray) -> np.ndarray:
    """Differences of sorted order keys as words; those of 2**63 and more become 2**63 - 1."""
    wide = t[1:].view(np.uint64) - t[:-1].view(np.uint64)
    return np.minimum(wide, np.uint64(_I64.max)).astype(np.int64)


def _reduce(block: pa.Table) -> pa.Table:
    a = block.column("address").to_numpy()
    t = block.column("at").to_numpy()
    known = block.column("payload").is_valid().to_numpy()
    p = block.column("payload").fill_null(0).to_numpy()
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    end = np.r_[start[1:], len(a)]
    timed = block.column("timed").to_numpy()
    n_timed = np.add.reduceat(timed.astype(np.int64), start)
    # Untimed rows are sorted first in their key.
    first = np.minimum(end - 1, start + (end - start - n_timed))
    gap = np.zeros(len(a), np.int64)
    gap[1:] = _gaps(t)
    gap[start] = -1
    gap[first] = -1
    gap[~timed] = -1
    none = n_timed == 0
    widest = np.maximum.reduceat(gap, start)
    n_payload = np.add.reduceat(known.astype(np.int64), start)
    high, low = np.add.reduceat(p >> 32, start), np.add.reduceat(p & 0xFFFFFFFF, start)
    mean = (high * 4294967296.0 + low) / np.maximum(n_payload, 1)
    off = np.where(known, p - np.repeat(mean, end - start), 0.0)
    edge = np.zeros(len(start), bool)
    edge[[0, -1]] = True
    return pa.table({
        "address": a[start], "edge": edge, "n": end - start,
        "first_time": pa.array(t[first], mask=none), "last_time": pa.array(t[end - 1], mask=none),
        "widest_gap": pa.array(widest, mask=widest < 0),
        "n_payload": n_payload, "sum_high": high, "sum_low": low,
        "mean": mean, "spread": np.add.reduceat(off * off, start),
        "lowest": np.minimum.reduceat(np.where(known, p, _I64.max), start),
        "highest": np.maximum.reduceat(np.where(known, p, _I64.min), start),
    })


def _together(a: dict, b: dict) -> dict:
    """State of a run that goes on: b follows a."""
    n = a["n_payload"] + b["n_payload"]
    high, low = a["sum_high"] + b["sum_high"], a["sum_low"] + b["sum_low"]
    mean = (high * 4294967296.0 + low) / max(n, 1)
    gaps = [x["widest_gap"] for x in (a, b)]
    if a["last_time"] is not None and b["first_time"] is not None:
        gaps.append(min(b["first_time"] - a["last_time"], int(_I64.max)))
    return {
        "address": a["address"], "edge": True, "n": a["n"] + b["n"],
        "first_time": b["first_time"] if a["first_time"] is None else a["first_time"], "last_time": a["last_time"] if b["last_time"] is None else b["last_time"],
        "widest_gap": max((g for g in gaps if g is not None), default=None),
        "n_payload": n, "sum_high": high, "sum_low": low, "mean": mean,
        "spread": sum(x["spread"] + x["n_payload"] * (x["mean"] - mean) ** 2 for x in (a, b)),
        "lowest": min(a["lowest"], b["lowest"]), "highest": max(a["highest"], b["highest"]),
    }


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of the runs of a partition; its first and its last are edges, however many blocks a run goes through."""
    held, first = None, True
    for block in blocks(batches, BLOCK_ROWS):
        states = _reduce(block)
        if held is not None:
            goes_on = held.column("address")[0] == states.column("address")[0]
            if goes_on:
                one = _together(held.to_pylist()[0], states.slice(0, 1).to_pylist()[0])
                held, states = pa.Table.from_pylist([one], states.schema), states.slice(1)
            states = pa.concat_tables([held, states])
        done = states.num_rows - 1
        if done:
            edge = np.zeros(done, bool)
            edge[0] = first
            first = False
            yield from emit(states.slice(0, done).set_column(1, "edge", pa.array(edge)))
        held = states.slice(done)
    if held is not None:
        yield from emit(held.set_column(1, "edge", pa.array([True])))


def _stitched(states: DataFrame) -> DataFrame:
    """One state per key. Only edge states have partners; theirs are put in order of time."""
    piece = F.struct("first_time", "last_time", "n_payload", "mean")
    whole = T.DecimalType(38, 0)
    high, low = (F.sum(F.col(c).cast(T.DecimalType(20, 0))).cast(whole) for c in ("sum_high", "sum_low"))
    s = states.groupBy("address").agg(
        F.sum("n").alias("n"), F.sum("n_payload").alias("n_payload"),
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.max("widest_gap").alias("widest_gap"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.sum("spread").alias("spread"),
        (high * F.lit(1 << 32).cast(T.DecimalType(10, 0)) + low).cast(whole).alias("payload_sum"),
        F.array_sort(F.collect_list(F.when(F.col("edge"), piece))).alias("pieces"),
    )
    s = s.withColumn("payload_mean", F.when(F.col("n_payload") > 0, F.col("payload_sum").cast("double") / F.col("n_payload")))
    timed = F.filter("pieces", lambda x: x["first_time"].isNotNull())
    s = s.withColumn("timed", timed)
    seams = F.transform(
        F.slice("timed", 2, F.greatest(F.size("timed") - 1, F.lit(0))),
        lambda x, i: F.coalesce(F.try_subtract(x["first_time"], F.get("timed", i)["last_time"]), F.lit(int(_I64.max))),
    )
    off = F.aggregate("pieces", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["n_payload"] * F.pow(x["mean"] - F.col("payload_mean"), F.lit(2.0)), F.lit(0.0)))
    return s.withColumn("widest_gap", F.greatest("widest_gap", F.array_max(seams))).withColumn("spread", F.col("spread") + off)


def key_statistics(points: DataFrame) -> DataFrame:
    """Statistics of every address: no task holds more than its share, whatever the keys.

    points: address, time, payload LONG; other columns are not read. Result:
    address; points (all rows, repeats counted); first_time, last_time (least
    and greatest as words, null if all are null); widest_gap (longest distance
    of consecutive times in ns, null below two times, 2**63 - 1 at most);
    payloads (not null), payload_sum DECIMAL(38,0) exact, payload_mean,
    payload_deviation (of the population), lowest, highest, null without
    payloads. Null addresses have no result; an empty table gives no rows.
    """
    spark = points.sparkSession
    rows = points.filter(F.col("address").isNotNull()).select(
        "address", F.col("time").isNotNull().alias("timed"), F.coalesce(order_key(F.col("time")), F.lit(int(_I64.min))).alias("at"), "payload"
    )
    # The payload is the last part of the composite: rows alike in key and time can be split, too.
    parts = rows.repartitionByRange(shuffle_partitions(spark, points), "address", "timed", "at", "payload").sortWithinPartitions("address", "timed", "at")
    states = parts.mapInArrow(_partials, STATE)
    some = F.col("n_payload") > 0
    return _stitched(states).select(
        "address", F.col("n").alias("points"), order_key(F.col("first_time")).alias("first_time"), order_key(F.col("last_time")).alias("last_time"),
        "widest_gap", F.col("n_payload").alias("payloads"), F.when(some, F.col("payload_sum")).alias("payload_sum"), "payload_mean",
        F.when(some, F.sqrt(F.greatest(F.lit(0.0), F.col("spread") / F.col("n_payload")))).alias("payload_deviation"),
        F.when(some, F.col("lowest")).alias("lowest"), F.when(some, F.col("highest")).alias("highest"),
    )


def heavy_keys(points: DataFrame, share: float) -> DataFrame:
    """Addresses with at least so large a share of the rows whose address is not null, with their statistics."""
    # One row per address, written once: their points add up to all rows.
    stats = materialise(key_statistics(points), "statistics")
    total = stats.agg(F.coalesce(F.sum("points"), F.lit(0))).first()[0]
    return stats.filter(F.col("points") >= F.lit(share) * total)
