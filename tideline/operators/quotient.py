"""Deliveries of the same message: exact quotient hash tables.

An identifier of two 64-bit words is permuted by a four-round Feistel network,
a bijection of its 128 bits. The first bits of the permuted identifier (the
quotient) name a shard and a home slot in the shard's table; all other bits
(the remainder) are stored whole. Since the permutation is one-to-one, an equal
remainder at an equal home slot is the same identifier: nothing is ever matched
by mistake, at any load.

Each task first fills tables over blocks of its own rows, so of any identifier
at most one row per block is shuffled, however often it was delivered. Then
every shard fills one table and settles which delivery was written first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.arrow_blocks import blocks, emit, whole_groups
from tideline.session import fresh, shuffle_partitions

#: Rows of a block that a task dedups before anything is shuffled.
BLOCK_ROWS = 1 << 20
#: Rows from which on whole shards are put into one table.
TABLE_ROWS = 1 << 18
#: Bits of the quotient that name the shard; the next bits name the home slot.
SHARD_BITS = 31

_LAST = np.iinfo(np.int64).max


def _round(x: np.ndarray, key: int) -> np.ndarray:
    """Round function of the network; it need not be invertible, only spread its bits."""
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


ROUND_KEYS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def permute(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one permutation of pairs of 64-bit words."""
    for key in ROUND_KEYS:
        a, b = b, a ^ _round(b, key)
    return a, b


def unpermute(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of permute."""
    for key in reversed(ROUND_KEYS):
        a, b = b ^ _round(a, key), a
    return a, b


def insert(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Insert permuted identifiers into a quotient table; the slot of each.

    Two rows get the same slot exactly if their identifiers are equal. Within
    a shard the table is addressed by the bits after the shard bits; the shard
    bits stay in the stored remainder, so a table over several shards is exact
    too. Probing is linear; a slot keeps the distance from its occupant's home,
    which with the remainder gives back the whole identifier.
    """
    n = len(high)
    bits = max(4, int(2 * n - 1).bit_length())
    mask = (1 << bits) - 1
    turned = (high << np.uint64(SHARD_BITS)) | (high >> np.uint64(64 - SHARD_BITS))
    home = (turned >> np.uint64(64 - bits)).astype(np.int64)
    rest = turned << np.uint64(bits)
    distance = np.full(mask + 1, -1, np.int32)
    owner = np.empty(mask + 1, np.int64)
    kept_rest = np.empty(mask + 1, np.uint64)
    kept_low = np.empty(mask + 1, np.uint64)
    slot_of = np.empty(n, np.int64)
    pending, probe = np.arange(n), 0
    while pending.size:
        slot = (home[pending] + probe) & mask
        free = distance[slot] < 0
        claimed = slot[free]
        owner[claimed] = pending[free]  # of several claimants one stays; equal identifiers all claim the same slot
        kept_rest[claimed], kept_low[claimed] = rest[owner[claimed]], low[owner[claimed]]
        distance[claimed] = probe
        same = (distance[slot] == probe) & (kept_rest[slot] == rest[pending]) & (kept_low[slot] == low[pending])
        slot_of[pending[same]] = slot[same]
        pending = pending[~same]
        probe += 1
    return slot_of


def _words(batch: pa.Table, column: str) -> np.ndarray:
    return batch.column(column).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _least(slot: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Least value in the slot of each row."""
    least = np.full(int(slot.max()) + 1 if len(slot) else 0, _LAST)
    np.minimum.at(least, slot, by)
    return least[slot]


def _first(slot: np.ndarray, order: np.ndarray, rows: pa.Table, index: np.ndarray) -> np.ndarray:
    """Marks one row of each slot: least order, of equals the one whose columns written out come first; index: their places in rows."""
    marked = order == _least(slot, order)
    at = np.flatnonzero(marked)
    tied = at[np.bincount(slot[at], minlength=int(slot.max()) + 1 if len(slot) else 0)[slot[at]] > 1]
    if len(tied):
        text = np.array([repr(r) for r in rows.take(pa.array(index[tied])).to_pylist()], object)
        place = np.empty(len(tied), np.int64)
        place[np.argsort(text, kind="stable")] = np.arange(len(tied))
        marked[tied] = place == _least(slot[tied], place)
    return marked


def _deliveries(df: DataFrame, keys: tuple[str, str], order: str, later: bool) -> DataFrame:
    (shard,) = fresh(df, "__shard")
    columns = df.columns
    whole = F.col(f"`{keys[0]}`").isNotNull() & F.col(f"`{keys[1]}`").isNotNull()
    schema = T.StructType([*df.schema.fields, T.StructField(shard, T.IntegerType(), False)])

    def identify(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Permuted identifiers, order and whether there is an identifier."""
        have = np.ones(rows.num_rows, bool)
        for k in keys:
            have &= rows.column(k).is_valid().to_numpy()
        # A row without an order value counts as written last.
        at = rows.column(order).cast(pa.int64()).fill_null(_LAST).to_numpy()
        return *permute(_words(rows, keys[0]), _words(rows, keys[1])), at, have

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_ROWS):
            high, low, at, have = identify(block)
            some = np.flatnonzero(have)
            slot = insert(high[some], low[some])
            # The first of the block has to compete with other blocks; what becomes of the rest is settled.
            open_ = np.zeros(block.num_rows, bool)
            if later:
                open_[some] = at[some] == _least(slot, at[some])
                keep = have
            else:
                open_[some] = _first(slot, at[some], block, some)
                keep = open_ | ~have
            # Settled rows have negative shards and go anywhere, spread by their order value.
            ids = (np.where(open_, high, permute(at.view(np.uint64), low)[0]) >> np.uint64(64 - SHARD_BITS)).astype(np.int32)
            yield from emit(block.append_column(shard, pa.array(np.where(open_, ids, ~ids))).filter(pa.array(keep)))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, shard, TABLE_ROWS):
            out = rows.column(shard).to_numpy() < 0
            open_ = np.flatnonzero(~out)
            if open_.size:
                part = rows.take(pa.array(open_))
                high, low, at, _ = identify(part)
                slot = insert(high, low)
                out[open_] = at > _least(slot, at) if later else _first(slot, at, part, np.arange(len(at)))
            yield from emit(rows.select(columns).filter(pa.array(out)))

    n = shuffle_partitions(df.sparkSession, df)
    return (
        (df.filter(whole) if later else df)
        .mapInArrow(local, schema)
        .repartitionById(n, F.pmod(F.col(shard), F.lit(n)))
        .sortWithinPartitions(shard)
        .mapInArrow(settle, df.schema)
    )


def redelivered(df: DataFrame, keys: tuple[str, str] = ("address", "time"), order: str = "seq") -> DataFrame:
    """Rows whose identifier also occurs with a lower order value, with all their columns.

    keys: two LONG columns (any words, signed or not). Rows with a null in
    either are never redelivered. A row with a null order counts as written
    last. Rows that share both identifier and order do not make each other
    redelivered. An empty table gives no rows; other columns pass unread, and
    clashing names are avoided.
    """
    return _deliveries(df, keys, order, later=True)


def first_deliveries(df: DataFrame, keys: tuple[str, str] = ("address", "time"), order: str = "seq") -> DataFrame:
    """df with exactly one row of each identifier, the first written.

    Rows with a null in either key have no identifier and all stay. Of rows
    that share identifier and order, the one whose columns written out come
    first stays, so the result depends on the rows only; of equal rows one
    stays. A null order counts as written last.
    """
    return _deliveries(df, keys, order, later=False)
