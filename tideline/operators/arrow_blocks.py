"""Arrow batches of a task, gathered into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes from which on a block is closed whatever its rows.
BLOCK_BYTES = 96 << 20


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Blocks of at least so many rows or BLOCK_BYTES; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Blocks of whole groups, from rows sorted by a non-null LONG key."""
    held = None
    for block in blocks(batches, rows):
        held = block if held is None else pa.concat_tables([held, block])
        ids = held.column(key).to_numpy()
        end = int(np.searchsorted(ids, ids[-1]))
        if end:
            yield held.slice(0, end)
            held = held.slice(end)
    if held is not None:
        yield held


def pieces(batches: Iterator[pa.RecordBatch], key: str, rows: int, most: int) -> Iterator[tuple[pa.Table, int | None]]:
    """Blocks of whole groups, from rows sorted by a non-null LONG key; a group of `most` rows and more comes in pieces.

    With each block comes the number of the piece that its first group is, from
    0 on, or None if that is whole. So no group is held whole, however large.
    """
    held, split, number = None, None, 0
    for block in blocks(batches, rows):
        held = block if held is None else pa.concat_tables([held, block])
        ids = held.column(key).to_numpy()
        end = int(np.searchsorted(ids, ids[-1]))
        if end:
            yield held.slice(0, end), number if ids[0] == split else None
            split, held = None, held.slice(end)
        if held.num_rows >= most:
            number = number if ids[-1] == split else 0
            yield held, number
            split, number, held = ids[-1], number + 1, None
    if held is not None:
        yield held, number if held.column(key)[0].as_py() == split else None


def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=1 << 17)
