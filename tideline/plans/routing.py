"""Routing of points to (epoch, bucket) by an index of epochs.

An index maps the start of each epoch to its number of buckets. The interval of
an epoch is (its start, the next start]: a time equal to a start belongs to the
epoch before, except that the first epoch owns its own start. An index has a
few entries, so it lives on the driver; column forms take it as literals.
Times, epochs and addresses in this module are words 0 .. 2**64-1 as ints.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.u64 import MAX_WORD, order_key, place_bucket, to_signed, to_unsigned

#: Bucket counts must leave room for the unsigned arithmetic of place_bucket.
MAX_BUCKETS = 1 << 62


@dataclass(frozen=True)
class Index:
    """Epoch starts and bucket counts, by rising start; never empty."""

    entries: tuple[tuple[int, int], ...]

    @staticmethod
    def of(entries: Iterable[tuple[int, int]]) -> Index:
        """From entries in the order they were made; a later entry of an epoch counts."""
        latest = dict(entries)
        if not latest:
            raise ValueError("an index needs an epoch")
        for epoch, n in latest.items():
            if not 0 <= epoch <= MAX_WORD or not 1 <= n < MAX_BUCKETS:
                raise ValueError(f"not an epoch with buckets: {epoch}, {n}")
        return Index(tuple(sorted(latest.items())))

    @staticmethod
    def of_table(rows: DataFrame, kind: str) -> Index:
        """From a table kind, epoch, n_buckets, entry_seq: of an epoch entered twice the later entry counts."""
        own = rows.filter((F.col("kind") == kind) & F.col("epoch").isNotNull() & F.col("n_buckets").isNotNull())
        latest = own.groupBy("epoch").agg(F.max_by("n_buckets", "entry_seq").alias("n")).collect()
        return Index.of((to_unsigned(r.epoch), r.n) for r in latest)

    @staticmethod
    def from_bytes(data: bytes) -> Index:
        """From pairs of little-endian words; a partial pair at the end is ignored."""
        return Index.of(struct.iter_unpack("<QQ", data[: len(data) // 16 * 16]))

    def to_bytes(self) -> bytes:
        return b"".join(struct.pack("<QQ", *e) for e in self.entries)

    def with_entry(self, epoch: int, n: int) -> Index:
        return Index.of([*self.entries, (epoch, n)])

    def newest(self) -> tuple[int, int]:
        """Epoch and bucket count at the last time there is."""
        return self.lookup(MAX_WORD)

    def lookup(self, time: int) -> tuple[int, int]:
        """Epoch and bucket count of a time."""
        i = bisect_left([e for e, _ in self.entries], time)
        return self.entries[max(i - 1, 0)]

    def later(self, time: int) -> list[tuple[int, int]]:
        """Entries that start after a time."""
        return [x for x in self.entries if x[0] > time]

    def locate(self, time: int, address: int) -> tuple[int, int]:
        """Epoch and bucket of a point."""
        epoch, n = self.lookup(time)
        return epoch, (address & ~1) % n

    def in_range(self, start: int, end: int) -> list[tuple[int, int]]:
        """Entries whose interval meets [start, end], rising; the epoch that starts at `start` too."""
        if start > end:
            return []
        return [self.lookup(start)] + [x for x in self.later(self.lookup(start)[0]) if x[0] < end]

    def targets(self, start: int, end: int, addresses: Iterable[int]) -> list[tuple[int, list[int]]]:
        """Per epoch of a range the distinct buckets of the addresses, as they first appear."""
        addresses = list(addresses)
        return [(epoch, list(dict.fromkeys((a & ~1) % n for a in addresses))) for epoch, n in self.in_range(start, end)]

    def epoch_of(self, time: Column) -> Column:
        """Epoch of a time column, raw bits."""
        c = F.lit(to_signed(self.entries[0][0])).cast("long")
        for (epoch, _) in self.entries[1:]:
            c = F.when(order_key(time) > F.lit(to_signed(epoch) ^ -(1 << 63)), F.lit(to_signed(epoch))).otherwise(c)
        return c.cast("long")

    def buckets_of(self, epoch: Column) -> Column:
        """Bucket count of an epoch column."""
        c = F.lit(None).cast("long")
        for e, n in self.entries:
            c = F.when(epoch == F.lit(to_signed(e)), F.lit(n).cast("long")).otherwise(c)
        return c

    def located(self, points: DataFrame, time: str = "time", address: str = "address") -> DataFrame:
        """points with epoch and bucket; null for a null time or address."""
        known = F.col(time).isNotNull() & F.col(address).isNotNull()
        with_epoch = points.withColumn("epoch", F.when(known, self.epoch_of(F.col(time))))
        return with_epoch.withColumn("bucket", F.when(known, place_bucket(F.col(address), self.buckets_of(F.col("epoch")))))

    def partitions(self, start: int, end: int, addresses: Iterable[int] | None) -> Column:
        """Predicate on the columns epoch and bucket that keeps what a read can need; without addresses, whole epochs."""
        if addresses is None:
            parts = [F.col("epoch") == F.lit(to_signed(e)) for e, _ in self.in_range(start, end)]
        else:
            parts = [
                (F.col("epoch") == F.lit(to_signed(e))) & F.col("bucket").isin(*buckets)
                for e, buckets in self.targets(start, end, addresses) if buckets
            ]
        out = F.lit(False)
        for p in parts:
            out = p if out is None else out | p
        return out
