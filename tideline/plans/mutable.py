"""Values by key, kept as versions: insert, insert with a merge, lookup, enumerate.

Addresses 2k and 2k+1 are the same key, 2k+1. A key's first version is 0. Each
insert is a commit, so racing writers never share a version. Single inserts are
held in the commit itself; when there are INLINE of them they are merged with
the tables of earlier ones into one table of the latest of each key, in 128
buckets by key, of which a lookup reads one.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.u64 import MAX_WORD, order_key, place_bucket, set_bit0, to_signed, to_unsigned
from tideline.operators.points import latest_per_key
from tideline.plans.commits import CommitConflict, CommitLog, Folder, vacuum
from tideline.plans.store import ATTEMPTS, ORPHANED, PointStore, namespace
from tideline.sources import wire

BUCKETS = 128
#: Single inserts that a commit holds at most, and bytes of their values; tables of rows inserted together that are left apart.
INLINE, INLINE_BYTES, TABLES = 64, 1 << 20, 8

ENTRY = "address long, version long, value binary, seq long, batch string, bucket long"
_ROW = "address long, version long, value binary, seq long"


class MutableStore:
    """The keys of a namespace of a store; the namespace needs no registration."""

    def __init__(self, store: PointStore, ns: str):
        self.spark = store.spark
        self.path = f"{store.root}/{namespace(ns)}/mutable"
        self.log = CommitLog(self.spark, f"{self.path}/_commits")

    def _state(self) -> tuple[int, dict]:
        """Number of the next commit; names of tables, and inserts [key, version, value in base 64] that are in none, the latest last."""
        found = self.log.latest()
        return (found[0] + 1, found[1]) if found else (0, {"tables": [], "inline": []})

    def _entries(self, state: dict) -> DataFrame:
        held = [(to_signed(k), to_signed(v), bytearray(base64.b64decode(x)), i) for i, (k, v, x) in enumerate(state["inline"])]
        rows = self.spark.createDataFrame(held, _ROW)
        if state["tables"]:
            base = f"{self.path}/entries"
            stored = self.spark.read.schema(ENTRY).option("basePath", base).parquet(*(f"{base}/batch={t}" for t in state["tables"]))
            rows = stored.select("address", "version", "value", "seq", "bucket").unionByName(rows.withColumn("bucket", place_bucket(F.col("address"), BUCKETS)))
        else:
            rows = rows.withColumn("bucket", place_bucket(F.col("address"), BUCKETS))
        return rows

    def _table(self, version: int, rows: DataFrame) -> str:
        """Write rows (address with bit 0 set, version, value) as a table; its name."""
        name = f"{version:012d}-{uuid.uuid4().hex}"
        placed = rows.select("address", "version", "value", F.lit(version).cast("long").alias("seq"), place_bucket(F.col("address"), BUCKETS).alias("bucket"))
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/entries/batch={name}")
        return name

    def _found(self, state: dict, key: int) -> tuple[bytes, int] | None:
        held = [(v, base64.b64decode(x)) for k, v, x in state["inline"] if k == key | 1]
        if held:
            # Inserts in the commit are later than all tables.
            return held[-1][1], held[-1][0]
        if not state["tables"]:
            return None
        own = self._entries(state | {"inline": []}).filter((F.col("bucket") == (key & ~1) % BUCKETS) & (F.col("address") == F.lit(to_signed(key | 1))))
        rows = latest_per_key(own).collect()
        return (bytes(rows[0].value), to_unsigned(rows[0].version)) if rows else None

    def _merged(self, version: int, state: dict) -> dict:
        return {"tables": [self._table(version, latest_per_key(self._entries(state)))], "inline": []}

    def compact(self) -> None:
        """Merge all tables and single inserts into one table of the latest of each key."""
        version, state = self._state()
        if state["inline"] or len(state["tables"]) > 1:
            self.log.commit(version, self._merged(version, state))

    def vacuum(self, older: float = ORPHANED) -> list[str]:
        """Delete tables that the newest commit does not name, and earlier commits; see PointStore.vacuum."""
        version, state = self._state()
        self.log.forget(version - 1)
        return vacuum(Folder(self.spark, f"{self.path}/entries"), lambda name: name.removeprefix("batch=") in state["tables"], older)

    def lookup(self, key: int) -> bytes | None:
        """The latest value of a key, None without any; an empty value is one."""
        found = self._found(self._state()[1], key)
        return found[0] if found else None

    def insert(self, key: int, value: bytes) -> bytes:
        """Set a key's value."""
        return self.insert_with(lambda new, old: new, key, value)

    def insert_with(self, merge: Callable[[bytes, bytes], bytes], key: int, value: bytes) -> bytes:
        """Set a key's value to merge(value, its present value), or to value without one; returns what is stored."""
        for _ in range(ATTEMPTS):
            version, state = self._state()
            found = self._found(state, key)
            if found and found[1] == MAX_WORD:
                raise OverflowError("the key has its last version")
            stored, at = (merge(value, found[0]), found[1] + 1) if found else (value, 0)
            left = [e for e in state["inline"] if e[0] != key | 1]
            new = state | {"inline": [*left, [key | 1, at, base64.b64encode(stored).decode()]]}
            if len(new["inline"]) > INLINE or sum(len(e[2]) for e in new["inline"]) > INLINE_BYTES:
                new = self._merged(version, new)
            try:
                self.log.commit(version, new)
                return stored
            except CommitConflict:
                continue
        raise CommitConflict(f"other writers were first {ATTEMPTS} times")

    def insert_many(self, rows: DataFrame, order: str = "seq") -> None:
        """Insert rows (address, value and a column of their order) as if one by one; only what is seen of it is stored.

        A key's version grows by the number of its rows. Rows with a null
        address or value are left out; those with a null order come first, and
        of equal ones the greater value counts. Keys are combined before the
        shuffle.
        """
        known = rows.filter(F.col("address").isNotNull() & F.col("value").isNotNull())
        new = known.groupBy(set_bit0(F.col("address")).alias("address")).agg(F.max_by("value", F.struct(order, "value")).alias("value"), F.count("*").alias("n"))
        for _ in range(ATTEMPTS):
            version, state = self._state()
            old = latest_per_key(self._entries(state)).select("address", F.col("version").alias("old"))
            merged = new.join(old, "address", "left").select("address", (F.coalesce(F.col("old"), F.lit(-1).cast("long")) + F.col("n")).alias("version"), "value")
            # Rows of the commit must stay the latest: they go into a table first.
            before = [self._table(version, self._entries(state | {"tables": []}))] if state["inline"] else []
            after = {"tables": [*state["tables"], *before, self._table(version, merged)], "inline": []}
            if len(after["tables"]) > TABLES:
                after = self._merged(version, after)
            try:
                return self.log.commit(version, after)
            except CommitConflict:
                continue
        raise CommitConflict(f"other writers were first {ATTEMPTS} times")

    def enumerate(self) -> DataFrame:
        """address, version, value: the latest of every key."""
        return latest_per_key(self._entries(self._state()[1]))

    def chunks(self) -> Iterator[bytes]:
        """The latest of every key as extended records with the version as time, a chunk per bucket, keys rising in it."""
        latest = self.enumerate().withColumn("bucket", place_bucket(F.col("address"), BUCKETS))
        rows = wire.records(latest.select("bucket", "address", F.col("version").alias("time"), F.col("value").alias("payload")))
        at, held = None, []
        for row in rows.orderBy("bucket", order_key(F.col("address"))).select("bucket", "record").toLocalIterator(prefetchPartitions=True):
            if row.bucket != at and held:
                yield b"".join(held)
                held = []
            at = row.bucket
            held.append(bytes(row.record))
        if held:
            yield b"".join(held)


def folded(entries: DataFrame, merge: Callable[[str], Column]) -> DataFrame:
    """address, version, value of inserting entries (address, value, seq) one by one with a merge that is an aggregate.

    merge is a function of the column's name to an aggregate, such as F.max for
    keeping the greater value. Keys are combined before the shuffle, so none is
    gathered in one task. Rows with a null address or value are left out. A
    merge that is no aggregate goes through insert_with, key by key.
    """
    known = entries.filter(F.col("address").isNotNull() & F.col("value").isNotNull())
    return known.groupBy(set_bit0(F.col("address")).alias("address")).agg((F.count("*") - 1).alias("version"), merge("value").alias("value"))
