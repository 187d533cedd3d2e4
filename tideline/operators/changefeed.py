"""Rebuilding a table from its change feed: one embedded DuckDB per bucket.

Keys are hashed into buckets. Every bucket is a DuckDB table with the key as
primary key; a batch of changes is upserted with a conditional conflict update
that keeps whichever of the stored and the offered change was committed later
at the origin. Order of delivery and repeats so make no difference. A delete is
kept as a tombstone with its sequence, or a late older insert would revive the
row. Each task first upserts its own rows, so a key changed a million times is
shuffled once per block. The buckets that a feed touches are exported anew, and
a single commit publishes them all as the next version of the table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.arrow_blocks import blocks, whole_groups
from tideline.plans.commits import CommitConflict, CommitLog, Folder, vacuum
from tideline.session import materialise, shared_folder, ship, shuffle_partitions

#: Spellings of operations, after trimming and lower-casing. Anything else changes nothing.
SETS = ("i", "ins", "insert", "u", "upd", "update")
DELETES = ("d", "del", "delete")

#: Changes that a task upserts into one table before anything is shuffled.
BLOCK_ROWS = 1 << 19
#: Rows from which on whole buckets are put into one table.
TABLE_ROWS = 1 << 18
#: Buckets in a part of the table, and rows per part from which on the table gets twice as many parts: a bucket stays small.
BUCKETS, PART_ROWS = 64, 1 << 22
#: Memory of an embedded database; a bucket needs a small part of it.
MEMORY = "1GB"

#: A feed is applied again so often when another writer publishes first.
ATTEMPTS = 8

STATE = "address long, time long, payload long, change_seq long, deleted boolean"

_CREATE = """
CREATE TABLE state (
  address BIGINT, time BIGINT, payload BIGINT, change_seq BIGINT, deleted BOOLEAN,
  PRIMARY KEY (address, time))
"""
#: Within one command a key may be offered once: the latest of the batch is.
#: Changes of one key and sequence are the same commit; if they differ after
#: all, a delete counts before a payload, the higher payload before a lower.
_UPSERT = """
INSERT INTO state
SELECT address, time, best.payload, best.change_seq, best.deleted FROM (
  SELECT address, time, max({'change_seq': change_seq, 'deleted': deleted, 'known': payload IS NOT NULL, 'payload': payload}) AS best
  FROM offered GROUP BY address, time)
ON CONFLICT (address, time) DO UPDATE
SET payload = excluded.payload, change_seq = excluded.change_seq, deleted = excluded.deleted
WHERE excluded.change_seq > state.change_seq
   OR (excluded.change_seq = state.change_seq
       AND (excluded.deleted, excluded.payload IS NOT NULL, coalesce(excluded.payload, 0))
         > (state.deleted, state.payload IS NOT NULL, coalesce(state.payload, 0)))
"""
_EXPORT = "SELECT * FROM state"
_COLUMNS = ["address", "time", "payload", "change_seq", "deleted"]


class Bucket:
    """Current rows and tombstones of a set of keys, in memory."""

    def __init__(self):
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        self.db.sql(_CREATE)

    def upsert(self, changes: pa.Table) -> None:
        self.db.register("offered", changes)
        self.db.sql(_UPSERT)
        self.db.unregister("offered")

    def export(self) -> pa.Table:
        return self.db.sql(_EXPORT).to_arrow_table().select(_COLUMNS)

    def close(self) -> None:
        self.db.close()


def _upserted(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """One table per element; the rows that are left of it."""
    for table in tables:
        bucket = Bucket()
        try:
            for batch in table.select(_COLUMNS).combine_chunks().to_batches(max_chunksize=1 << 17):
                bucket.upsert(pa.Table.from_batches([batch]))
            yield from bucket.export().combine_chunks().to_batches(max_chunksize=1 << 17)
        finally:
            bucket.close()


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _upserted(blocks(batches, BLOCK_ROWS))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _upserted(whole_groups(batches, "bucket", TABLE_ROWS))


def changes_of(feed: DataFrame, op: str = "op") -> DataFrame:
    """The rows of a feed that change something, as rows of the state.

    feed: op STRING, address, time, payload, change_seq LONG; other columns are
    not read. Rows with a null key, a null sequence or an operation that is
    neither a set nor a delete (heartbeats, null) change nothing. A set with a
    null payload is a row whose payload is null; a delete's payload is ignored.
    """
    kind: Column = F.lower(F.trim(F.col(op)))
    deleted = kind.isin(*DELETES)
    return feed.filter(
        kind.isin(*SETS, *DELETES) & F.col("address").isNotNull() & F.col("time").isNotNull() & F.col("change_seq").isNotNull()
    ).select("address", "time", F.when(~deleted, F.col("payload")).alias("payload"), "change_seq", deleted.alias("deleted"))


def part_of(parts: int) -> Column:
    """The part of the table that a key belongs to."""
    return F.pmod(F.xxhash64("address", "time"), F.lit(parts)).cast("int")


def upsert(changes: DataFrame, state: DataFrame | None = None, parts: int | None = None, settled: bool = False) -> DataFrame:
    """State (rows and tombstones) after the changes, each taken once in order of commit; one partition per part.

    settled: the changes are those that tasks left of their own rows.
    """
    n = parts or shuffle_partitions(changes.sparkSession)
    latest = changes if settled else changes.mapInArrow(_local, STATE)
    if state is not None:
        latest = latest.unionByName(state.select(*_COLUMNS))
    bucket = F.pmod(F.xxhash64("time", "address"), F.lit(BUCKETS))
    return latest.withColumn("bucket", bucket).repartitionById(n, part_of(n)).sortWithinPartitions("bucket").mapInArrow(_by_bucket, STATE)


class ChangeTable:
    """A table kept from change feeds, in versions that are published whole.

    Keys are hashed into parts, at first as many as there are shuffle
    partitions (or `parts`), and more for a feed of more than PART_ROWS rows a
    part; when the table has outgrown them it is written anew in twice as many.
    Otherwise a call of apply reads the current state of those parts that its
    feed touches, upserts the feed into it and writes them below a new name;
    the commit that says which name holds each part is the only thing a reader
    looks at. Applying a feed again, or parts of it in another order, leads to
    the same table.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None):
        self.spark, self.path, self._parts = spark, path.rstrip("/"), parts
        self.log = CommitLog(spark, f"{self.path}/_commits")
        ship(spark)

    def _read(self, held: dict[str, list]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*(f"{self.path}/{data}/part={part}" for part, (data, _) in held.items()))

    def state(self) -> DataFrame:
        """Rows and tombstones of the newest version; empty before the first."""
        found = self.log.latest()
        return self._read(found[1]["held"] if found else {})

    def rows(self) -> DataFrame:
        """The table: address, time, payload and the change_seq behind each row."""
        return self.state().filter(~F.col("deleted")).select("address", "time", "payload", "change_seq")

    def apply(self, feed: DataFrame) -> int:
        """Apply a feed; the version published.

        If another writer is first, the feed is upserted into what that left.
        """
        changes, own = changes_of(feed), None
        for _ in range(ATTEMPTS):
            found = self.log.latest()
            if found is None:
                # Every part is new, so nothing needs to be known of the feed but about how long it is.
                version, parts, held = 0, self._parts or max(shuffle_partitions(self.spark, feed), -(-feed.count() // PART_ROWS)), {}
                result = upsert(changes, None, parts)
            else:
                version, parts, held = found[0] + 1, found[1]["parts"], found[1]["held"]
                # What tasks leave of the feed, written once: it is asked which parts it touches, and then upserted.
                own = own or materialise(changes.mapInArrow(_local, STATE), "changes")
                touched = {str(r.part): r.n for r in own.groupBy(part_of(parts).alias("part")).agg(F.count("*").alias("n")).collect()}
                rows = sum(touched.values()) + sum(n for _, n in held.values())
                before = {p: held[p] for p in touched if p in held}
                if rows > PART_ROWS * parts:
                    parts, before, held = parts * 2 ** math.ceil(math.log2(rows / PART_ROWS / parts)), held, {}
                result = upsert(own, self._read(before), parts, settled=True) if touched else None
            if result is not None:
                data = f"data-{uuid.uuid4().hex}"
                result.withColumn("part", part_of(parts)).write.partitionBy("part").parquet(f"{self.path}/{data}")
                # By the folders' names and the files' own counts; as many rows as parts.
                new = self.spark.read.schema(f"{STATE}, part int").parquet(f"{self.path}/{data}").groupBy("part").count().collect()
                held = held | {str(r.part): [data, r["count"]] for r in new}
            try:
                self.log.commit(version, {"parts": parts, "held": held})
                return version
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.path}: other writers were first {ATTEMPTS} times")

    def vacuum(self, older: float = 7 * 86400.0) -> list[str]:
        """Delete data that the newest version does not hold and that is older than so many seconds, and earlier versions."""
        found = self.log.latest()
        if found is None:
            return []
        self.log.forget(found[0])
        kept = {data for data, _ in found[1]["held"].values()}
        return vacuum(Folder(self.spark, self.path), lambda name: name in kept or not name.startswith("data-"), older)


def current_rows(feed: DataFrame) -> DataFrame:
    """The table a whole feed leads to: address, time, payload, change_seq.

    Builds, publishes and reads a ChangeTable in the shared folder. An empty
    feed gives an empty table; see changes_of for nulls.
    """
    spark = feed.sparkSession
    table = ChangeTable(spark, f"{shared_folder(spark)}/changes")
    table.apply(feed)
    return table.rows()
