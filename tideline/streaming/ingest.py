"""Ingestion of wire blobs and change feeds as streams (beyond what was asked of the store)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.changefeed import ChangeTable
from tideline.plans.store import PointStore


def ingest_blobs(blobs: DataFrame, store: PointStore, ns: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of (batch_id, blob) to a namespace, a commit per micro-batch.

    The stream is known by its checkpoint: a micro-batch that is repeated after
    a failure is written once, since its commit records its number.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.write_blobs(ns, batch, once=(checkpoint, number))

    return blobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_changes(feed: DataFrame, table: ChangeTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of changes to a table, a version per micro-batch; repeats and late changes do no harm."""

    def apply(batch: DataFrame, _: int) -> None:
        table.apply(batch)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
