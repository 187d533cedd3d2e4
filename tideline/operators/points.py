"""Reads and summaries of points: address, time, payload and seq, the order of writing.

Points are rows of LONG words (see tideline.functions.u64); payload is LONG for
simple points, BINARY for extended ones. Rows with a null address or time are
no points. Other columns of a table are dropped by these operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.u64 import between, is_extended, order_key, set_bit0, to_signed
from tideline.plans.routing import Index
from tideline.session import fresh

#: Addresses up to which a read filters by a list of literals; beyond, by a join.
LISTED = 500

Addresses = Sequence[int] | DataFrame


def of_kind(points: DataFrame, extended: bool) -> DataFrame:
    """Points whose address has the parity of the kind."""
    return points.filter(F.col("address").isNotNull() & F.col("time").isNotNull() & (is_extended(F.col("address")) == F.lit(extended)))


def at_addresses(points: DataFrame, addresses: Addresses) -> DataFrame:
    """Points of the given addresses: ints as words, or a DataFrame with a column address, however large. An empty list gives none."""
    if isinstance(addresses, DataFrame):
        return points.join(addresses.select("address").distinct(), "address", "left_semi")
    words = [to_signed(a) for a in dict.fromkeys(addresses)]
    if not words:
        return points.filter(F.lit(False))
    if len(words) <= LISTED:
        return points.filter(F.col("address").isin(*words))
    listed = points.sparkSession.createDataFrame([(w,) for w in words], "address long")
    return points.join(listed, "address", "left_semi")


def first_written(points: DataFrame) -> DataFrame:
    """address, time, payload: of the points of an (address, time) the one with the least seq.

    Partial and final aggregation around one exchange, by hashing for LONG
    payloads. A null payload that was written first stays null.
    """
    return points.groupBy("address", "time").agg(F.min_by("payload", "seq").alias("payload"))


def read(points: DataFrame, start: int, end: int, addresses: Addresses, extended: bool = False, index: Index | None = None) -> DataFrame:
    """Points of the addresses with start <= time <= end (words), first written of each (address, time).

    With an index, points must have the columns epoch and bucket, and only the
    partitions that the read can need are scanned. Addresses of the other kind
    give no rows.
    """
    if index is not None:
        points = points.filter(index.partitions(start, end, None if isinstance(addresses, DataFrame) else addresses))
    inside = of_kind(points, extended).filter(between(F.col("time"), start, end))
    return first_written(at_addresses(inside, addresses).select("address", "time", "payload", "seq"))


def in_order(points: DataFrame) -> DataFrame:
    """Points by (time, address), as words."""
    return points.orderBy(order_key(F.col("time")), order_key(F.col("address")))


def newest_first(points: DataFrame) -> DataFrame:
    """Points by address, of each the newest first."""
    return points.orderBy(order_key(F.col("address")), order_key(F.col("time")).desc())


def newest(points: DataFrame, n: int) -> DataFrame:
    """Of each address the n newest points, with rank from 1 on; of equal times those written first.

    points: address, time and seq; other columns stay. Tasks keep n points of
    an address each before the shuffle, so no address is a hot spot.
    """
    (rank,) = fresh(points, "rank")
    order = Window.partitionBy("address").orderBy(order_key(F.col("time")).desc(), F.col("seq").asc_nulls_last())
    known = points.filter(F.col("address").isNotNull() & F.col("time").isNotNull())
    return known.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def latest_times(points: DataFrame) -> DataFrame:
    """One row latest_simple, latest_extended: an extended point counts for both, 0 without any."""
    known = points.filter(F.col("address").isNotNull() & F.col("time").isNotNull())
    key = order_key(F.col("time"))

    def latest(c: Column) -> Column:
        return F.coalesce(order_key(F.max(c)), F.lit(0).cast("long"))

    return known.agg(latest(key).alias("latest_simple"), latest(F.when(is_extended(F.col("address")), key)).alias("latest_extended"))


def split_kinds(points: DataFrame) -> DataFrame:
    """Number of points by kind: extended, n."""
    return points.filter(F.col("address").isNotNull()).groupBy(is_extended(F.col("address")).alias("extended")).agg(F.count("*").alias("n"))


#: Bytes of a simple point or pointer, and of the length before a payload.
POINT_BYTES, LENGTH_BYTES = 24, 8


def payload_bytes() -> Column:
    """Length of an extended payload; a null one has none."""
    return F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")


def bucket_sizes(simple: DataFrame, extended: DataFrame, simple_index: Index, extended_index: Index) -> DataFrame:
    """kind, epoch, bucket, n, bytes of every object the points make.

    A simple object has its simple points and, since pointers are kept beside
    them, a point's bytes for every extended point that the extended index
    locates there.
    """
    s = simple_index.located(of_kind(simple, False)).select("epoch", "bucket", F.lit(POINT_BYTES).cast("long").alias("bytes"))
    e = extended_index.located(of_kind(extended, True)).select("epoch", "bucket", (payload_bytes() + LENGTH_BYTES).alias("bytes"))
    p = e.select("epoch", "bucket", F.lit(POINT_BYTES).cast("long").alias("bytes"))
    total = [F.count("*").alias("n"), F.sum("bytes").alias("bytes")]
    objects = s.unionByName(p).groupBy("epoch", "bucket").agg(*total).withColumn("kind", F.lit("simple"))
    heaps = e.groupBy("epoch", "bucket").agg(*total).withColumn("kind", F.lit("extended"))
    return objects.unionByName(heaps).select("kind", "epoch", "bucket", "n", "bytes")


def sizes_at(sizes: DataFrame, objects: DataFrame) -> DataFrame:
    """kind, epoch, bucket of the asked objects with their bytes, 0 of those that are not there."""
    found = objects.join(sizes.select("kind", "epoch", "bucket", "bytes"), ["kind", "epoch", "bucket"], "left")
    return found.withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))


def object_pairs(sizes: DataFrame) -> DataFrame:
    """epoch, bucket, simple_bytes, extended_bytes of places that have objects of both kinds."""
    own = {k: sizes.filter(F.col("kind") == k).select("epoch", "bucket", F.col("bytes").alias(f"{k}_bytes")) for k in ("simple", "extended")}
    return own["simple"].join(own["extended"], ["epoch", "bucket"])


def rollover_candidates(sizes: DataFrame, index: Index, threshold: int) -> DataFrame:
    """Objects of the newest epoch that are larger than the threshold."""
    return sizes.filter((F.col("epoch") == F.lit(to_signed(index.newest()[0]))) & (F.col("bytes") > threshold))


def with_offsets(extended: DataFrame, index: Index) -> DataFrame:
    """Extended points with epoch, bucket and off, the place of each payload in its heap.

    The running sum of an object is bounded by the object, which rollover keeps
    near the threshold.
    """
    w = Window.partitionBy("epoch", "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return index.located(of_kind(extended, True)).withColumn("off", F.coalesce(F.sum(payload_bytes() + LENGTH_BYTES).over(w), F.lit(0).cast("long")))


def latest_per_key(entries: DataFrame) -> DataFrame:
    """address, version, value: of every key the entry of the highest version, of ties the first written, then the least value.

    entries: address, version, value, seq. 2k and 2k+1 are the same key, given
    as 2k+1. Versions are words. Null addresses or versions are no entries.
    """
    known = entries.filter(F.col("address").isNotNull() & F.col("version").isNotNull())
    rank = F.struct((-1 - order_key(F.col("version"))).alias("v"), F.col("seq"), F.col("value"))
    best = F.min_by(F.struct("version", "value"), rank)
    return known.groupBy(set_bit0(F.col("address")).alias("address")).agg(best.alias("best")).select("address", "best.version", "best.value")
