"""A persistent store of points: namespaces, routed writes, rollover, pruned reads.

A namespace is a folder. Each write adds a batch of Parquet files, partitioned
by epoch and bucket; one commit makes the batch visible together with the index
entries it caused, the latest times and the sizes of the objects. The layout is

    <root>/<namespace>/{simple,extended}/batch=<name>/epoch=<e>/bucket=<b>/*.parquet
    <root>/<namespace>/_commits/<n>.json

A commit says what it adds and removes; every FULL-th holds the whole state, so
a reader opens a bounded number of them. A commit lists the objects of its
batch, so a read names the folders it needs and lists no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.u64 import order_key, to_signed, to_unsigned
from tideline.operators import points as P
from tideline.plans.commits import CommitConflict, CommitLog, Folder, vacuum
from tideline.plans.locks import exclusive, shared, watched
from tideline.plans.routing import Index
from tideline.session import shared_folder, ship
from tideline.sources import wire

#: Bytes of an object of the newest epoch beyond which a new epoch begins.
THRESHOLD = 4 << 20
#: Commits are tried again so often when another writer commits first.
ATTEMPTS = 64
#: Of so many commits one holds the whole state.
FULL = 16
#: Seconds after which files that no commit names may be deleted: longer than any write takes.
ORPHANED = 7 * 86400.0

_DATA = "address long, time long, payload {}, seq long, version long, batch string, epoch long, bucket long"
SCHEMA = {"simple": _DATA.format("long"), "extended": _DATA.format("binary")}
KINDS = ("simple", "extended")


class InvalidNamespace(ValueError):
    """A name that is empty or has an underscore, or a namespace that is not registered."""


def namespace(name: str) -> str:
    """The name, if it is one: not empty, without underscores and path separators."""
    if not name:
        raise InvalidNamespace("a namespace must not be empty")
    if "_" in name or "/" in name or name.startswith("."):
        raise InvalidNamespace(f"a namespace must not have '_' or '/': {name}")
    return name


def is_namespace(name: Column) -> Column:
    """Whether a string is a namespace, as a column; null is none."""
    return F.coalesce((name != "") & ~name.contains("_") & ~name.contains("/") & ~name.startswith("."), F.lit(False))


@dataclass
class Batch:
    """A write: its name, the version that orders it, and per kind the points, bytes and latest time of each of its objects "epoch,bucket"."""

    name: str
    version: int
    objects: dict[str, dict[str, list[int]]]


@dataclass
class Snapshot:
    """State of a namespace at a commit."""

    version: int
    simple: Index
    extended: Index
    latest: dict[str, int]
    #: Visible batches by name.
    batches: dict[str, Batch] = field(default_factory=dict)
    #: Bytes by kind and "epoch,bucket", of all points ever written.
    sizes: dict[str, dict[str, int]] = field(default_factory=lambda: {k: {} for k in KINDS})
    #: Bytes of an object beyond which an epoch ends; None: as the store has it.
    threshold: int | None = None
    #: By stream, the last of its micro-batches that was written.
    done: dict[str, int] = field(default_factory=dict)

    def content(self) -> dict:
        index = {k: getattr(self, k).entries for k in KINDS}
        batches = [[b.name, b.version, b.objects] for b in self.batches.values()]
        return {"index": index, "latest": self.latest, "batches": batches, "sizes": self.sizes, "threshold": self.threshold, "done": self.done}

    @staticmethod
    def of(version: int, c: dict) -> Snapshot:
        index = (Index.of(map(tuple, c["index"][k])) for k in KINDS)
        return Snapshot(version, *index, c["latest"], {b[0]: Batch(*b) for b in c["batches"]}, c["sizes"], c["threshold"], c["done"])

    def change(self, now: Snapshot) -> dict:
        """What makes now into self."""
        gone = [n for n in now.batches if n not in self.batches]
        new = {n: b for n, b in self.batches.items() if n not in now.batches}
        sizes = {k: {o: n for o, n in self.sizes[k].items() if now.sizes[k].get(o) != n} for k in KINDS}
        return replace(self, batches=new, sizes=sizes).content() | {"gone": gone}

    def changed(self, version: int, c: dict) -> Snapshot:
        """The state after a commit that holds a change."""
        after = Snapshot.of(version, c)
        after.batches = {n: b for n, b in self.batches.items() if n not in c["gone"]} | after.batches
        after.sizes = {k: self.sizes[k] | after.sizes[k] for k in KINDS}
        return after


class PointStore:
    """Namespaces below a root folder of any file system Spark can write.

    threshold: of namespaces that were registered without one. write_timeout:
    seconds after which a write is given up; None: never.
    """

    def __init__(self, spark: SparkSession, root: str, threshold: int = THRESHOLD, write_timeout: float | None = None):
        self.spark, self.root, self.threshold, self.write_timeout = spark, root.rstrip("/"), threshold, write_timeout
        ship(spark)

    def __enter__(self) -> PointStore:
        return self

    def __exit__(self, *_) -> None:
        """Nothing is held open between calls."""

    @staticmethod
    def temporary(spark: SparkSession, threshold: int = THRESHOLD) -> PointStore:
        """A store in a new shared folder, for tests."""
        return PointStore(spark, f"{shared_folder(spark)}/store", threshold)

    def _path(self, ns: str) -> str:
        return f"{self.root}/{namespace(ns)}"

    def _log(self, ns: str) -> CommitLog:
        return CommitLog(self.spark, f"{self._path(ns)}/_commits")

    # Registration and metadata.

    def is_registered(self, ns: str) -> bool:
        return bool(self._log(ns).versions())

    def register(self, ns: str, simple_buckets: int, extended_buckets: int, threshold: int | None = None) -> bool:
        """Create a namespace with epoch 0; False, and nothing changes, if it exists. threshold: its own, in bytes."""
        first = Snapshot(0, Index.of([(0, simple_buckets)]), Index.of([(0, extended_buckets)]), dict.fromkeys(KINDS, 0), threshold=threshold)
        try:
            if self.is_registered(ns):
                return False
            self._log(ns).commit(0, first.content())
        except CommitConflict:
            return False
        return True

    def snapshot(self, ns: str) -> Snapshot:
        """The newest state; InvalidNamespace if there is none."""
        log = self._log(ns)
        versions = log.versions()
        if not versions:
            raise InvalidNamespace(f"not registered: {ns}")
        full = versions[-1] // FULL * FULL
        now = Snapshot.of(full, log.read(full))
        for version in range(full + 1, versions[-1] + 1):
            now = now.changed(version, log.read(version))
        return now

    def index(self, ns: str, kind: str = "simple") -> Index | None:
        return getattr(self.snapshot(ns), kind) if self.is_registered(ns) else None

    def latest(self, ns: str) -> dict[str, int]:
        """Latest time of all points (simple) and of extended points."""
        return self.snapshot(ns).latest

    def describe(self, ns: str) -> DataFrame:
        """kind, epoch, bucket, n, bytes of every object."""
        now = self.snapshot(ns)
        return P.bucket_sizes(self._read(ns, now, "simple"), self._read(ns, now, "extended"), now.simple, now.extended)

    # Writing.

    def write_encoded(self, ns: str, blob: bytes) -> None:
        """Write a blob of records in wire form; InvalidPayload, and nothing is written, if it is cut short."""
        rows = pa.Table.from_batches(wire.decoded(0, blob), wire.ARROW)
        decoded = self.spark.createDataFrame(rows, wire.DECODED) if rows.num_rows else self.spark.createDataFrame([], wire.DECODED)
        self.write(ns, wire.simple_points(decoded), wire.extended_points(decoded))

    def write_blobs(self, ns: str, blobs: DataFrame, once: tuple[str, int] | None = None) -> None:
        """Write blobs (batch_id, blob) as one batch; earlier batch_ids are written first. once: see write."""
        decoded = wire.decode(blobs)
        self.write(ns, wire.simple_points(decoded), wire.extended_points(decoded), once)

    def write(self, ns: str, simple: DataFrame | None = None, extended: DataFrame | None = None, once: tuple[str, int] | None = None) -> Snapshot:
        """Write simple and extended points (address, time, payload, seq) as one batch.

        seq, any LONG, orders the points within the batch and is kept whole;
        points of earlier writes come first. Points with a null address or
        time, or of the other kind, are not written. once: name of a stream and
        number of a part of it; parts up to the last one written are left out.

        Data is written once. If another writer commits first, the batch takes
        its place behind that one; only if that began a new epoch, the written
        points are located anew.
        """
        now = self.snapshot(ns)
        if once and now.done.get(once[0], -1) >= once[1]:
            return now
        rows = {k: P.of_kind(d, k == "extended").select("address", "time", "payload", "seq") for k, d in (("simple", simple), ("extended", extended)) if d is not None}
        with shared(self.spark, self._path(ns), "_write_lock"), watched(self.spark, self.write_timeout):
            batch = self._written(ns, now, rows)
            routed = now

            def after(now: Snapshot) -> Snapshot | None:
                nonlocal batch, routed
                if once and now.done.get(once[0], -1) >= once[1]:
                    return None
                if any(getattr(now, k) != getattr(routed, k) for k in rows):
                    here = Snapshot(0, now.simple, now.extended, {}, {batch.name: batch})
                    batch, routed = self._written(ns, now, {k: self._read(ns, here, k).drop("version") for k in rows}), now
                result = self._after(now, batch)
                if once:
                    result.done = result.done | {once[0]: once[1]}
                return result

            return self._commit(ns, after)

    def _commit(self, ns: str, after: Callable[[Snapshot], Snapshot | None]) -> Snapshot:
        """Commit what comes after the newest state, whichever that is by then; None commits nothing."""
        log = self._log(ns)
        for _ in range(ATTEMPTS):
            now = self.snapshot(ns)
            result = after(now)
            if result is None:
                return now
            result.version = now.version + 1
            try:
                log.commit(result.version, result.content() if result.version % FULL == 0 else result.change(now))
                return result
            except CommitConflict:
                continue
        raise CommitConflict(f"{ns}: other writers were first {ATTEMPTS} times")

    def _written(self, ns: str, now: Snapshot, rows: dict[str, DataFrame]) -> Batch:
        """Write points below a new name, located by the index of now; nothing mentions it yet."""
        batch = Batch(uuid.uuid4().hex, -1, {})
        for kind, points in rows.items():
            version = F.col("version") if "version" in points.columns else F.lit(None).cast("long").alias("version")
            own = points.select("address", "time", "payload", F.col("seq").cast("long").alias("seq"), version)
            # Rebalancing splits an object that most points belong to over tasks and files, and joins small ones.
            located = getattr(now, kind).located(own).hint("rebalance", "epoch", "bucket")
            located.sortWithinPartitions("epoch", "bucket", order_key(F.col("time"))).write.partitionBy("epoch", "bucket").parquet(f"{self._path(ns)}/{kind}/batch={batch.name}")
            batch.objects[kind] = self._summary(ns, batch.name, kind)
        return batch

    def _summary(self, ns: str, batch: str, kind: str) -> dict[str, list[int]]:
        """Points, bytes and latest time of each object that the batch writes to: as many rows as it has folders."""
        size = F.lit(P.POINT_BYTES).cast("long") if kind == "simple" else P.payload_bytes() + P.LENGTH_BYTES
        base = f"{self._path(ns)}/{kind}"
        rows = self.spark.read.schema(SCHEMA[kind]).option("basePath", base).parquet(f"{base}/batch={batch}")
        found = rows.groupBy("epoch", "bucket").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), order_key(F.max(order_key(F.col("time")))).alias("latest"))
        return {f"{to_unsigned(r.epoch)},{r.bucket}": [r.n, r.bytes, to_unsigned(r.latest)] for r in found.collect()}

    def _after(self, now: Snapshot, batch: Batch) -> Snapshot:
        """The state after a batch, with an index entry where an object of the newest epoch grew too large.

        A simple object counts with what the batch adds, if it adds simple
        points; an extended one with what it had before the batch.
        """
        sizes = {k: dict(v) for k, v in now.sizes.items()}
        latest = dict(now.latest)
        for kind, objects in batch.objects.items():
            for key, (n, size, last) in objects.items():
                sizes[kind][key] = sizes[kind].get(key, 0) + size
                if kind == "extended":
                    sizes["simple"][key] = sizes["simple"].get(key, 0) + n * P.POINT_BYTES
                    latest["extended"] = max(latest["extended"], last)
                latest["simple"] = max(latest["simple"], last)
        index = {k: getattr(now, k) for k in KINDS}
        threshold = self.threshold if now.threshold is None else now.threshold
        for kind, before in (("simple", sizes), ("extended", now.sizes)):
            epoch, n = index[kind].newest()
            touched = [key for key in batch.objects.get(kind, {}) if key.startswith(f"{epoch},")]
            largest = max((before[kind].get(key, 0) for key in touched), default=0)
            if largest > threshold and latest[kind] not in dict(index[kind].entries):
                index[kind] = index[kind].with_entry(latest[kind], n)
        batch.version = now.version + 1
        return Snapshot(now.version + 1, index["simple"], index["extended"], latest, now.batches | {batch.name: batch}, sizes, now.threshold, now.done)

    # Upkeep.

    def compact(self, ns: str) -> Snapshot:
        """Write all visible batches anew as one, in fewer files; writes that come in between stay as they are."""
        with exclusive(self.spark, self._path(ns), "_compact_lock"):
            now = self.snapshot(ns)
            if len(now.batches) < 2:
                return now
            one = self._written(ns, now, {k: self.points(ns, k == "extended", now).drop("epoch", "bucket") for k in KINDS if any(b.objects.get(k) for b in now.batches.values())})
            # Its points carry the versions of their writes.
            one.version = max(b.version for b in now.batches.values())

            def after(then: Snapshot) -> Snapshot:
                left = {n: b for n, b in then.batches.items() if n not in now.batches}
                return replace(then, batches={one.name: one} | left)

            return self._commit(ns, after)

    def vacuum(self, ns: str, older: float = ORPHANED) -> list[str]:
        """Delete batches that no commit names any more, or never did, and commits before the last whole state.

        Only what was not changed for `older` seconds goes, which must be more
        than any write or read takes. Gives the names of what is gone.
        """
        now, gone = self.snapshot(ns), []
        for kind in KINDS:
            folder = Folder(self.spark, f"{self._path(ns)}/{kind}")
            gone += vacuum(folder, lambda name: name.removeprefix("batch=") in now.batches, older)
        self._log(ns).forget(now.version // FULL * FULL)
        return gone

    # Reading.

    def _read(self, ns: str, now: Snapshot, kind: str, wanted: Callable[[int, int], bool] = lambda epoch, bucket: True) -> DataFrame:
        """Points of a kind with seq, version, epoch and bucket, from the folders of the wanted objects."""
        base = f"{self._path(ns)}/{kind}"
        paths = []
        for b in now.batches.values():
            keys = [tuple(map(int, key.split(","))) for key in b.objects.get(kind, {})]
            chosen = [k for k in keys if wanted(*k)]
            if len(chosen) == len(keys) and keys:
                paths.append(f"{base}/batch={b.name}")
            else:
                paths += [f"{base}/batch={b.name}/epoch={to_signed(e)}/bucket={bucket}" for e, bucket in chosen]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA[kind]).drop("batch")
        rows = self.spark.read.schema(SCHEMA[kind]).option("basePath", base).parquet(*paths)
        # One row per visible batch, which compaction keeps few.
        known = self.spark.createDataFrame([(b.name, b.version) for b in now.batches.values()], "batch string, written long")
        rows = rows.join(F.broadcast(known), "batch")
        return rows.withColumn("version", F.coalesce("version", "written")).drop("batch", "written")

    def points(self, ns: str, extended: bool = False, at: Snapshot | None = None) -> DataFrame:
        """All visible points as written: address, time, payload, seq, version of the write, epoch, bucket."""
        return self._read(ns, at or self.snapshot(ns), "extended" if extended else "simple")

    def _found(self, ns: str, start: int, end: int, addresses: P.Addresses, extended: bool) -> tuple[DataFrame, Index]:
        now = self.snapshot(ns)
        kind = "extended" if extended else "simple"
        index: Index = getattr(now, kind)
        if isinstance(addresses, DataFrame):
            epochs = {e for e, _ in index.in_range(start, end)}
            rows = self._read(ns, now, kind, lambda e, b: e in epochs)
        else:
            targets = {e: set(buckets) for e, buckets in index.targets(start, end, addresses)}
            rows = self._read(ns, now, kind, lambda e, b: b in targets.get(e, ()))
        # The order over all writes: by write, then by seq within it, in one number that hashed aggregates can hold.
        order = F.col("version").cast("decimal(17,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.col("seq").cast("decimal(19,0)")
        return P.read(rows.withColumn("seq", order), start, end, addresses, extended, index), index

    def read_simple(self, ns: str, start: int, end: int, addresses: P.Addresses) -> DataFrame:
        """address, time, payload of the simple points of the addresses with start <= time <= end."""
        return self._found(ns, start, end, addresses, False)[0]

    def read_extended(self, ns: str, start: int, end: int, addresses: P.Addresses) -> DataFrame:
        """address, time, payload (bytes) of the extended points of the addresses with start <= time <= end."""
        return self._found(ns, start, end, addresses, True)[0]

    def located_chunks(self, ns: str, start: int, end: int, addresses: Sequence[int], extended: bool = False) -> DataFrame:
        """The points of a read with their record and e, b, the place of their object: by epoch, then by the first address that names its bucket."""
        rows, index = self._found(ns, start, end, addresses, extended)
        place = [(to_signed(epoch), b, e, i) for e, (epoch, buckets) in enumerate(index.targets(start, end, addresses)) for i, b in enumerate(buckets)]
        order = self.spark.createDataFrame(place, "epoch long, bucket long, e int, b int")
        return wire.records(index.located(rows).join(F.broadcast(order), ["epoch", "bucket"]))

    def chunks(self, ns: str, start: int, end: int, addresses: Sequence[int], extended: bool = False) -> Iterator[bytes]:
        """The points of a read in wire form, a chunk per object that has any.

        Chunks come by epoch, then by the first address that names their
        bucket; within a chunk points are by (time, address). Objects are
        fetched ahead by Spark's tasks.
        """
        ordered = self.located_chunks(ns, start, end, addresses, extended).orderBy("e", "b", order_key(F.col("time")), order_key(F.col("address")))
        at, held = None, []
        for row in ordered.select("e", "b", "record").toLocalIterator(prefetchPartitions=True):
            if (row.e, row.b) != at and held:
                yield b"".join(held)
                held = []
            at = (row.e, row.b)
            held.append(bytes(row.record))
        if held:
            yield b"".join(held)
