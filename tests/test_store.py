from __future__ import annotations

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tideline.functions.u64 import MAX_WORD
from tideline.plans.commits import CommitConflict, CommitLog
from tideline.plans.locks import LockTimeout, WriteTimeout, exclusive, shared
from tideline.plans.mutable import MutableStore
from tideline.plans.routing import Index
from tideline.plans.store import FULL, InvalidNamespace, PointStore
from tideline.sources import wire
from tideline.streaming.ingest import ingest_blobs, ingest_changes

SIMPLES = [(0, 0, 0), (2, 2, 0), (4, 4, 0), (8, 8, 0)]
MORE = [(0, 10, 0), (4, 20, 0), (14, 18, 0), (6, 15, 0)]
EXTENDED = [(1, 1, b"hai"), (1, 2, b"there"), (3, 1, b"pony")]


def blob(points):
    return b"".join(wire.build(*p) for p in points)


def parsed(chunk):
    return [(a, t, p if d is None else d) for a, t, p, d in wire.parse(chunk)]


def rows(df):
    return sorted((r.address % 2**64, r.time % 2**64, bytes(r.payload) if isinstance(r.payload, (bytes, bytearray)) else r.payload % 2**64) for r in df.collect())


@pytest.fixture
def store(spark):
    return PointStore.temporary(spark, threshold=0)


def test_register(store):
    assert not store.is_registered("PONIES") and store.index("PONIES") is None
    assert store.register("PONIES", 10, 20)
    assert not store.register("PONIES", 1, 1)
    assert store.index("PONIES") == Index.of([(0, 10)]) and store.index("PONIES", "extended") == Index.of([(0, 20)])
    for bad in ("", "a_b", "a/b"):
        with pytest.raises(InvalidNamespace):
            store.register(bad, 1, 1)
    with pytest.raises(ValueError):
        store.register("zero", 0, 1)
    with pytest.raises(InvalidNamespace):
        store.read_simple("absent", 0, 1, [2])


def test_mixed_write(store):
    store.register("N", 4, 3)
    store.write_encoded("N", blob(SIMPLES + EXTENDED))
    now = store.snapshot("N")
    assert now.latest == {"simple": 8, "extended": 2}
    assert now.simple == Index.of([(0, 4), (8, 4)]) and now.extended == Index.of([(0, 3)])
    # Pointers are located by the extended index: one with two points, one with one.
    assert now.sizes["extended"] == {"0,0": 24, "0,2": 12}
    assert now.sizes["simple"] == {"0,0": 24 * 3 + 24 * 2, "0,2": 24 + 24}
    found = {(r.kind, r.epoch, r.bucket): (r.n, r.bytes) for r in store.describe("N").collect()}
    assert found["extended", 0, 0] == (2, 24) and found["simple", 0, 0] == (5, 120)


def test_read_simple_in_chunks(store):
    store.register("N", 10, 20)
    store.write_encoded("N", blob(SIMPLES))
    store.write_encoded("N", blob(MORE))
    assert list(store.chunks("N", 0, 21, [])) == []
    assert [parsed(c) for c in store.chunks("N", 0, 21, [2])] == [[(2, 2, 0)]]
    chunks = [parsed(c) for c in store.chunks("N", 0, 21, [14, 4, 6, 8])]
    assert chunks == [[(4, 4, 0)], [(8, 8, 0)], [(14, 18, 0), (4, 20, 0)], [(6, 15, 0)]]
    assert rows(store.read_simple("N", 8, 21, [4, 14, 6])) == sorted([(14, 18, 0), (4, 20, 0), (6, 15, 0)])
    assert rows(store.read_simple("N", 0, 21, [3, 15])) == []
    store.spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = store.read_simple("N", 8, 21, [4])._jdf.queryExecution().executedPlan().toString()
    pruned, pushed = (plan.split(f"{k}Filters: [")[1].split("]")[0] for k in ("Partition", "Pushed"))
    assert "epoch" in pruned and "bucket" in pruned and "address" in pushed and "time" in pushed
    # Only folders of the objects that the read needs are named at all.
    assert all("/epoch=8/bucket=4" in p for p in store._found("N", 9, 21, [4], False)[0].inputFiles())
    assert "SortAggregate" not in plan


def test_read_extended(store):
    store.register("N", 5, 10)
    store.write_encoded("N", blob(EXTENDED))
    assert [parsed(c) for c in store.chunks("N", 0, 21, [1], extended=True)] == [EXTENDED[:2]]
    assert [parsed(c) for c in store.chunks("N", 0, 21, [1, 3], extended=True)] == [EXTENDED[:2], EXTENDED[2:]]
    assert rows(store.read_extended("N", 0, 21, [2])) == []


def test_extended_after_simple_rollover(store):
    store.register("N", 4, 5)
    store.write_encoded("N", blob([(6, 6, 3)]))
    store.write_encoded("N", blob([(7, 7, b"yayyy")]))
    assert rows(store.read_extended("N", 0, MAX_WORD, [7])) == [(7, 7, b"yayyy")]
    assert store.index("N", "extended") == Index.of([(0, 5)])  # sizes before the write count
    store.write_encoded("N", blob([(7, 9, b"more")]))
    assert store.index("N", "extended") == Index.of([(0, 5), (9, 5)])


def test_cut_blob_writes_nothing(store):
    store.register("N", 4, 5)
    for bad in (blob(SIMPLES)[:-1], blob(EXTENDED)[:-1], wire.struct.pack("<QQQ", 1, 1, 2**64 - 1)):
        with pytest.raises(wire.InvalidPayload):
            store.write_encoded("N", bad)
    assert store.snapshot("N").version == 0
    store.write_encoded("N", b"")
    assert store.snapshot("N").latest == {"simple": 0, "extended": 0} and store.points("N").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_no_point_is_lost(spark, seed):
    r = random.Random(seed)
    store = PointStore.temporary(spark, threshold=r.choice([0, 200, 4000]))
    store.register("N", r.randint(1, 20), r.randint(1, 20))
    points = []
    for _ in range(120):
        a, t = r.choice([r.randint(0, 9), r.randint(0, MAX_WORD)]), r.choice([r.randint(0, 99), r.randint(0, MAX_WORD)])
        points.append((a, t, r.randbytes(r.randint(0, 30)) if a & 1 else r.randint(0, MAX_WORD)))
    for k in range(0, len(points), 40):
        store.write_encoded("N", blob(points[k : k + 40]))
    first = {}
    for a, t, p in points:
        first.setdefault((a, t), p)
    addresses = list({a for a, _, _ in points})
    assert rows(store.read_simple("N", 0, MAX_WORD, addresses)) == sorted((a, t, p) for (a, t), p in first.items() if not a & 1)
    assert rows(store.read_extended("N", 0, MAX_WORD, addresses)) == sorted((a, t, p) for (a, t), p in first.items() if a & 1)
    assert sum((parsed(c) for c in store.chunks("N", 0, MAX_WORD, addresses)), []) and store.latest("N")["simple"] == max(t for _, t, _ in points)


def test_racing_writers(store):
    store.register("N", 4, 4)
    threads = [threading.Thread(target=store.write_encoded, args=("N", blob([(2 * i, i + 1, i)]))) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert rows(store.read_simple("N", 0, MAX_WORD, [0, 2, 4, 6])) == [(2 * i, i + 1, i) for i in range(4)]


def test_mutable(store):
    keys = MutableStore(store, "N")
    assert keys.lookup(0) is None and keys.enumerate().count() == 0 and list(keys.chunks()) == []
    keys.insert(0, b"Hi.")
    keys.insert(1, b"I'm a duck")
    assert keys.lookup(0) == keys.lookup(1) == b"I'm a duck"
    assert [tuple(r) for r in keys.enumerate().collect()] == [(1, 1, bytearray(b"I'm a duck"))]
    assert keys.insert_with(lambda new, old: old + new, 0, b"!") == b"I'm a duck!"
    keys.insert(130, b"")
    assert keys.lookup(131) == b""
    assert [parsed(c) for c in keys.chunks()] == [[(1, 2, b"I'm a duck!")], [(131, 0, b"")]]
    keys.insert_many(store.spark.createDataFrame([(0, b"a", 1), (1, b"b", 2), (8, b"c", 1), (None, b"d", 1), (9, None, 2)], "address long, value binary, seq long"))
    assert {r.address: (r.version, bytes(r.value)) for r in keys.enumerate().collect()} == {1: (4, b"b"), 9: (0, b"c"), 131: (0, b"")}


def test_mutable_merges_its_inserts(store, monkeypatch):
    """Many single inserts, rows inserted together and merges give the same as a dict."""
    from tideline.plans import mutable

    monkeypatch.setattr(mutable, "INLINE", 5)
    monkeypatch.setattr(mutable, "TABLES", 2)
    keys, want = MutableStore(store, "N"), {}
    r = random.Random(4)
    for i in range(24):
        k, v = r.choice([0, 1, 4, 130, 2**64 - 2, 77]), bytes([i])
        keys.insert(k, v)
        old = want.get(k | 1, (-1, b""))
        want[k | 1] = (old[0] + 1, v)
        if i % 7 == 6:
            keys.insert_many(store.spark.createDataFrame([(4, b"m", 1), (5, v, 2)], "address long, value binary, seq long"))
            want[5] = (want.get(5, (-1,))[0] + 2, v)
    assert {r.address % 2**64: (r.version, bytes(r.value)) for r in keys.enumerate().collect()} == want
    assert all(keys.lookup(k) == v for k, (_, v) in want.items())
    keys.compact()
    assert len(keys.vacuum(older=-1)) > 1 and len(keys.log.versions()) == 1
    assert {r.address % 2**64: (r.version, bytes(r.value)) for r in keys.enumerate().collect()} == want


def test_locks(spark, tmp_path):
    at = str(tmp_path)
    with exclusive(spark, at, "l"):
        for other in (exclusive, shared):
            with pytest.raises(LockTimeout), other(spark, at, "l", timeout=0.1):
                pass
    with shared(spark, at, "l"), shared(spark, at, "l"):
        with pytest.raises(LockTimeout), exclusive(spark, at, "l", timeout=0.2):
            pass
    with exclusive(spark, at, "l"):
        pass
    # A lock that nobody renews is void; one that is renewed is not.
    (tmp_path / "l").write_text("gone")
    os.utime(tmp_path / "l", (0, 0))
    with exclusive(spark, at, "l", timeout=1):
        pass
    with exclusive(spark, at, "l", expiry=0.4):
        with pytest.raises(LockTimeout), exclusive(spark, at, "l", timeout=1, expiry=0.4):
            pass
    assert not list(tmp_path.iterdir())


def test_counting_under_locks(spark, tmp_path):
    count = tmp_path / "n"
    count.write_text("0")

    def add():
        with exclusive(spark, str(tmp_path), "l"):
            count.write_text(str(int(count.read_text()) + 1))

    threads = [threading.Thread(target=add) for _ in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert count.read_text() == "12"


def test_a_write_that_takes_too_long(spark, store):
    store.register("N", 4, 4)
    quick = PointStore(spark, store.root, write_timeout=0.3)
    slow = spark.range(4, numPartitions=4).selectExpr("2 * id AS address", "id AS time", "id AS payload", "id AS seq").filter("java_method('java.lang.Thread', 'sleep', 3000L) IS NULL OR true")
    with pytest.raises(WriteTimeout):
        quick.write("N", slow)
    assert store.snapshot("N").version == 0
    PointStore(spark, store.root, write_timeout=60).write("N", spark.createDataFrame([(2, 1, 1, 1)], "address long, time long, payload long, seq long"))
    assert store.points("N").count() == 1


def test_a_namespace_has_its_own_threshold(store):
    store.register("own", 4, 4, threshold=10**6)
    store.register("other", 4, 4)
    for ns in ("own", "other"):
        store.write_encoded(ns, blob(SIMPLES))
    assert len(store.index("own").entries) == 1 and len(store.index("other").entries) == 2
    assert PointStore(store.spark, store.root).snapshot("own").threshold == 10**6


def test_another_writer_was_first(spark, store, monkeypatch):
    """The written data takes its place behind; located anew only if an epoch began."""
    store.register("N", 4, 4, threshold=100)
    written = PointStore._written
    tables = []

    def racing(self, ns, now, points):
        tables.append(len(tables))
        if len(tables) == 1:
            store.write_encoded("N", blob([(2, 5, 1), *[(8, t, 0) for t in range(20)]]))
        return written(self, ns, now, points)

    monkeypatch.setattr(PointStore, "_written", racing)
    late = spark.createDataFrame([(2, 5, 2, 0), (2, 30, 3, 1)], "address long, time long, payload long, seq long")
    store.write("N", late)
    assert store.index("N") == Index.of([(0, 4), (19, 4)]) and len(tables) == 3
    assert rows(store.read_simple("N", 0, 99, [2])) == [(2, 5, 1), (2, 30, 3)]
    assert rows(store.read_simple("N", 20, 99, [2])) == [(2, 30, 3)]
    tables.clear()
    extended = spark.createDataFrame([(3, 5, bytearray(b"x"), 0)], "address long, time long, payload binary, seq long")
    monkeypatch.setattr(PointStore, "_after", lambda self, now, batch, own=PointStore._after: own(self, now, batch))
    store.write("N", extended=extended)
    assert rows(store.read_extended("N", 0, 9, [3])) == [(3, 5, b"x")]


def test_parts_of_a_stream_are_written_once(spark, store):
    store.register("N", 4, 4)
    one = spark.createDataFrame([(2, 1, 1, 1)], "address long, time long, payload long, seq long")
    for number in (0, 0, 1, 0):
        store.write("N", one, once=("s", number))
    store.write("N", one, once=("t", 0))
    assert store.points("N").count() == 3 and store.snapshot("N").done == {"s": 1, "t": 0}


def test_many_commits_compaction_and_vacuum(spark, store):
    """States over several whole ones; compaction keeps the order of writes, vacuum what is visible."""
    store.register("N", 2, 2, threshold=200)
    schema = "address long, time long, payload long, seq long, version long"
    for i in range(FULL + 3):
        store.write("N", spark.createDataFrame([(2, 1, i, 5, 99), (4, i, i, 5, 99)], schema))
        if i == 9:
            before = store.compact("N")
            assert len(before.batches) == 1
    now = store.snapshot("N")
    assert now.version == FULL + 4 and len(now.batches) == FULL + 3 - 9 and now.sizes["simple"]
    found = rows(store.read_simple("N", 0, MAX_WORD, [2, 4]))
    assert found == [(2, 1, 0), *[(4, i, i) for i in range(FULL + 3)]]
    sizes = store.describe("N").collect()
    assert sum(r.n for r in sizes) == 2 * (FULL + 3) and store.compact("N").sizes == now.sizes
    assert sorted(map(tuple, store.describe("N").collect())) == sorted(map(tuple, sizes))
    assert store.vacuum("N") == [] and len(store.vacuum("N", older=-1)) == FULL + 3 + 1
    assert rows(store.read_simple("N", 0, MAX_WORD, [2, 4])) == found and store.points("N").select("version").distinct().count() == FULL + 3
    assert store._log("N").versions()[0] == FULL


def test_an_object_that_most_points_belong_to(spark, store):
    """Rebalancing writes it as several files."""
    store.register("N", 4, 4, threshold=1 << 30)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store.write("N", spark.range(60_000).selectExpr("2L AS address", "id * 7919 % 1000003 AS time", "id * 104729 AS payload", "id AS seq"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert store.points("N").select(F.input_file_name()).distinct().count() > 2
    assert store.read_simple("N", 0, MAX_WORD, [2]).count() == 60_000


def test_paths_without_a_scheme_belong_to_the_default_file_system(spark, tmp_path):
    """Data and commits lie in one place; a conflict is told from other failures; drafts are not seen."""
    conf = spark._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.mt.link./data", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://mt/")
    try:
        store = PointStore(spark, "/data/points", threshold=0)
        assert store.register("N", 4, 4) and not store.register("N", 4, 4)
        store.write("N", spark.createDataFrame([(2, 1, 1, 1)], "address long, time long, payload long, seq long"))
        log = store._log("N")
        assert log.folder.scheme == "viewfs" and log.versions() == [0, 1]
        with pytest.raises(CommitConflict):
            log.commit(1, {})
        assert not [n for n in log.folder.names() if n.endswith(".draft")]
        (tmp_path / "points/N/_commits/000000000002.json.half.draft").write_text("{")
        assert log.versions() == [0, 1]
        with exclusive(spark, "/data/points", "l"), pytest.raises(LockTimeout), shared(spark, "/data/points", "l", timeout=0.2):
            pass
        assert rows(store.read_simple("N", 0, 9, [2])) == [(2, 1, 1)]
        assert (tmp_path / "points/N/_commits/000000000001.json").exists() and list((tmp_path / "points/N/simple").iterdir())
    finally:
        conf.set("fs.defaultFS", old or "file:///")
    with pytest.raises(OSError):
        CommitLog(spark, "/proc/nowhere").commit(0, {})


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tideline import session

    def on(master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda *_: None),
            sparkContext=SimpleNamespace(master=master, applicationId="a", getConf=lambda: SimpleNamespace(get=lambda *_: None)),
        )

    for master in ("local", "local[4]", "local[*]"):
        one = on(master)
        assert session.shared_folder(one).startswith("file:///")
        # The same folder, and a new one in it, each time.
        assert session.shared_folder(one).rsplit("/", 1)[0] == session.shared_folder(one).rsplit("/", 1)[0]
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_folder(on(master))


def test_wire(spark, tmp_path):
    points = [*SIMPLES, *EXTENDED, *MORE, (5, 5, b""), *[(2 * k, k, k) for k in range(100)]]
    (tmp_path / "a.wire").write_bytes(blob(points))
    (tmp_path / "b.wire").write_bytes(blob(MORE))
    found = wire.read_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.address, r.time, r.payload if r.data is None else bytes(r.data)) for r in found] == points + MORE
    assert [r.seq for r in found] == [*range(len(points)), *((1 << 32) + k for k in range(len(MORE)))]
    simple = spark.createDataFrame([(2, 1, 7), (4, 0, 8), (None, 1, 1)], "address long, time long, payload long")
    assert b"".join(wire.to_wire(simple)) == blob([(4, 0, 8), (2, 1, 7)])
    with pytest.raises(ValueError):
        wire.build(2, 1, b"x")


def test_streams(spark, store, tmp_path):
    from tideline.operators.changefeed import ChangeTable

    store.register("N", 4, 4)
    spark.createDataFrame([(0, bytearray(blob(SIMPLES + EXTENDED)))], "batch_id long, blob binary").write.parquet(str(tmp_path / "in"))
    blobs = spark.readStream.schema("batch_id long, blob binary").parquet(str(tmp_path / "in"))
    ingest_blobs(blobs, store, "N", str(tmp_path / "c")).awaitTermination()
    assert len(rows(store.read_simple("N", 0, MAX_WORD, [0, 2, 4, 8]))) == 4
    feed = "change_seq long, op string, address long, time long, payload long"
    spark.createDataFrame([(1, "I", 1, 1, 5), (2, "D", 1, 1, None), (3, "I", 2, 1, 6)], feed).write.parquet(str(tmp_path / "f"))
    table = ChangeTable(spark, str(tmp_path / "t"))
    ingest_changes(spark.readStream.schema(feed).parquet(str(tmp_path / "f")), table, str(tmp_path / "c2")).awaitTermination()
    assert [tuple(r) for r in table.rows().collect()] == [(2, 1, 6, 3)]


def test_cli(spark, store, capsys):
    from tideline.cli import main

    args = ["--root", store.root, "--origin", "NS", "register", "--simple-buckets", "3", "--extended-buckets", "4"]
    # The session of the tests is the one that the command gets.
    assert main(args) == 0 and main(args) == 0
    assert capsys.readouterr().out.splitlines() == ["Registered", "Already registered"]
    with pytest.raises(SystemExit):
        main(["--root", store.root, "--origin", "A_B", "register", "--simple-buckets", "3", "--extended-buckets", "4"])


def test_the_first_written_of_a_write_of_several_blobs(spark, store):
    """The order of blobs counts before positions in them, in one write and over several."""
    store.register("N", 4, 4)
    one = blob([(8, 100 + k, k) for k in range(900)] + [(2, 5, 1), (3, 5, b"one")])
    two = blob([(10, 1, 0), (2, 5, 2), (3, 5, b"two"), (4, 6, 3)])
    store.write_blobs("N", spark.createDataFrame([(1, bytearray(two)), (0, bytearray(one))], "batch_id long, blob binary"))
    store.write_blobs("N", spark.createDataFrame([(0, bytearray(blob([(2, 5, 9), (4, 6, 9), (6, 7, 4)])))], "batch_id long, blob binary"))
    assert rows(store.read_simple("N", 0, 20, [2, 4, 6])) == [(2, 5, 1), (4, 6, 3), (6, 7, 4)]
    assert rows(store.read_extended("N", 0, 20, [3])) == [(3, 5, b"one")]
    assert [parsed(c) for c in store.chunks("N", 0, 20, [2])] == [[(2, 5, 1)]]


def test_seq_is_kept_whole(spark, store):
    schema = "address long, time long, payload long, seq long"
    store.register("N", 4, 4)
    store.write("N", spark.createDataFrame([(2, 1, 10, (7 << 32) + 1), (2, 1, 20, (2**31 - 1 << 32) + 0), (4, 1, 30, 5), (4, 1, 40, -5)], schema))
    store.write("N", spark.createDataFrame([(2, 1, 50, -(2**63)), (6, 1, 60, 2**63 - 1)], schema))
    assert rows(store.read_simple("N", 0, 9, [2, 4, 6])) == [(2, 1, 10), (4, 1, 40), (6, 1, 60)]
    found = sorted((r.version, r.seq) for r in store.points("N").collect())
    assert found == [(1, -5), (1, 5), (1, (7 << 32) + 1), (1, 2**31 - 1 << 32), (2, -(2**63)), (2, 2**63 - 1)]
