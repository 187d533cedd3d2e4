from __future__ import annotations

import random

import pytest

from tideline.operators import changefeed as C
from tideline.plans.commits import CommitConflict, CommitLog
from tideline.session import shared_folder

FEED = "change_seq long, op string, address long, time long, payload long, deleted string, bucket int"


def brute(rows):
    state = {}
    for seq, op, a, t, p, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        kind = (op or "").strip().lower()
        if a is None or t is None:
            continue
        if kind in C.DELETES:
            state.pop((a, t), None)
        elif kind in C.SETS:
            state[a, t] = (p, seq)
    return sorted((a, t, p, s) for (a, t), (p, s) in state.items())


def random_feed(n, keys, seed):
    r = random.Random(seed)
    ops = ["I", "insert", " Ins ", "U", "UPDATE", "upd", "D", "delete", "del", "H", "heartbeat", None, "?"]
    rows = [(i, r.choice(ops), r.choice([None, *range(keys)]), r.choice([None, 1, -1]), r.choice([None, 5, -(2**63)]), "x", 1) for i in range(n)]
    rows += r.choices(rows, k=n // 2)
    r.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("keys", [1, 5, 200])
def test_rebuild(spark, keys):
    rows = random_feed(600, keys, keys)
    want = sorted(brute(rows), key=lambda r: (r[0], r[1]))
    assert got(C.current_rows(spark.createDataFrame(rows, FEED).repartition(3))) == want


def test_versions_and_late_changes(spark):
    rows = random_feed(400, 20, 3)
    table = C.ChangeTable(spark, f"{shared_folder(spark)}/t")
    assert table.rows().count() == 0
    for k in (2, 0, 1, 0):  # out of order, one part again
        table.apply(spark.createDataFrame(rows[k::3], FEED))
    assert got(table.rows()) == sorted(brute(rows), key=lambda r: (r[0], r[1]))
    assert table.state().filter("deleted").count() > 0
    assert table.log.versions() == [0, 1, 2, 3]


def test_tombstone_outlives_late_insert(spark):
    table = C.ChangeTable(spark, f"{shared_folder(spark)}/t")
    table.apply(spark.createDataFrame([(5, "D", 1, 1, None, "", 0)], FEED))
    table.apply(spark.createDataFrame([(4, "I", 1, 1, 7, "", 0)], FEED))
    assert table.rows().count() == 0
    table.apply(spark.createDataFrame([(6, "U", 1, 1, None, "", 0)], FEED))
    assert got(table.rows()) == [(1, 1, None, 6)]


def test_same_sequence_differs(spark):
    rows = [(1, "I", 1, 1, 5, "", 0), (1, "I", 1, 1, 9, "", 0), (1, "U", 1, 1, None, "", 0), (2, "I", 3, 1, 1, "", 0), (2, "D", 3, 1, 1, "", 0)]
    for order in (rows, rows[::-1]):
        assert got(C.current_rows(spark.createDataFrame(order, FEED).coalesce(1))) == [(1, 1, 9, 1)]


def test_empty(spark):
    assert C.current_rows(spark.createDataFrame([], FEED)).count() == 0


def test_unpublished_data_is_invisible(spark):
    table = C.ChangeTable(spark, f"{shared_folder(spark)}/t")
    table.apply(spark.createDataFrame([(1, "I", 1, 1, 5, "", 0)], FEED))
    C.upsert(C.changes_of(spark.createDataFrame([(2, "I", 2, 2, 6, "", 0)], FEED))).write.parquet(f"{table.path}/data-lost")
    assert got(table.rows()) == [(1, 1, 5, 1)]


def test_commits_are_exclusive(spark):
    log = CommitLog(spark, f"{shared_folder(spark)}/log")
    log.commit(0, {"a": 1})
    with pytest.raises(CommitConflict):
        log.commit(0, {"a": 2})
    assert log.latest() == (0, {"a": 1})


def test_only_touched_parts_are_rewritten(spark):
    table = C.ChangeTable(spark, f"{shared_folder(spark)}/t", parts=5)
    table.apply(spark.createDataFrame([(i, "I", i, 1, i, "", 0) for i in range(1, 40)], FEED))
    before = table.log.latest()[1]
    table.apply(spark.createDataFrame([(100, "D", 3, 1, None, "", 0)], FEED))
    after = table.log.latest()[1]
    assert before["parts"] == after["parts"] == 5 and len(before["held"]) == 5
    assert sum(before["held"][p] != after["held"][p] for p in after["held"]) == 1
    assert {r.address for r in table.rows().collect()} == set(range(1, 40)) - {3}
    table.apply(spark.createDataFrame([(7, "H", 3, 1, None, "", 0)], FEED))  # nothing to apply is a version, too
    assert table.log.versions() == [0, 1, 2] and table.log.latest()[1]["held"] == after["held"]


def test_a_table_that_grows_gets_more_parts(spark, monkeypatch):
    """Written anew in twice as many parts when it has outgrown them; what is no longer held can be deleted."""
    monkeypatch.setattr(C, "PART_ROWS", 40)
    table = C.ChangeTable(spark, f"{shared_folder(spark)}/t", parts=1)
    rows, parts = random_feed(900, 150, 8), []
    for k in range(6):
        table.apply(spark.createDataFrame(rows[k::6], FEED))
        parts.append(table.log.latest()[1]["parts"])
    assert parts == sorted(parts) and parts[0] == 1 and parts[-1] >= 4
    want = sorted(brute(rows), key=lambda r: (r[0], r[1]))
    assert got(table.rows()) == want
    assert sum(n for _, n in table.log.latest()[1]["held"].values()) == table.state().count()
    assert table.vacuum() == [] and table.vacuum(older=-1)
    assert got(table.rows()) == want and table.log.versions() == [5]
    first = C.ChangeTable(spark, f"{shared_folder(spark)}/t")
    first.apply(spark.createDataFrame(rows, FEED))
    assert first.log.latest()[1]["parts"] == -(-len(rows) // 40)


def test_a_feed_that_changes_nothing(spark):
    table = C.ChangeTable(spark, f"{shared_folder(spark)}/t")
    empty = spark.createDataFrame([(1, "heartbeat", 1, 1, 1, "", 0)], FEED)
    assert table.apply(empty) == 0 and table.apply(empty) == 1 and table.rows().count() == 0
    table.apply(spark.createDataFrame([(1, "I", 1, 1, 5, "", 0)], FEED))
    assert table.apply(empty) == 3 and got(table.rows()) == [(1, 1, 5, 1)]


@pytest.mark.parametrize("first", [True, False])
def test_another_writer_is_first(spark, monkeypatch, first):
    table = C.ChangeTable(spark, f"{shared_folder(spark)}/t")
    rows = random_feed(90, 12, 2)
    if not first:
        table.apply(spark.createDataFrame(rows[::3], FEED))
    commit, raced = CommitLog.commit, []

    def racing(self, version, content):
        if not raced:
            raced.append(1)
            C.ChangeTable(spark, table.path).apply(spark.createDataFrame(rows[1::3], FEED))
        return commit(self, version, content)

    monkeypatch.setattr(CommitLog, "commit", racing)
    table.apply(spark.createDataFrame(rows[2::3], FEED))
    want = brute(rows[2::3] + rows[1::3] + ([] if first else rows[::3]))
    assert got(table.rows()) == sorted(want, key=lambda r: (r[0], r[1]))
