from __future__ import annotations

import statistics

import numpy as np
import pytest

from tideline.operators import heavykeys as H

POINTS = "address long, time long, payload long, edge boolean, n long"


def brute(rows):
    by = {}
    for a, t, p, *_ in rows:
        if a is not None:
            by.setdefault(a, []).append((t, p))
    out = {}
    for a, v in by.items():
        t = sorted(x % 2**64 for x, _ in v if x is not None)
        p = [y for _, y in v if y is not None]
        signed = lambda w: w - 2**64 if w >= 2**63 else w
        gap = max((y - x for x, y in zip(t, t[1:])), default=None)
        out[a] = (
            len(v), signed(t[0]) if t else None, signed(t[-1]) if t else None, None if gap is None else min(gap, 2**63 - 1),
            len(p), sum(p) if p else None, min(p, default=None), max(p, default=None), statistics.pstdev(p) if p else None,
        )
    return out


def check(spark, rows):
    found = H.key_statistics(spark.createDataFrame(rows, POINTS).repartition(3)).collect()
    want = brute(rows)
    assert len(found) == len(want)
    for r in found:
        n, first, last, gap, k, total, low, high, dev = want[r.address]
        assert (r.points, r.first_time, r.last_time, r.widest_gap, r.payloads, r.lowest, r.highest) == (n, first, last, gap, k, low, high)
        assert (None if r.payload_sum is None else int(r.payload_sum)) == total
        if dev is not None:
            assert r.payload_mean == pytest.approx(total / k) and r.payload_deviation == pytest.approx(dev, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_against_brute_force(spark, monkeypatch, block):
    # The functions run in workers, which import the module: the block is changed by wrapping it.
    real = H._reduce
    monkeypatch.setattr(H, "_partials", _small(real, block))
    rng = np.random.default_rng(2)
    rows = [(int(a), int(t), int(p), None, 1) for a, t, p in zip(rng.choice([1, 2, 3, 4], 800, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 10**6, 800), rng.integers(-100, 10**6, 800))]
    rows += [(5, None, 7, None, 1), (5, None, None, None, 1), (6, 3, None, None, 1), (6, None, 4, None, 1), (None, 1, 1, None, 1), (7, 0, 2**63 - 1, None, 1), (7, -1, 2**63 - 1, None, 1), (7, 5, -(2**63), None, 1)]
    rows += [(8, 4, 4, None, 1)] * 300
    check(spark, rows)


def _small(reduce, block):
    from tideline.operators.arrow_blocks import emit

    def partials(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, block):
                yield from emit(reduce(pa.Table.from_batches([b.slice(at, block)])))

    return partials


def test_heavy(spark):
    rows = [(1, i, 1, None, 1) for i in range(97)] + [(2, 1, 1, None, 1)] * 3 + [(None, 1, 1, None, 1)] * 50
    df = spark.createDataFrame(rows, POINTS)
    assert {r.address for r in H.heavy_keys(df, 0.03).collect()} == {1, 2}
    assert {r.address for r in H.heavy_keys(df, 0.0301).collect()} == {1}
    empty = spark.createDataFrame([], POINTS)
    assert H.key_statistics(empty).count() == 0 and H.heavy_keys(empty, 0.03).count() == 0


def test_no_partition_holds_the_heavy_key(spark):
    df = spark.range(40_000).selectExpr("if(id % 3 > 0, 2L, id * 2) AS address", "id AS time", "id AS payload")
    plan = H.key_statistics(df)._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan


def test_runs_through_many_blocks(monkeypatch):
    """A partition gives two edges, whatever its blocks, and the same states."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    address = np.sort(rng.choice([1, 5, 5, 5, 5, 9], 3000))
    rows = pa.table({
        "address": address, "timed": rng.random(3000) < 0.8, "at": rng.integers(-(2**63), 2**63 - 1, 3000),
        "payload": pa.array(rng.integers(-(2**62), 2**62, 3000), mask=rng.random(3000) < 0.3),
    }).sort_by([("address", "ascending"), ("timed", "ascending"), ("at", "ascending")])

    def states(n, size):
        monkeypatch.setattr(H, "BLOCK_ROWS", n)
        return [r for b in H._partials(iter(rows.to_batches(max_chunksize=size))) for r in b.to_pylist()]

    whole = states(10**6, 10**6)
    for n, size in ((1, 1), (7, 3), (500, 100)):
        cut = states(n, size)
        assert [r["edge"] for r in cut] == [r["edge"] for r in whole] == [True, False, True]
        for a, b in zip(whole, cut):
            assert {k: v for k, v in a.items() if k not in ("mean", "spread")} == {k: v for k, v in b.items() if k not in ("mean", "spread")}
            assert np.allclose([a["mean"], a["spread"]], [b["mean"], b["spread"]])
    assert not list(H._partials(iter([])))
