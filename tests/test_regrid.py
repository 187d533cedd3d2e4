from __future__ import annotations

import numpy as np
import pytest

from tideline.operators import regrid as R

POINTS = "address long, time long, payload long, seq long, slot long, cell long"
WINDOWS = "window_id long, address long, unit string, start_time long, step_ns long, n_slots long"


def brute(points, windows, bandwidth=R.BANDWIDTH):
    out = {}
    for wid, a, _, start, step, n in {w for w in windows if None not in (w[1], w[3], w[4], w[5]) and w[4] > 0}:
        own = [((t - start) / step, p) for x, t, p in points if x == a and t is not None and p is not None and start <= t < start + step * n]
        for k in range(n):
            d = np.array([x - k - 0.5 for x, _ in own])
            y = np.array([p for _, p in own], float)
            w = np.maximum(0, 1 - (d / bandwidth) ** 2) if len(d) else np.zeros(0)
            inside = sum(1 for x, _ in own if int(x // 1) == k)
            value = support = 0.0
            if w.sum() > 0:
                support = w.sum() ** 2 / (w**2).sum()
                if np.ptp(d[w > 0]) < 1e-9:
                    value = (w * y).sum() / w.sum()
                else:
                    m = np.stack([np.ones_like(d), d], 1)
                    value = np.linalg.solve(m.T @ (m * w[:, None]), m.T @ (w * y))[0]
            out[wid, a, k] = (start + k * step, inside, support, value if support >= R.MIN_SUPPORT else None)
    return out


@pytest.mark.parametrize("broadcast, bandwidth, chunk, many", [(True, 1.5, 4096, 8), (False, 1.5, 4, 2), (True, 2.5, 5, 8), (True, 0.5, 1, 1), (True, 2.5, 3, 1)])
def test_against_brute_force(spark, monkeypatch, broadcast, bandwidth, chunk, many):
    """Joined either way, chunks shorter than the kernel included, readings added up before the shuffle or not."""
    if not broadcast:
        monkeypatch.setattr(R, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(R, "SLOT_CHUNK", chunk)
    monkeypatch.setattr(R, "MANY", many)
    rng = np.random.default_rng(5)
    base = 1_700_000_000_000_000_000
    windows = [(1, 2, "u", base, 1000, 40), (2, 2, "u", base + 40_000, 3000, 17), (3, 4, None, base + 7, 10**15, 6), (4, 4, "u", base - 5 * 10**14, 10**9, 9), (1, 2, "u", base, 1000, 40)]
    windows += [(5, None, "u", base, 1, 1), (6, 8, "u", None, 1, 1), (7, 8, "u", base, 0, 5), (8, 8, "u", base, 5, 0), (None, 10, "u", base, 10, 3)]
    points = [(2, base + int(x), int(p)) for x, p in zip(rng.integers(-3000, 100_000, 150), rng.integers(-1000, 1000, 150))]
    points += [(4, base + int(x), 7) for x in rng.integers(0, 6 * 10**15, 20)] + [(4, base + 3 * 10**15, 1)] * 3 + [(10, base + 5, 3)]
    points += [(None, base, 1), (2, None, 1), (2, base + 500, None), (2, -5, 1), (2, 2**63 - 1, 1), (6, base, 1)]
    df = spark.createDataFrame([(*p, i, 1, 1) for i, p in enumerate(points)], POINTS).repartition(3)
    rows = R.regular_grid(df, spark.createDataFrame(windows, WINDOWS), bandwidth).collect()
    want = brute(points, windows, bandwidth)
    assert len(rows) == len(want)
    for r in rows:
        start, n, support, value = want[r.window_id, r.address, r.slot]
        assert (r.slot_time, r.readings, r.missing) == (start, n, value is None)
        assert r.support == pytest.approx(support, rel=1e-6, abs=1e-9)
        assert (r.value is None) == (value is None)
        if value is not None:
            assert r.value == pytest.approx(value, rel=1e-6, abs=1e-6)


def test_missing_where_support_is_insufficient(spark):
    points = spark.createDataFrame([(2, t, 10 * t, t, 1, 1) for t in (5, 15, 35, 45, 85)], POINTS)
    windows = spark.createDataFrame([(1, 2, "u", 0, 10, 9)], WINDOWS)
    rows = {r.slot: r for r in R.regular_grid(points, windows).collect()}
    assert rows[2].readings == 0 and not rows[2].missing and rows[2].value == pytest.approx(250)
    assert rows[6].missing and rows[6].value is None and rows[6].support == 0
    # A lone reading is not enough for a regression, unless that is asked for.
    assert rows[8].readings == 1 and rows[8].missing
    assert {r.slot: r for r in R.regular_grid(points, windows, min_support=1.0).collect()}[8].value == 850
    with pytest.raises(ValueError, match="half"):
        R.regular_grid(points, windows, 2.0)


def test_a_slot_with_most_readings(spark):
    """Its readings are added up before the shuffle: few rows travel."""
    rows = spark.range(40_000).selectExpr("2L AS address", "id % 1000 AS time", "5L AS payload", "id AS seq", "1L AS slot", "1L AS cell").unionAll(spark.range(50).selectExpr("2L", "1000 * id", "5L", "id", "1L", "1L"))
    windows = spark.createDataFrame([(1, 2, "u", 0, 1000, 50)], WINDOWS)
    found = {r.slot: (r.readings, r.value) for r in R.regular_grid(rows.coalesce(2), windows, min_support=1.0).collect()}
    assert found == {k: (40_001 if k == 0 else 1, pytest.approx(5)) for k in range(50)}


def test_extremes_and_empty(spark):
    windows = spark.createDataFrame([(1, 2, "u", -50, 20, 10), (2, 4, "u", 2**63 - 30, 20, 4)], WINDOWS)  # the last words; across 2**63
    points = spark.createDataFrame([(2, -1, 3, 1, 1, 1), (4, -(2**63), 4, 1, 1, 1)], POINTS)
    rows = {(r.window_id, r.slot): r for r in R.regular_grid(points, windows).collect()}
    assert [rows[1, k].readings for k in (0, 1, 2)] == [0, 0, 1]
    assert [rows[2, k].readings for k in range(4)] == [0, 1, 0, 0]
    none = spark.createDataFrame([], POINTS)
    assert R.regular_grid(none, windows).filter("missing").count() == len(rows)
    assert R.regular_grid(points, spark.createDataFrame([], WINDOWS)).count() == 0
    longest = spark.createDataFrame([(1, 2, "u", 0, 2**62, 7)], WINDOWS)  # ends with 2**63 - 1 ns
    assert [r.slot for r in R.regular_grid(points, longest).collect()] == [0, 1]


def test_the_method_gives_the_found_rows(spark):
    """p3_found are the rows of the regression's grid without a reading of their own."""
    import __spark_entry__ as entry

    queries = entry.queries()
    assert [n for n in queries if n.startswith("p3_")] == ["p3_method", "p3_found"]
    rows = queries["p3_method"](spark, "/root/testdata/sf0.001").collect()
    slots = spark.read.parquet("/root/testdata/sf0.001/reading_windows.parquet").distinct().agg({"n_slots": "sum"}).first()[0]
    assert len(rows) == slots and all((r.value is None) == r.missing for r in rows)
    found = queries["p3_found"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.address, r.slot_time) for r in rows if r.readings == 0} == {tuple(r) for r in found}
