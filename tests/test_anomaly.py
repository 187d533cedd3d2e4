from __future__ import annotations

import numpy as np
import pytest

from tideline.operators import anomaly as A
from tideline.operators import forest

POINTS = "address long, time long, payload long, seq long, block int, own string"
WINDOWS = "window_id long, address long, unit string, start_time long, step_ns long, n_slots long, solo int"
UNITS = "unit string, decimals int, lowest long, highest long"
BASE, STEP = 1_741_000_000_000_000_000, 60_000_000_000


def wave(n, seed, scatter=20, base=5000):
    rng = np.random.default_rng(seed)
    return (base + 300 * np.sin(np.arange(n) / 1440 * 2 * np.pi) + rng.normal(0, scatter, n)).astype(int)


def run(spark, series, units=(("u", 0, 0, 10_000),), extra=(), only_found=False):
    rows, windows = list(extra), []
    for i, (address, values) in enumerate(series.items()):
        windows.append((i, address, "u", BASE, STEP, len(values), 1))
        rows += [(address, BASE + k * STEP + 7, int(v) if v is not None else None, (address << 20) + k, 1, "x") for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    out = A.implausible(df, spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(list(units), UNITS), only_found)
    return {(r.address, (r.time - BASE) // STEP): r for r in out.collect()}


def test_finds_what_was_planted(spark):
    series, planted = {}, {}
    for s in range(12):
        v = wave(300, s)
        v[200:] += 900  # a lasting change of level
        if s % 3 == 0:
            v[40], planted[2 * s, 40] = v[40] + 700, "spike"
            v[90:92] -= 800
            planted[2 * s, 90] = planted[2 * s, 91] = "spike"
        if s % 3 == 1:
            v[120:150] = v[120]
            planted |= {(2 * s, k): "stuck" for k in range(120, 150)}
        if s % 4 == 0:
            v[10], planted[2 * s, 10] = 20_000, "limit"
            v[11], planted[2 * s, 11] = -1, "limit"
            v[12] = 10_000 if s else v[12]  # allowed, but far off
            if s:
                planted[2 * s, 12] = "spike"
        series[2 * s] = v
    rng = np.random.default_rng(9)
    series[100] = np.where(rng.random(600) < 0.85, 730, 731)  # repeats by nature
    found = run(spark, series)
    assert len(found) == sum(map(len, series.values()))
    assert {k: r.reason for k, r in found.items() if r.reason} == planted
    assert all(0 < r.score <= 1 and (not r.reason or r.score >= A.CUT) for r in found.values())


def test_sources_over_many_units(spark):
    """A source of several units gives its spikes and runs, also at their borders, once each."""
    v = wave(3 * A.BLOCK + 500, 3)
    planted = {}
    for k in (5, A.BLOCK - 1, A.BLOCK, 2 * A.BLOCK + 3):
        v[k] += 900
        planted[6, k] = "spike"
    v[2 * A.BLOCK - 20 : 2 * A.BLOCK + 15] = 5100
    planted |= {(6, k): "stuck" for k in range(2 * A.BLOCK - 20, 2 * A.BLOCK + 15)}
    found = run(spark, {6: v})
    assert len(found) == len(v)
    assert {k: r.reason for k, r in found.items() if r.reason} == planted
    only = run(spark, {6: v}, only_found=True)
    assert set(only) == set(planted)


def test_nulls_repeats_and_empty(spark):
    v = list(wave(50, 1))
    v[7] = None
    later = (4, BASE + 3 * STEP + 7, 9999, 1 << 40, 1, "later")  # a repeat, however odd, is no reading
    odd = [(None, BASE, 1, 1, 1, ""), (4, None, 1, 2, 1, ""), (4, BASE - 1, 1, 3, 1, ""), (4, -1, 1, 4, 1, ""), (8, BASE, 1, 5, 1, ""), later, later]
    found = run(spark, {4: v, 6: [3]}, extra=odd)
    assert set(found) == {(4, k) for k in range(50) if k != 7} | {(6, 0)}
    assert not any(r.reason for r in found.values())
    unbounded = run(spark, {4: [5, 6, 10**15, 5]}, units=[("other", 0, 0, 1), (None, 0, 0, 1)])
    assert len(unbounded) == 4 and not any(r.reason == "limit" for r in unbounded.values())
    none = A.implausible(spark.createDataFrame([], POINTS), spark.createDataFrame([], WINDOWS), spark.createDataFrame([], UNITS))
    assert none.count() == 0


def test_pieces_of_groups():
    """Groups of any size, in blocks of any size: nothing lost, pieces numbered, no group above the bound held."""
    import pyarrow as pa

    from tideline.operators import arrow_blocks

    rng = np.random.default_rng(4)
    key = np.repeat(np.arange(40), rng.integers(1, 60, 40))
    rows = pa.table({"k": key, "v": np.arange(len(key))})
    for size, least, most in ((1, 1, 1), (7, 3, 20), (5, 9, 25), (1000, 10, 30), (3, 2, 10**6)):
        found, at, last = [], 0, {}
        for table, number in arrow_blocks.pieces(iter(rows.to_batches(max_chunksize=size)), "k", least, most):
            k = table.column("k").to_pylist()
            assert table.column("v").to_pylist() == list(range(at, at + len(k)))
            at += len(k)
            for i, g in enumerate(dict.fromkeys(k)):
                n = number if i == 0 else None
                assert (n is None and g not in last) or n == last.get(g, -1) + 1
                last[g] = n if n is not None else 10**9
                if n is None:
                    assert k.count(g) == (key == g).sum()
            found += k
        assert at == len(key)
    assert not list(arrow_blocks.pieces(iter([]), "k", 1, 1))


def test_readings_that_crowd_into_a_slot(spark):
    """One unit with most readings of a window of one unit is cut and gives what it gives whole."""
    v = wave(30_000, 6)
    v[12_000:12_020] = v[12_000]
    v[20_000] += 900
    rows = [(2, BASE + k, int(x), k, 1, "") for k, x in enumerate(v)] + [(2, BASE + 10**12 + k, int(x), 10**6 + k, 1, "") for k, x in enumerate(v[:5])]
    points = spark.createDataFrame(rows, POINTS)
    windows = spark.createDataFrame([(0, 2, "u", BASE, 10**9, 3000, 1)], WINDOWS)
    out = A.implausible(points, windows, spark.createDataFrame([("u", 0, 0, 10_000)], UNITS), True)
    want = {r.seq: (r.reason, r.run) for r in out.collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(A, "PIECE", 500)
        assert {r.seq: (r.reason, r.run) for r in A.implausible(points, windows, spark.createDataFrame([("u", 0, 0, 10_000)], UNITS), True).collect()} == want
    assert {k for k, (r, _) in want.items() if r == "stuck"} >= set(range(12_000, 12_020)) and want[20_000][0] == "spike"


def test_packing():
    v = np.array([2**63 - 1, -(2**63), 0, 5, -7], np.int64)
    assert (A._unpacked(A._packed(v)) == v).all()


@pytest.mark.parametrize("together", [1, 5])
def test_forest_isolates_the_odd_row(together):
    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 4, (200, 4)), axis=0, return_counts=True) for _ in range(together)]
    cells = [np.concatenate([c, [[15, 15, 2, 0], [9, 2, 2, 2]]]) for c, _ in x]
    weight = [np.r_[n, 1, 0] for _, n in x]  # the last one is only asked about
    source = np.repeat(np.arange(together), [len(c) for c in cells])
    score = forest.scores(source, np.concatenate(cells), np.concatenate(weight))
    for i in range(together):
        own = score[source == i]
        assert own.argmax() == len(own) - 2 and own[-1] > own[:-2].max() and np.median(own) < 0.45
        # A source's forest does not depend on its company.
        assert np.allclose(own, forest.scores(np.zeros(len(own), int), cells[i], weight[i]))
    assert not forest.scores(np.zeros(3, int), np.arange(12).reshape(3, 4), np.array([1, 1, forest.LEAST - 3])).any()
    assert not len(forest.scores(np.zeros(0, int), np.zeros((0, 4), int), np.zeros(0)))


def test_the_forest_decides(spark):
    """Without its cut ordinary readings are found, above it none; moderate distances are found where they are rare."""
    v = wave(400, 3)
    v[50] += 900
    points = spark.createDataFrame([(2, BASE + k * STEP, int(x), k, 1, "") for k, x in enumerate(v)], POINTS)
    windows = spark.createDataFrame([(0, 2, "u", BASE, STEP, 400, 1)], WINDOWS)
    limits = spark.createDataFrame([("u", 0, 0, 10_000)], UNITS)
    found = {c: {r.seq for r in A.implausible(points, windows, limits, True, c).collect()} for c in (0.0, 0.4, A.CUT, 1.0)}
    assert found[A.CUT] == {50} and found[1.0] == set() and len(found[0.0]) == 400 and {50} < found[0.4]
    # As many spikes as a tenth of the readings are usual in their source.
    v[::10] += 900
    often = spark.createDataFrame([(2, BASE + k * STEP, int(x), k, 1, "") for k, x in enumerate(v)], POINTS)
    assert A.implausible(often, windows, limits, True).count() < 10


@pytest.mark.parametrize("natural", [1, 10])
def test_a_run_longer_than_a_unit(spark, natural):
    """In a noisy source, and in one that repeats by tens; the run is over two and more units."""
    v = np.repeat(wave(20_000 // natural, 2), natural)
    v[5000:14_000] = v[5000]
    found = run(spark, {2: v})
    stuck = {k for (_, k), r in found.items() if r.reason == "stuck"}
    assert set(range(5000, 14_000)) <= stuck and len(stuck) < 9000 + natural
    assert {found[2, k].run for k in range(5001, 13_999)} <= {found[2, 9000].run} and 9000 <= found[2, 9000].run < 9000 + natural + 1
    assert not [k for (_, k), r in found.items() if r.reason and k not in stuck]


def test_dense_sources_and_long_steps(spark):
    """Far more readings than slots are cut into units all the same; steps may be as long as they like."""
    v = wave(3 * A.BLOCK, 5)
    v[[100, A.BLOCK, 2 * A.BLOCK - 1]] += 900
    rows = [(2, BASE + k * 1_000_000, int(x), k, 1, "x") for k, x in enumerate(v)]
    windows = [(0, 2, "u", BASE, 10**9 * len(v) // 1000 // 2, 2, 1), (1, 4, "u", BASE, 2**62, 1, 1)]
    df = spark.createDataFrame([*rows, (4, BASE + 5, 1, -1, 1, "x")], POINTS)
    out = A.implausible(df, spark.createDataFrame(windows, WINDOWS), spark.createDataFrame([("u", 0, 0, 10_000)], UNITS)).collect()
    assert len(out) == len(rows) + 1
    assert {r.seq: r.reason for r in out if r.reason} == {100: "spike", A.BLOCK: "spike", 2 * A.BLOCK - 1: "spike"}


def test_rows_that_are_no_readings_cut_nothing(spark):
    """Rows outside the windows, repeats and nulls do not take a reading's neighbours or the ends of a run away."""
    v = wave(60, 4)
    v[23:37] = v[23]
    extra = [(2, BASE - 10**12 - k, 1, -k - 1, 1, "") for k in range(60 * 400)]
    extra += [(2, BASE + 5 * STEP + 7, 9, (1 << 40) + k, 1, "") for k in range(6000)] + [(2, BASE + k, None, (1 << 41) + k, 1, "") for k in range(10, 6000)]
    found, alone = run(spark, {2: v}, extra=extra), run(spark, {2: v})
    assert {k: r.reason for k, r in found.items() if r.reason} == {(2, k): "stuck" for k in range(23, 37)}
    assert {k: (r.run, r.deviation, r.reason) for k, r in found.items()} == {k: (r.run, r.deviation, r.reason) for k, r in alone.items()}


@pytest.mark.parametrize("steps, part, piece", [(1, 4096, 9), (3, 4096, 1 << 16), (16, 4096, 1 << 16), (1, 7, 1 << 16), (3, 2, 2), (16, 1, 1), (4096, 4096, 1)])
def test_units_of_any_length_give_the_same(spark, monkeypatch, steps, part, piece):
    """Runs over many units and parts of windows, units in pieces, empty units and readings with no neighbour in their unit."""
    monkeypatch.setattr(A, "PART_UNITS", part)
    series = {2: list(wave(400, 7)), 4: list(wave(400, 8))}
    for v in series.values():
        v[100:160] = [v[100]] * 60
        v[200:240] = [None] * 40
        v[300] += 900
        v[301], v[310] = -5, 20_000
    whole = run(spark, series)
    monkeypatch.setattr(A, "BLOCK", steps)
    monkeypatch.setattr(A, "PIECE", piece)
    cut = run(spark, series)
    assert whole.keys() == cut.keys()
    for k, r in whole.items():
        assert (r.reason, r.run, r.seq) == (cut[k].reason, cut[k].run, cut[k].seq), k
        assert np.allclose([r.deviation, r.score], [cut[k].deviation, cut[k].score], rtol=1e-4, equal_nan=True), k
    assert {k for (a, k), r in cut.items() if a == 2 and r.reason == "stuck"} == set(range(100, 160))
