"""Implausible readings of sources: an isolation forest per source, and rules.

A source is an address; its readings are taken within its windows. The work is
cut into units of BLOCK steps of a window (shorter ones where a window has more
readings than slots), so a source of any length is spread over many tasks. From
the edges of all units of a window each unit learns the readings beside it and
how far runs go on beyond it, so results do not depend on the cuts.
Every reading gets four features: level (distance from the readings around it),
difference (to the nearer of the two readings beside it), season (distance from
the source's usual level at that hour of the day) and run length (of equal
consecutive readings), in units of what is usual in its source: scatter, hourly
levels and run lengths are statistics over all readings of the source. The
forest of the source, on a bounded sample of its readings, scores every one.

A reading is implausible if the forest isolates it easily, and still does so
with the season left aside (daily waves and lasting changes of level are no
faults): as a spike by level and difference, as stuck by the length of its run.
Only the physical limits of units are rules.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.u64 import order_key
from tideline.operators.arrow_blocks import blocks, pieces, whole_groups
from tideline.operators.forest import LEVELS, SAMPLE, scores
from tideline.operators.quotient import first_deliveries
from tideline.operators.regrid import in_windows, proper_windows
from tideline.session import bounded_join, materialise, shuffle_partitions

#: Steps of a window in a unit of work.
BLOCK = 4096
#: Readings on each side that a reading is compared with.
SIDE = 5
#: Score from which on a reading is easy to isolate.
CUT = 0.585
#: The longest runs of a source that do not count among the usual ones, if there are more: a run is compared with what the source shows otherwise.
APART = 1
#: Features are linear up to FAR usual units, with so many cells to the doubling beyond.
FAR, PER_DOUBLING = 8.0, 4.0
#: A run of so many times the usual length (of 2 at least) is FAR.
FAR_RUN = 5.0
#: Units of a window whose edges are gone through together; the number that stands for what lies beside them.
PART_UNITS, BESIDE = 4096, -1
#: Readings from which on a unit is cut into pieces, whatever its length; pieces of a unit at most.
PIECE, PIECES = 1 << 16, 1 << 16
#: Rows that a task takes at a time; sources whose forests are grown together.
ROWS, TOGETHER = 1 << 16, 256
#: Models (2 KB at most) and contexts of units (300 bytes) up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_MODELS, BROADCAST_CONTEXTS = 16_000, 20_000

_HOUR = 3_600_000_000_000
_LONGEST = (1 << 63) - 1
_BINS = 32

RESULT = "seq long, address long, window_id long, time long, payload long, score double, deviation double, run long, reason string"
_UNIT = "address long, window_id long, start long, block long, solo boolean, seq binary, time binary, payload binary, out binary, edge binary"


def _bin(v: np.ndarray) -> np.ndarray:
    """Logarithmic bins, 32 to the doubling."""
    return np.floor(_BINS * np.log2(1 + v)).astype(np.int64)


def _middle(b: np.ndarray) -> np.ndarray:
    return 2 ** ((b + 0.5) / _BINS) - 1


def _quantile(bins: np.ndarray, n: np.ndarray, q: float) -> float:
    order = np.argsort(bins, kind="stable")
    upto = np.cumsum(n[order])
    return float(_middle(bins[order][np.searchsorted(upto, q * upto[-1])]))


def _without_longest(bins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of runs without the APART longest; as they are, if there are no others."""
    if n.sum() <= APART:
        return bins, n
    order = np.argsort(bins, kind="stable")
    upto = np.minimum(np.cumsum(n[order]), n.sum() - APART)
    return bins[order], np.diff(np.r_[0, upto])


def _median_of(columns: np.ndarray) -> np.ndarray:
    """Median of each row, without its NaNs; NaN if there are only those."""
    s = np.sort(columns, axis=1)
    n = np.isfinite(s).sum(axis=1)
    along = np.arange(len(s))
    with np.errstate(invalid="ignore"):
        mid = (s[along, np.maximum((n - 1) // 2, 0)] + s[along, np.minimum(n // 2, s.shape[1] - 1)]) / 2
    return np.where(n > 0, mid, np.nan)


def _shape(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of readings in order, by group: distance from neighbours, distance from the middle, difference, middle."""
    n = len(x)
    around = np.full((n, 2 * SIDE), np.nan)
    for i in range(1, SIDE + 1):
        same = group[i:] == group[:-i]
        around[i:, SIDE - i][same] = x[:-i][same]
        around[:-i, SIDE + i - 1][same] = x[i:][same]
    left, right, both = _median_of(around[:, :SIDE]), _median_of(around[:, SIDE:]), _median_of(around)
    middle = np.where(np.isnan(both), x, both)
    away = np.abs(x - middle)
    distance = np.fmin(np.fmin(np.abs(x - left), np.abs(x - right)), away)
    difference = np.fmin(np.abs(x - around[:, SIDE - 1]), np.abs(x - around[:, SIDE]))
    return distance, away, np.nan_to_num(difference), middle


def _runs(group: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the run of equal readings that each is in; whether it is the first of it."""
    first = np.ones(len(p), bool)
    first[1:] = (group[1:] != group[:-1]) | (p[1:] != p[:-1])
    start = np.flatnonzero(first)
    return np.repeat(np.diff(np.r_[start, len(p)]), np.diff(np.r_[start, len(p)])), first


#: Of each reading, what cannot be had from its time and payload. Runs are within the window.
_SHAPE = np.dtype([("distance", "<f4"), ("difference", "<f4"), ("run", "<u4"), ("first", "?"), ("out", "?")])
#: Of a reading in a source's sample.
_SAMPLE = np.dtype([("distance", "<f4"), ("difference", "<f4"), ("run", "<u4"), ("payload", "<i8"), ("hour", "i1")])


#: Bits of the flags of a row: outside the limits, in the only unit of its source, in the only unit of its window.
_OUT, _SOLO, _ONLY = 1, 2, 4


def _packed(v: np.ndarray) -> bytes:
    """LONGs by their differences, byte after byte: compresses to what changes."""
    d = v.copy()
    d[1:] -= v[:-1]
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(d)


def _hour(at: np.ndarray) -> np.ndarray:
    """Hour of the day (UTC) of order keys of times."""
    return ((at.view(np.uint64) ^ np.uint64(1 << 63)) // np.uint64(_HOUR) % np.uint64(24)).astype(np.int8)


def _units(most: int):
    """Rows of readings, sorted by unit and time, to one row per unit with its edge, if its window has others.

    A unit that has many more readings than it should is cut into units of
    about `most`; its block and the number of the piece make theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in pieces(batches, "unit_key", ROWS, most):
            get = {c: rows.column(c).to_numpy() for c in ("window_id", "start", "block", "at", "seq", "payload", "flags", "address", "unit_key")}
            key = np.stack([get["unit_key"], get["address"], get["block"]])
            group = np.cumsum(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) - 1
            p, flags = get["payload"], get["flags"]
            out = (flags & _OUT) > 0
            run, first = _runs(group, p)
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            found = []
            for a, b in zip(start, np.r_[start[1:], len(group)]):
                s, edge = slice(a, b), None
                cut = number is not None and get["unit_key"][a] == get["unit_key"][0]
                if cut or not flags[a] & _ONLY:
                    inside = p[s][~out[s]]
                    ends = [(int(p[k]), int(run[k])) for k in (a, b - 1)]
                    edge = pickle.dumps(_Edge(int(b - a), int((first[s] & ~out[s]).sum()), bool(not out[a]), inside[:SIDE].tolist(), inside[-SIDE:].tolist(), *ends))
                found.append((
                    *(int(get[c][a]) for c in ("address", "window_id", "start")), int(get["block"][a]) * PIECES + (number if cut else 0), bool(flags[a] & _SOLO) and not cut,
                    _packed(get["seq"][s]), _packed(get["at"][s]), _packed(p[s]), out[s].tobytes(), edge,
                ))
            names = ["address", "window_id", "start", "block", "solo", "seq", "time", "payload", "out", "edge"]
            kinds = [*[pa.int64()] * 4, pa.bool_(), *[pa.binary()] * 5]
            for k in range(0, len(found), 512):
                part = list(zip(*found[k : k + 512]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds)], names)

    return run


class _Edge:
    """What units in order show to those beside them, and what they make together."""

    def __init__(self, n: int, heads: int, inside: bool, first: list[int], last: list[int], head: tuple[int, int], tail: tuple[int, int]):
        #: Readings; first readings of runs within the limits; whether the very first is one, unless its run began before.
        self.n, self.heads, self.inside = n, heads, inside
        #: The SIDE first and last readings within the limits; payload and length of the first and the last run.
        self.first, self.last, self.head, self.tail = first, last, head, tail

    def then(self, other: _Edge) -> _Edge:
        joined = self.tail[0] == other.head[0]
        head = (self.head[0], self.n + other.head[1]) if joined and self.head[1] == self.n else self.head
        tail = (other.tail[0], self.tail[1] + other.n) if joined and other.tail[1] == other.n else other.tail
        heads = self.heads + other.heads - (joined and other.inside)
        return _Edge(self.n + other.n, heads, self.inside, (self.first + other.first)[:SIDE], (self.last + other.last)[-SIDE:], head, tail)

    def mirrored(self) -> _Edge:
        return _Edge(self.n, self.heads, self.inside, self.last[::-1], self.first[::-1], self.tail, self.head)


#: Readings before a unit, and payload and length of the run that ends there.
_Side = tuple[list[int], tuple[int | None, int]]
_NOTHING: _Side = ([], (None, 0))


def _sides(edges: list[_Edge], before: _Side) -> list[_Side]:
    """What lies before each of some edges in order."""
    found, at = [], before
    for e in edges:
        found.append(at)
        left, (payload, length) = at
        whole = e.tail[1] == e.n and payload == e.tail[0]
        at = (left + e.last)[-SIDE:], (e.tail[0], e.n + length) if whole else e.tail
    return found


def _both_sides(edges: list[_Edge], before: _Side, after: _Side) -> list[tuple[_Side, _Side]]:
    """What lies before and after each of some edges in order; readings after are the nearest last."""
    return list(zip(_sides(edges, before), _sides([e.mirrored() for e in edges[::-1]], after)[::-1]))


_KEYS = ["address", "window_id", "start", "part"]
_PART = "address long, window_id long, start long, part long, block long, edge binary, part_key long"


def _part_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges, sorted by part and block, to one edge per part, put together as they stream by."""
    at, held = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in at), pa.array([pickle.dumps(held)], pa.binary())], [*_KEYS, "edge"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in _KEYS))
        for key, edge in zip(keys, batch.column("edge").to_pylist()):
            own = pickle.loads(edge)
            if key != at:
                if held is not None:
                    yield row()
                at, held = key, own
            else:
                held = held.then(own)
    if held is not None:
        yield row()


def _part_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of parts, sorted by window and part, to what lies beside each part and the heads of its window."""
    for rows in whole_groups(batches, "window_key", ROWS):
        keys = [rows.column(c).to_numpy() for c in _KEYS]
        start = np.flatnonzero(np.r_[True, (np.diff(np.stack(keys[:3])) != 0).any(axis=0)])
        edges, out = [pickle.loads(e) for e in rows.column("edge").to_pylist()], []
        for a, b in zip(start, np.r_[start[1:], len(edges)]):
            heads = reduce(_Edge.then, edges[a:b]).heads
            out += [pickle.dumps((heads, *x)) for x in _both_sides(edges[a:b], _NOTHING, _NOTHING)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(out, pa.binary())], [*_KEYS, "edge"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges, sorted by part and block, to what each unit needs of the rest of its window; what lies beside the part, if given, comes first."""
    for rows in whole_groups(batches, "part_key", ROWS):
        keys = [rows.column(c).to_numpy() for c in _KEYS]
        block = rows.column("block").to_numpy()
        start = np.flatnonzero(np.r_[True, (np.diff(np.stack(keys)) != 0).any(axis=0)])
        held, out, units = [pickle.loads(e) for e in rows.column("edge").to_pylist()], [], []
        for a, b in zip(start, np.r_[start[1:], len(held)]):
            if block[a] == BESIDE:
                heads, before, after = held[a]
                a += 1
            else:
                heads, before, after = reduce(_Edge.then, held[a:b]).heads, _NOTHING, _NOTHING
            for e, (left, right) in zip(held[a:b], _both_sides(held[a:b], before, after)):
                # Of the runs beside it, those that go on in the unit.
                runs = [n if payload == mine[0] else 0 for (_, (payload, n)), mine in ((left, e.head), (right, e.tail))]
                out.append(pickle.dumps((heads, (left[0], runs[0]), (right[0][::-1], runs[1]))))
            units += range(a, b)
        columns = [pa.array(k[units]) for k in (*keys[:3], block)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], ["c_address", "c_window_id", "c_start", "c_block", "context"])


def _stitched(units: DataFrame, longest: int, n: int) -> DataFrame:
    """Contexts of the units that have an edge.

    The edges of PART_UNITS units in a row are gone through together. Where a
    window has more, each such part first makes one edge, and those of a window
    tell what lies beside each part, so no task has more than a part of a
    window's units, or its parts.
    """
    part = F.expr(f"block div {PART_UNITS * PIECES}L")
    edges = units.filter(F.col("edge").isNotNull()).select("address", "window_id", "start", part.alias("part"), "block", "edge")
    key = F.xxhash64(*_KEYS).alias("part_key")
    if longest > PART_UNITS:
        sorted_edges = edges.repartition(n, *_KEYS).sortWithinPartitions(*_KEYS, "block")
        parts = sorted_edges.mapInArrow(_part_edges, "address long, window_id long, start long, part long, edge binary")
        parts = parts.withColumn("window_key", F.xxhash64("window_id", "address", "start")).repartition(n, "window_key")
        sides = parts.sortWithinPartitions("window_key", *_KEYS).mapInArrow(_part_sides, "address long, window_id long, start long, part long, edge binary")
        edges = edges.unionByName(sides.withColumn("block", F.lit(BESIDE).cast("long")))
    edges = edges.select("*", key).repartition(n, "part_key").sortWithinPartitions("part_key", *_KEYS, "block")
    return edges.mapInArrow(_contexts, "c_address long, c_window_id long, c_start long, c_block long, context binary")


class _Shaped:
    """Readings of units with their shape in the whole window; unit u has readings bounds[u] to bounds[u+1]."""

    def __init__(self, units: list[dict]):
        self.words = {c: np.concatenate([_unpacked(u[c]) for u in units]) for c in ("seq", "time", "payload")}
        outs = [np.frombuffer(u["out"], bool) for u in units]
        self.bounds = np.cumsum([0, *map(len, outs)])
        self.source = np.repeat(np.arange(len(units)), np.diff(self.bounds))
        self.hour = _hour(self.words["time"])
        p, out = self.words["payload"], np.concatenate(outs)
        self.shape = shape = np.zeros(len(p), _SHAPE)
        shape["out"] = out
        shape["run"], shape["first"] = _runs(self.source, p)
        #: Readings of the windows of the units that a sample may hold, None of a unit that is a window's only one.
        self.heads: list[int | None] = []
        pieces, own = [], []
        for u, a, b in zip(units, self.bounds, self.bounds[1:]):
            heads, (left, before), (right, after) = pickle.loads(u["context"]) if u["context"] is not None else (None, ([], 0), ([], 0))
            self.heads.append(heads)
            inside = p[a:b][~out[a:b]]
            pieces += [np.array(left, np.int64), inside, np.array(right, np.int64)]
            own += [len(left), len(inside), len(right)]
            head, tail = a + shape["run"][a], b - shape["run"][b - 1]
            shape["run"][a:head] += before
            shape["run"][tail:b] += after
            if before:
                shape["first"][a] = False
        mine = np.repeat(np.tile([False, True, False], len(units)), own)
        group = np.repeat(np.repeat(np.arange(len(units)), 3), own)
        distance, away, difference, middle = (v[mine] for v in _shape(group, np.concatenate(pieces).astype(np.float64)))
        shape["distance"][~out], shape["difference"][~out] = distance, difference
        self.away, self.middle = np.zeros(len(p)), np.zeros(len(p))
        self.away[~out], self.middle[~out] = away, middle

    def summary(self, u: int) -> dict:
        """What a unit adds to the statistics of its source."""
        s = slice(self.bounds[u], self.bounds[u + 1])
        shape, p, hour = self.shape[s], self.words["payload"][s], self.hour[s]
        used = np.flatnonzero(~shape["out"])
        # Of a run only the first reading, or stuck ones would pass for a small scatter.
        head = used[shape["first"][used]]
        rank = self.words["seq"][s][head].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rank = (rank ^ (rank >> np.uint64(29))) >> np.uint64(1)
        # Of larger windows two to four times the sample is offered to the merge.
        heads = len(head) if self.heads[u] is None else self.heads[u]
        halved = max(0, int(np.floor(np.log2(max(heads, 1) / (2 * SAMPLE)))))
        few = rank <= np.uint64(_LONGEST >> halved)
        sample = np.zeros(few.sum(), _SAMPLE)
        for c in ("distance", "difference", "run"):
            sample[c] = shape[c][head][few]
        sample["payload"], sample["hour"] = p[head][few], hour[head][few]
        return {
            "away": np.unique(_bin(self.away[s][head]), return_counts=True),
            "runs": np.unique(_bin(shape["run"][head].astype(float)), return_counts=True),
            "hours": (np.bincount(hour[used], self.middle[s][used], minlength=24), np.bincount(hour[used], minlength=24)),
            "sample": (rank[few].astype(np.int64), sample),
        }


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of units, so many together as make up work of bounded size."""
    for table in blocks(batches, TOGETHER):
        units = table.to_pylist()
        for k in range(0, len(units), TOGETHER):
            yield units[k : k + TOGETHER]


def _model(away, runs, hours, sample) -> dict:
    """A source's usual units and the cells of its sample, from summed statistics."""
    scatter = max(_quantile(*away, 0.5) * 1.4826, 0.5) if len(away[0]) else 0.5
    usual = round(_quantile(*_without_longest(*runs), 0.95)) if len(runs[0]) else 1
    total, n = hours
    whole = total.sum() / max(n.sum(), 1)
    level = np.where(n > 0, total / np.maximum(n, 1), whole)
    off = np.abs(sample["payload"] - level[sample["hour"]])
    season = max(float(np.median(off)) * 1.4826, scatter) if len(off) else scatter
    model = {"scatter": scatter, "usual": max(usual, 2), "level": level.astype(np.float32), "season": season}
    cells, n = np.unique(_cells(sample, sample["payload"], sample["hour"], model), return_counts=True)
    model["sample"] = cells.astype(np.int32), n.astype(np.int16)
    return model


def _far(v: np.ndarray) -> np.ndarray:
    return np.where(v <= FAR, v, FAR + PER_DOUBLING * np.log2(np.maximum(v, FAR) / FAR))


def _number(level: np.ndarray | int, difference: np.ndarray | int, season: np.ndarray | int, run: np.ndarray | int) -> np.ndarray:
    return ((level * LEVELS + difference) * LEVELS + season) * LEVELS + run


def _features(cell: np.ndarray) -> np.ndarray:
    return np.stack([cell // LEVELS**3, cell // LEVELS**2 % LEVELS, cell // LEVELS % LEVELS, cell % LEVELS], axis=1)


def _cells(shape: np.ndarray, payload: np.ndarray, hour: np.ndarray, model: dict) -> np.ndarray:
    """Cell of each reading: level, difference, season (the usual in the middle, two units a cell) and run, in usual units."""
    run = FAR * np.log(np.maximum(shape["run"], 1) / model["usual"]) / np.log(FAR_RUN)
    season = (payload - model["level"][hour]) / model["season"] / 2 + LEVELS / 2
    each = [_far(shape["distance"] / model["scatter"]), _far(shape["difference"] / model["scatter"]), season, run]
    return _number(*(np.clip(np.floor(v), 0, LEVELS - 1).astype(np.int64) for v in each))


_PARTS = "address long, kind int, bin long, n long, v double, s binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of units as rows that can be added up: kinds 0 to 2 by bin, kind 3 sample rows by hash."""
    for units in _together(batches):
        rows: list[tuple] = []
        shaped = _Shaped(units)
        for i, address in enumerate(u["address"] for u in units):
            summary = shaped.summary(i)
            for kind, name in enumerate(("away", "runs")):
                rows += [(address, kind, int(b), int(n), 0.0, None) for b, n in zip(*summary[name])]
            rows += [(address, 2, h, int(n), float(v), None) for h, (v, n) in enumerate(zip(*summary["hours"])) if n]
            rows += [(address, 3, int(r), 1, 0.0, s.tobytes()) for r, s in zip(*summary["sample"])]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        part = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds)], ["address", "kind", "bin", "n", "v", "s"])


def _models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, "address", ROWS):
        get = {c: rows.column(c).to_numpy() for c in ("address", "kind", "bin", "n", "v")}
        start = np.flatnonzero(np.r_[True, get["address"][1:] != get["address"][:-1]])
        out = []
        for a, b in zip(start, np.r_[start[1:], len(get["address"])]):
            kind, bins, n, v = (get[c][a:b] for c in ("kind", "bin", "n", "v"))
            hours = np.zeros(24), np.zeros(24)
            hours[0][bins[kind == 2]], hours[1][bins[kind == 2]] = v[kind == 2], n[kind == 2]
            sample = np.frombuffer(b"".join(x.as_py() for x in rows.column("s").slice(a, b - a) if x.is_valid), _SAMPLE)
            out.append(pickle.dumps(_model(*((bins[kind == k], n[kind == k]) for k in (0, 1)), hours, sample)))
        yield pa.RecordBatch.from_arrays([pa.array(get["address"][start]), pa.array(out, pa.binary())], ["m_address", "model"])


def _scored(only_found: bool, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units in _together(batches):
            yield _score(units, only_found, cut)

    return run


def _score(units: list[dict], only_found: bool, cut: float) -> pa.RecordBatch:
    shaped = _Shaped(units)
    shape, source, words = shaped.shape, shaped.source, shaped.words
    models: list[dict] = []
    # Units of one source share its forest; a source of one unit has its model from that.
    place: dict[int, int] = {}
    forest = np.zeros(len(units), np.int64)
    for i, u in enumerate(units):
        forest[i] = place.setdefault(u["address"], len(models))
        if forest[i] < len(models):
            continue
        if u["model"] is not None:
            models.append(pickle.loads(u["model"]))
        else:
            summary = shaped.summary(i)
            rank, sample = summary["sample"]
            models.append(_model(summary["away"], summary["runs"], summary["hours"], sample[np.argsort(rank, kind="stable")[:SAMPLE]]))
    each = [slice(a, b) for a, b in zip(shaped.bounds, shaped.bounds[1:])]
    whole = np.concatenate([_cells(shape[s], words["payload"][s], shaped.hour[s], models[f]) for s, f in zip(each, forest)])
    level, difference, _, run = _features(whole).T
    far = _number(level, difference, LEVELS // 2, 0)
    stuck = _number(0, 0, LEVELS // 2, run)
    of = forest[source]
    asked = np.concatenate([np.stack([of, x]) for x in (whole, far, stuck)], axis=1)
    sampled = np.concatenate([np.stack([np.full(len(m["sample"][0]), i), *m["sample"]]) for i, m in enumerate(models)], axis=1)
    keys = np.concatenate([asked[0] * LEVELS**4 + asked[1], sampled[0] * LEVELS**4 + sampled[1]])
    distinct, at = np.unique(keys, return_inverse=True)
    weight = np.bincount(at[asked.shape[1] :], sampled[2], minlength=len(distinct))
    score = scores(distinct // LEVELS**4, _features(distinct % LEVELS**4), weight)[at[: asked.shape[1]]]
    score, by_distance, by_run = score.reshape(3, -1)
    reason = np.full(len(shape), None, object)
    reason[by_run >= cut] = "stuck"
    reason[np.minimum(score, by_distance) >= cut] = "spike"
    reason[shape["out"]] = "limit"
    score = np.where(shape["out"], 1.0, np.where(by_run >= cut, np.maximum(score, by_run), score))
    deviation = shape["distance"] / np.array([m["scatter"] for m in models])[of]
    keep = np.flatnonzero(np.not_equal(reason, None)) if only_found else np.arange(len(shape))
    word = {c: v[keep] for c, v in words.items()}
    unit = {c: np.array([u[c] for u in units], np.int64)[source[keep]] for c in ("address", "window_id")}
    time = (word["time"].view(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    columns = [word["seq"], unit["address"], unit["window_id"], time, word["payload"], score[keep], np.where(shape["out"][keep], np.nan, deviation[keep]).astype(np.float64), shape["run"][keep].astype(np.int64)]
    arrays = [pa.array(c) for c in columns] + [pa.array(reason[keep], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["seq", "address", "window_id", "time", "payload", "score", "deviation", "run", "reason"])


def implausible(points: DataFrame, windows: DataFrame, limits: DataFrame, only_found: bool = False, cut: float = CUT) -> DataFrame:
    """Every reading within a window with its score and, if it is implausible, the reason.

    points: address, time, payload, seq LONG; of repeated deliveries of an
    (address, time) the first counts. windows: window_id, address, unit,
    start_time, step_ns, n_slots; those of an address must not overlap. limits:
    unit, lowest, highest, both allowed; a null or missing limit does not bound.
    Rows with a null address, time, payload or seq, and rows outside windows,
    are no readings.

    Result: seq, address, window_id, time, payload; score of the forest (1 for
    readings outside the limits); deviation (distance from its neighbours in
    usual scatters of the source, NaN outside the limits or without
    neighbours); run (length of its run of equal readings); reason: 'limit',
    'spike', 'stuck' or null. only_found leaves out those without a reason.
    cut: score from which on a reading is isolated. Readings of sources with
    fewer than forest.LEAST changes of value have a score of 0 and can only
    break limits. Empty tables give no rows.
    """
    spark = points.sparkSession
    n = shuffle_partitions(spark, points)
    firsts = first_deliveries(points.select("address", "time", "payload", "seq")).filter(F.col("payload").isNotNull() & F.col("seq").isNotNull())
    bounds = limits.filter(F.col("unit").isNotNull()).groupBy("unit").agg(F.max("lowest").alias("lowest"), F.min("highest").alias("highest"))
    unit = windows.filter(F.col("unit").isNotNull()).select("window_id", F.col("address").alias("u_address"), F.col("start_time").alias("u_start"), "unit").distinct()
    # A window with several times as many readings as slots gets units that are as many times shorter. Repeats count here:
    # units only bound the work.
    window = ["window_id", "address", "start_time"]
    slots = proper_windows(windows).withColumn("window_id", F.coalesce("window_id", F.lit(-1).cast("long"))).distinct()
    some = points.select("address", "time").filter(F.col("payload").isNotNull() & F.col("seq").isNotNull())
    inside = in_windows(some, slots).groupBy(*window).agg(F.count("*").alias("rows"))
    proper = slots.join(inside, window, "left")
    proper = proper.withColumn("dense", F.least(F.col("step_ns"), F.greatest(F.lit(1).cast("long"), F.expr("coalesce(rows, 0) div n_slots"))))
    proper = proper.withColumn("unit_ns", F.greatest(F.lit(1).cast("long"), F.expr(f"coalesce(try_multiply(step_ns, {BLOCK}L), {_LONGEST}L) div dense")))
    proper = proper.withColumn("blocks", F.expr("(last - first) div unit_ns + 1")).drop("rows", "dense")
    per_source = proper.groupBy(F.col("address").alias("s_address")).agg((F.sum("blocks") == 1).alias("solo"))
    proper = proper.join(per_source, F.col("address") == F.col("s_address")).drop("s_address")
    unit = unit.withColumn("window_id", F.coalesce("window_id", F.lit(-1).cast("long")))
    named = unit.join(bounds, "unit", "left").groupBy("window_id", "u_address", "u_start").agg(F.max("lowest").alias("lowest"), F.min("highest").alias("highest"))
    proper = proper.join(
        named, (proper["window_id"] == named["window_id"]) & (F.col("address") == F.col("u_address")) & (F.col("start_time") == F.col("u_start")), "left"
    ).drop(named["window_id"]).drop("u_address", "u_start")
    # Small beside the points: one row per window.
    proper = materialise(proper, "windows")
    reads = in_windows(firsts, proper, "payload", "seq").withColumnRenamed("p_payload", "payload").withColumnRenamed("p_seq", "seq")
    reads = reads.withColumn("block", F.expr("offset div unit_ns"))
    out = F.coalesce((F.col("payload") < F.col("lowest")) | (F.col("payload") > F.col("highest")), F.col("payload") < F.col("lowest"), F.col("payload") > F.col("highest"), F.lit(False))
    flags = sum((F.when(c, F.lit(bit)).otherwise(F.lit(0)) for bit, c in ((_OUT, out), (_SOLO, F.col("solo")), (_ONLY, F.col("blocks") == 1))), F.lit(0))
    rows = reads.select(
        "address", "window_id", F.col("start_time").alias("start"), "block", order_key(F.col("p_time")).alias("at"), "seq", "payload", flags.cast("int").alias("flags"),
        F.xxhash64("window_id", "address", "start_time", "block").alias("unit_key"),
    )
    sorted_rows = rows.repartition(n, "unit_key").sortWithinPartitions("unit_key", "address", "block", "at", "seq")
    units = materialise(sorted_rows.mapInArrow(_units(PIECE), _UNIT), "units")
    longest = proper.agg(F.coalesce(F.max("blocks"), F.lit(0))).first()[0]
    contexts = materialise(_stitched(units, longest, n), "contexts")
    place = [F.col(c) == F.col(f"c_{c}") for c in ("address", "window_id", "start", "block")]
    units = bounded_join(units.drop("edge"), contexts, place[0] & place[1] & place[2] & place[3], "left", BROADCAST_CONTEXTS)
    parts = units.filter(~F.col("solo")).select("address", "seq", "time", "payload", "out", "context").mapInArrow(_parts, _PARTS)
    sums = parts.filter(F.col("kind") < 3).groupBy("address", "kind", "bin").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).withColumn("s", F.lit(None).cast("binary"))
    first = F.row_number().over(Window.partitionBy("address").orderBy("bin"))
    sample = parts.filter(F.col("kind") == 3).withColumn("nth", first).filter(F.col("nth") <= SAMPLE).drop("nth")
    model_parts = sums.unionByName(sample).repartition(n, "address").sortWithinPartitions("address", "kind", "bin")
    models = materialise(model_parts.mapInArrow(_models, "m_address long, model binary"), "models")
    joined = bounded_join(units, models, F.col("address") == F.col("m_address"), "left", BROADCAST_MODELS, F.struct("window_id", "block"))
    return joined.select("address", "window_id", "seq", "time", "payload", "out", "context", "model").mapInArrow(_scored(only_found, cut), RESULT)
