"""Isolation forests of many sources at once, over shared random cuts.

Features are standardised, so all sources live in one box, cut into LEVELS
cells along each feature. A tree cuts the box at random: at each node a random
feature, and a random border between cells of the node's part of the box. These
cuts are drawn once. What makes a tree a source's own is how many readings of
its sample lie in each node: a reading is isolated where few of them (FEW, or a
sixteenth of a small sample) are left with it. As in any isolation forest, the
fewer cuts that takes on average, the odder the reading; readings farther out
than any in the sample are isolated by the cuts between, which cuts drawn
between the sample's extremes could not do.

Readings in one cell share their score, so a source of millions of readings
costs as much as its distinct cells.
"""

from __future__ import annotations

from functools import cache

import numpy as np

TREES, DEPTH = 128, 12
#: Cells of the box along each feature.
LEVELS = 24
#: Readings of the sample that are few, and the samples of which a sixteenth is fewer.
FEW = 6
#: Readings of a sample below which a forest isolates nothing.
LEAST = 8
#: Size of a full sample, by which scores are normalised.
SAMPLE = 256
_SEED = 20250303


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, np.float64), 1)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


@cache
def _trees(features: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of each inner node of each tree; the children of i are 2i and, from the cut on, 2i+1."""
    draw = np.random.default_rng(_SEED)
    nodes, tree = 1 << DEPTH, np.arange(TREES)
    feature, cut = np.zeros((TREES, nodes), np.int8), np.zeros((TREES, nodes), np.int16)
    low = np.zeros((TREES, 2 * nodes, features), np.int16)
    high = np.full((TREES, 2 * nodes, features), LEVELS - 1, np.int16)
    for i in range(1, nodes):
        wide = high[:, i] > low[:, i]
        f = (draw.random((TREES, features)) * wide).argmax(axis=1)
        lo, hi = low[tree, i, f], high[tree, i, f]
        # A part of one cell cannot be cut: all goes to the left.
        c = np.where(wide.any(axis=1), lo + 1 + (draw.random(TREES) * (hi - lo)).astype(np.int16), LEVELS)
        feature[:, i], cut[:, i] = f, c
        low[:, 2 * i] = low[:, 2 * i + 1] = low[:, i]
        high[:, 2 * i] = high[:, 2 * i + 1] = high[:, i]
        high[tree, 2 * i, f] = np.minimum(c - 1, hi)
        low[tree, 2 * i + 1, f] = np.where(c == LEVELS, lo, c)
    return feature, cut


def scores(source: np.ndarray, cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores of cells: towards 1 the easier to isolate, about 0.3 the usual, 0 without a sample of LEAST.

    source: number of the source of each; cells: a column per feature, from 0
    to LEVELS - 1; weight: readings of the source's sample in the cell, 0 of
    cells that are only asked about. A (source, cell) must come once.
    """
    feature, cut = _trees(cells.shape[1])
    out = np.zeros(len(source))
    size = np.bincount(source, weight).astype(np.int64)
    few = np.maximum(2, np.minimum(FEW, size // 16))
    judged = np.flatnonzero(size[source] >= LEAST)
    source, cells, weight = source[judged], cells[judged], weight[judged].astype(np.float64)
    path = np.zeros(len(source))
    for t in range(TREES):
        live, node = np.arange(len(source)), np.ones(len(source), np.int64)
        for level in range(DEPTH + 1):
            if not len(live):
                break
            own = source[live]
            at = (own << level) + node - (1 << level)
            mass = np.bincount(at, weight[live])[at]
            done = (mass <= few[own]) | (level == DEPTH)
            path[live[done]] += level + _expected(mass[done])
            live, node = live[~done], node[~done]
            if level < DEPTH:
                node = 2 * node + (cells[live, feature[t, node]] >= cut[t, node])
    out[judged] = 2.0 ** (-path / TREES / float(_expected(np.array(SAMPLE))))
    return out
