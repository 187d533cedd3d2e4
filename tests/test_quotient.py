from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.operators import quotient as Q

SCHEMA = "address long, time long, payload long, seq long, __shard string"
words = st.lists(st.tuples(st.integers(0, 2**64 - 1) | st.integers(0, 5), st.integers(0, 2**64 - 1) | st.integers(0, 5)), max_size=200)


@given(words)
@settings(max_examples=100, deadline=None)
def test_permutation_is_one_to_one(pairs):
    a, b = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    back = Q.unpermute(*Q.permute(a, b))
    assert (back[0] == a).all() and (back[1] == b).all()


@given(words)
@settings(max_examples=100, deadline=None)
def test_slots_are_exact(pairs):
    pairs = pairs + pairs[::2]
    a, b = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    slots = Q.insert(a, b).tolist()  # unpermuted: the worst case for probing
    by = defaultdict(set)
    for p, s in zip(pairs, slots):
        by[p].add(s)
    assert all(len(s) == 1 for s in by.values())
    assert len({next(iter(s)) for s in by.values()}) == len(by)


def brute(rows):
    least = {}
    for a, t, _, s, _ in rows:
        if a is not None and t is not None:
            o = 2**63 - 1 if s is None else s
            least[a, t] = min(o, least.get((a, t), o))
    later = [r for r in rows if r[0] is not None and r[1] is not None and (2**63 - 1 if r[3] is None else r[3]) > least[r[0], r[1]]]
    return later, least


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    later, least = brute(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, Q.redelivered(df).collect()), key=key) == sorted(later, key=key)
    first = [tuple(r) for r in Q.first_deliveries(df).collect()]
    whole = [r for r in first if r[0] is not None and r[1] is not None]
    assert {(r[0], r[1]): (2**63 - 1 if r[3] is None else r[3]) for r in whole} == least and len(whole) == len(least)
    assert len(first) - len(whole) == sum(r[0] is None or r[1] is None for r in rows)
    assert sorted(first, key=key) == sorted(map(tuple, Q.first_deliveries(df.repartition(5)).collect()), key=key)


def test_nulls_ties_and_clashing_columns(spark):
    rows = [
        (2, 1, 5, 10, "a"), (2, 1, 6, 9, "b"), (2, 1, None, 11, None), (None, 1, 1, 12, "n"), (None, 1, 1, 13, "n"), (2, None, 1, 14, "n"),
        (4, 1, 7, 3, "x"), (4, 1, 7, 3, "x"), (4, 1, 8, 3, "y"), (6, 0, 1, None, "z"), (6, 0, 1, 2**40, ""), (-2, -1, 0, 5, ""), (-2, -1, 0, 4, "x" * 100_000),
    ]
    check(spark, rows)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.redelivered(empty).count() == 0 and Q.first_deliveries(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)], SCHEMA)
    assert Q.redelivered(nulls).count() == 0 and Q.first_deliveries(nulls).count() == 1


@pytest.mark.parametrize("hot", [0, 1000])
def test_many(spark, monkeypatch, hot):
    rng = np.random.default_rng(1)
    rows = [(int(a) * 2, int(t), 1, i, None) for i, (a, t) in enumerate(zip(rng.integers(0, 40, 3000), rng.integers(0, 50, 3000)))]
    rows += [(2, 7, 2, 10_000 + i, None) for i in range(hot)]
    check(spark, rows)
