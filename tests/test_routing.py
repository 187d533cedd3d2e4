from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import u64
from tideline.plans.routing import Index

word = st.integers(0, u64.MAX_WORD) | st.integers(0, 40)
indexes = st.dictionaries(word, st.integers(1, 128), max_size=8).map(lambda d: Index.of([(0, 5), *d.items()]))


@given(indexes, word, word, word)
@settings(max_examples=300, deadline=None)
def test_range_has_the_epoch_of_every_time_in_it(index, start, end, time):
    start, end = min(start, end), max(start, end)
    found = index.in_range(start, end)
    assert found == sorted(set(found)) and found[0] == index.lookup(start)
    if start <= time <= end:
        assert index.lookup(time) in found


@given(indexes)
@settings(max_examples=100, deadline=None)
def test_codec(index):
    assert Index.from_bytes(index.to_bytes() + b"part") == index


def test_intervals():
    index = Index.of([(0, 4), (6, 10)])
    assert [index.lookup(t) for t in (0, 1, 6, 7, u64.MAX_WORD)] == [(0, 4), (0, 4), (0, 4), (6, 10), (6, 10)]
    assert index.locate(8, 8) == (6, 8) and index.locate(2, 3) == (0, 2) and index.locate(6, 5) == (0, 0)
    assert index.later(0) == [(6, 10)]
    assert index.targets(0, 21, [14, 4, 6, 15]) == [(0, [2, 0]), (6, [4, 6])]
    assert Index.of([(0, 4), (8, 1), (20, 1)]).in_range(8, 21) == [(0, 4), (8, 1), (20, 1)]  # a read that starts on an epoch
    assert index.in_range(3, 2) == []
    for bad in ([], [(0, 0)], [(0, 1 << 62)], [(-1, 1)]):
        with pytest.raises(ValueError):
            Index.of(bad)


def test_columns_agree(spark):
    index = Index.of([(0, 3), (7, 128), (2**63 - 1, 5), (2**63, 9), (2**64 - 1, 2)])
    times = [0, 1, 7, 8, 2**63 - 2, 2**63 - 1, 2**63, 2**63 + 1, 2**64 - 2, 2**64 - 1]
    addresses = [0, 1, 2, 255, 2**63 - 1, 2**63, 2**64 - 1, 2**64 - 2]
    pairs = [(t, a) for t in times for a in addresses]
    df = spark.createDataFrame([(u64.to_signed(t), u64.to_signed(a)) for t, a in pairs], "time long, address long")
    found = {(u64.to_unsigned(r.time), u64.to_unsigned(r.address)): (u64.to_unsigned(r.epoch), r.bucket) for r in index.located(df).collect()}
    assert found == {p: index.locate(*p) for p in pairs}


def test_between(spark):
    values = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(u64.to_signed(v),) for v in values], "v long")
    for low in values:
        for high in values:
            got = {u64.to_unsigned(r.v) for r in df.filter(u64.between(F.col("v"), low, high)).collect()}
            assert got == {v for v in values if low <= v <= high}


def test_words():
    assert u64.to_signed(u64.MAX_WORD) == -1 and u64.to_unsigned(-1) == u64.MAX_WORD
    for bad in (-1, 1 << 64):
        with pytest.raises(ValueError):
            u64.to_signed(bad)
