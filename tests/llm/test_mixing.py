from __future__ import annotations

import random

import pytest

from tideline.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id long, text string, source string, tokens long, rank int, w double"


def docs(spark, spec, seed=0):
    r = random.Random(seed)
    rows = []
    for source, n in spec:
        for _ in range(n):
            text = " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(1, 40)))
            rows.append((len(rows), text, source, 1, 1, r.random()))
    return spark.createDataFrame(rows, DOCS).repartition(3)


def check(m, targets, slack):
    report = {r.source: r for r in m.report.collect()}
    copies = m.copies.collect()
    assert len({r.doc_id for r in copies}) == len(copies)
    total = sum(r.tokens * r.copies for r in copies)
    for source, (share, cap) in targets.items():
        own = [r for r in copies if r.source == source]
        assert all(1 <= r.copies <= cap for r in own)
        r = report[source]
        got = sum(x.tokens * x.copies for x in own)
        assert (r.tokens, r.documents, r.repeats_used) == (got, len(own), max((x.copies for x in own), default=0))
        assert r.actual_share == pytest.approx(got / total if total else 0)
        if r.available_tokens:
            assert abs(got - share * total / sum(s for k, (s, _) in targets.items() if report[k].available_tokens)) <= slack
    assert {r.source for r in copies} <= set(targets)
    return report, copies


def test_shares_caps_and_whole_copies(spark):
    d = docs(spark, [("a", 400), (" A", 30), ("B", 100), ("c", 20), ("other", 50), (None, 20)])
    targets = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.15, 8), "gone": (0.05, 2)}
    t = spark.createDataFrame([(k.upper() + " ", *v) for k, v in targets.items()] + [(None, 0.1, 1), ("x", None, 1), ("y", 0.1, 0)], TARGETS)
    m = M.mix(d, t)
    report, copies = check(m, targets, 60)
    # The scarcest source is used as often as it may be, whole.
    assert any(r.repeats_used == r.max_repeats and r.tokens == r.max_repeats * r.available_tokens for r in report.values())
    small = {r.copies for r in copies if r.source == "c"}
    assert max(small) - min(small) <= 1  # whole copies are certain, one more is drawn
    assert report["gone"].tokens == 0 and report["gone"].actual_share == 0
    again = M.mix(d.repartition(7), t).copies.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, copies))
    half = M.mix(d, t, total_tokens=2000)
    check(half, targets, 60)
    assert sum(r.tokens * r.copies for r in half.copies.collect()) == pytest.approx(2000, abs=120)


def test_inclusion_follows_the_weights(spark):
    """Documents of weight 4 get into a small sample about four times as often as those of weight 1."""
    rows = [(i, "one two three four", "a", 1, 1, 4.0 if i % 2 else 1.0) for i in range(4000)]
    d = spark.createDataFrame(rows, DOCS)
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    size = M.sized(d).select("tokens").first().tokens
    found = M.mix(d, t, total_tokens=500 * size, weight="w").copies.collect()
    heavy = sum(r.doc_id % 2 for r in found)
    assert len(found) == 500  # equal sizes: fixed size exactly
    assert 340 <= heavy <= 455
    assert M.mix(d.withColumn("w", d.w * 0), t, weight="w").copies.count() == 0


def test_cut_is_exact(spark):
    d = docs(spark, [("a", 3000)], seed=4)
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    found = M.mix(d, t, total_tokens=7001).copies.collect()
    assert abs(sum(r.tokens for r in found) - 7001) <= 25  # half of the longest document


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    m = M.mix(spark.createDataFrame([], DOCS), t)
    assert m.copies.count() == 0 and [(r.source, r.tokens) for r in m.report.collect()] == [("a", 0)]
    m = M.mix(docs(spark, [("a", 3)]), spark.createDataFrame([], TARGETS))
    assert m.copies.count() == 0 and m.report.count() == 0
    none = spark.createDataFrame([(1, None, "a", 1, 1, 1.0), (2, "", "a", 1, 1, 1.0)], DOCS)
    assert M.mix(none, t).copies.count() == 0


def test_the_registered_mix_has_unequal_odds(spark):
    """Longer documents of a source that is not used whole are likelier, and every source reaches its share."""
    from tideline.llm import queries as Q

    sf = "/root/testdata/sf0.01"
    report = {r.source: r for r in Q.QUERIES["p7_report"](spark, sf).collect()}
    copies = Q.QUERIES["p7_mix"](spark, sf).collect()
    used = {r.source for r in copies}
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    whole = sum(r.target_share for r in report.values() if r.available_tokens)
    for r in report.values():
        assert r.tokens == sum(c.tokens * c.copies for c in copies if c.source == r.source)
        assert r.repeats_used <= r.max_repeats and (not r.available_tokens or abs(r.actual_share - r.target_share / whole) < 0.02)
    all_ = M.sized(Q.table(spark, sf, "documents")).filter("tokens > 0").collect()
    taken = {c.doc_id: c.copies for c in copies}
    gain = []
    for s in used:
        own = sorted((d for d in all_ if d.source == s), key=lambda d: d.tokens)
        if report[s].tokens < report[s].available_tokens * report[s].max_repeats * 0.9:
            half = len(own) // 2
            gain.append(sum(taken.get(d.doc_id, 0) for d in own[half:]) / half - sum(taken.get(d.doc_id, 0) for d in own[:half]) / half)
    assert gain and sum(gain) / len(gain) > 0.03
