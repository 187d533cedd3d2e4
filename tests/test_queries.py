"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import differences

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith(("p6_", "p7_", "p8_"))]


def test_entry(spark):
    assert entry.entry(spark).schema.names == ["seq"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    _, more, less = differences(spark, con, name, SF)
    assert not more and not less


def test_readings_are_scored_once(spark, con):
    """What SQL can say of problem 5: which rows are readings, which break limits, and that found rows are those with a reason."""
    readings = f"""
    SELECT p.seq, p.payload < u.lowest OR p.payload > u.highest AS beyond
    FROM simple_points p JOIN reading_windows w ON p.address = w.address AND p.time >= w.start_time AND p.time < w.start_time + w.step_ns * w.n_slots
    JOIN units u USING (unit)
    WHERE p.payload IS NOT NULL AND p.seq NOT IN ({entry.oracle_sql()["p1_found"].split("UNION ALL")[0]})"""
    want = dict(con.sql(readings).fetchall())
    scores = entry.queries()["p5_scores"](spark, SF).collect()
    assert sorted(r.seq for r in scores) == sorted(want)
    assert {r.seq for r in scores if r.reason == "limit"} == {k for k, beyond in want.items() if beyond}
    found = [r.seq for r in entry.queries()["p5_found"](spark, SF).collect()]
    assert sorted(found) == sorted(r.seq for r in scores if r.reason)


def test_rest_does_not_import_llm():
    import re
    from pathlib import Path

    import tideline

    root = Path(tideline.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"tideline\.llm|from tideline import llm", p.read_text()), p
