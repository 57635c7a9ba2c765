"""Evaluations without SQL against plain Python, and the session's checks."""

import itertools

import pytest

from causeway import session
from causeway.operators import nested
from causeway.plans import evaluations as E

DOT = {"a": {"x": 0.9, "y": 0.6}, "b": {"x": 0.8, "z": 0.45}, "c": {"y": 0.5}}


def best_sum(threshold):
    """The matching with the greatest sum of 1 + similarity among pairs that reach the threshold, and its similarities' sum."""
    found = (0.0, 0.0)
    for k in range(4):
        for left in itertools.permutations("abc", k):
            for right in itertools.combinations("xyz", k):
                sims = [DOT[p].get(q, -1) for p, q in zip(left, right)]
                if all(s >= threshold for s in sims):
                    found = max(found, (sum(1 + s for s in sims), sum(sims)))
    return found[1]


def test_threshold_calibration(spark, monkeypatch):
    rows = [(2, "event", a, b, s) for a, of in DOT.items() for b, s in of.items()]
    found = spark.createDataFrame(rows, "graph_id long, node_type string, node_id string, ref_node_id string, similarity double")
    pairs = spark.createDataFrame([(2, 1, 1), (3, 1, 2)], "graph_id long, ref_id long, run_no int")
    nodes = spark.createDataFrame([(g, n) for g in (1, 2, 3) for n in "abc"], "graph_id long, node_id string")
    monkeypatch.setattr(E, "_typed", lambda *_: (E.cut.__globals__["Graphs"](None, nodes, None, None, pairs), found))
    out = {r.threshold: r for r in E.threshold_calibration(spark, "").collect()}
    assert set(out) == set(E.GRID) and all(r.graphs == 1 for r in out.values())
    expected = {t: round(best_sum(t) / 3, 6) for t in E.GRID}
    assert {t: r.mean_f1 for t, r in out.items()} == pytest.approx(expected, abs=1e-6)
    top = max(expected.values())
    assert [t for t, r in out.items() if r.chosen] == [max(t for t, v in expected.items() if v == top)]


def test_duplicate_keys_and_deep_wraps(spark):
    deep = '{"incidents": [{"incident_id": "i1"}]}'
    for _ in range(9):
        deep = '{"answer": [' + deep + "]}"
    rows = [(1, '{"a": 1, "a": 2, "b": {"c": 1, "c": 1, "c": 2}}'), (2, 'so: {"a": [{"x": 1}, {"x": 2}]}'), (3, None), (4, "no json"), (5, deep), (1, '{"a": 1, "a": 2, "b": {"c": 1, "c": 1, "c": 2}}')]
    df = spark.createDataFrame(rows, "output_id long, payload string")
    assert [tuple(r) for r in nested.duplicate_keys(df, "output_id", "payload").collect()] == [(1, 3)]
    assert [(r.output_id, r.item) for r in nested.child_records(df).collect()] == [(5, "i1")]
    assert nested.duplicate_keys(df.limit(0), "output_id", "payload").count() == 0


def test_broadcasts_are_checked_in_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few = spark.range(10).selectExpr("id", "repeat('x', 100) as text", "array(id) as list")
    assert hinted(session.broadcast_if_small(few)) and not hinted(session.broadcast_if_small(few, rows=9))
    assert not hinted(session.broadcast_if_small(spark.range(40).selectExpr("id", "repeat('x', 1000000) as text")))
    assert hinted(session.broadcast_if_small(few.limit(0)))


def test_status_of_graphs_without_reference(spark):
    """A graph whose report has no reference graph is a failed case, not a missing row."""
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    rows = E.graph_case_evaluation(spark, "/root/testdata/sf0.001").collect()
    assert {r.status for r in rows} <= {"ok", "failed"} and len({r.graph_id for r in rows}) == len(rows)
    assert all((r.status == "ok") == (r.overall is not None) for r in rows)
