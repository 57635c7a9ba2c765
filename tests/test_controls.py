"""Negative controls: the whole grid, its scores, and what is made of them."""

import collections
import random

import pytest

from causeway.operators import assign, compare, panel, perturb
from causeway.plans import panels

TYPES = {"H1": "hazardconsequence", "En1": "entity", "C1": "condition", "Ev1": "event", "Ev2": "event"}
ARCS = [("En1", "C1", "has"), ("C1", "Ev1", "enables"), ("Ev1", "Ev2", "enables"), ("Ev2", "H1", "enables")]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(g, n, t, f"L{t[:1]}{g if n == 'Ev1' else ''}") for g in (1, 2, 3) for n, t in TYPES.items()]
    nodes = spark.createDataFrame(rows, "graph_id long, node_id string, node_type string, label string")
    return nodes, spark.createDataFrame([(g, *a) for g in (1, 2, 3) for a in ARCS[: g + 1]], "graph_id long, source string, target string, relation string")


def test_sweep_is_whole_and_scored(tables):
    rows = perturb.perturbation_sweep(*tables).where("graph_id = 3").collect()
    assert len(rows) == 1 + 5 * 3 * 100
    assert {r.severity for r in rows if r.replicate} == {0.25, 0.5, 0.75} and len({(r.control, r.severity, r.replicate) for r in rows}) == len(rows)
    assert [(r.wl_similarity, r.edit_distance, r.edit_similarity) for r in rows if r.control == "positive_control"] == [(1.0, 0.0, 1.0)]
    assert any(r.wl_similarity < 1 and r.edit_distance > 0 for r in rows if r.control == "edge_direction_reversal")


def test_scores_are_those_of_the_graph_queries(spark, tables):
    nodes, edges = tables
    pairs = spark.createDataFrame([(1, 3), (2, 3)], "graph_id long, ref_id long")
    refined = {r.graph_id: r.similarity for r in compare.refinement_similarity(pairs, compare.refined_labels(nodes, edges)).collect()}
    edited = {r.graph_id: r.distance for r in assign.bipartite_edit(pairs, nodes, edges).collect()}
    of = lambda g: ({n: f"L{t[:1]}{g if n == 'Ev1' else ''}" for n, t in TYPES.items()}, {(s, t): r for s, t, r in ARCS[: g + 1]})
    for g in (1, 2):
        assert round(perturb.histogram_similarity(perturb.refinement(*of(g)), perturb.refinement(*of(3))), 6) == refined[g]
        assert sum(assign.edit_counts(TYPES, of(g)[1], TYPES, of(3)[1]).values()) == edited[g]


def test_summary(spark, tables, monkeypatch):
    monkeypatch.setattr(panels, "graph_perturb_sweep", lambda *_: perturb.perturbation_sweep(*tables))
    rows = panels.controls_summary(spark, "").collect()
    assert len(rows) == 5 * 3 * 2 and all(r.reports == 3 and r.ci_low <= r.mean_score <= r.ci_high for r in rows)
    assert len(panels.controls_monotonicity(spark, "").collect()) == 5 * 2
    assert panel.t_quantile(10) == pytest.approx(2.2281388, abs=1e-6)


@pytest.fixture(scope="module")
def random_runs(spark):
    """Some random graphs, their runs, the nodes that go, and the edges that are left, by run."""
    rng = random.Random(21)
    kinds = ["entity", "event", "condition"]
    types, arcs = {}, {}
    for g in range(1, 8):
        names = [f"N{k}" for k in range(3 + 2 * g)]
        types[g] = {x: rng.choice(kinds) for x in names} | {"H1": "hazardconsequence"}
        pairs = [(a, b) for a in types[g] for b in types[g]]
        arcs[g] = {e: f"r{k}" for k, e in enumerate(rng.sample(pairs, 4 * g))}
    nodes = spark.createDataFrame([(g, n, t, t) for g in types for n, t in types[g].items()], "graph_id long, node_id string, node_type string, label string")
    edges = spark.createDataFrame([(g, *e, r) for g in arcs for e, r in arcs[g].items()], "graph_id long, source string, target string, relation string")
    _, gone, after = perturb.perturbed(nodes, edges, replicates=5)
    lost, left = {}, {}
    for r in gone.collect():
        lost.setdefault((r.graph_id, r.control, r.severity, r.replicate), set()).add(r.node_id)
    for r in after.collect():
        left.setdefault((r.graph_id, r.control, r.severity, r.replicate), []).append(r)
    return types, arcs, lost, left


def many(total, severity):
    return min(total, max(1, round(total * severity))) if total else 0


def test_what_each_control_changes(random_runs):
    types, arcs, lost, left = random_runs
    for g, control, severity, k in [(g, c, s, k) for g in types for c in perturb.CONTROLS for s in perturb.SEVERITIES for k in range(1, 6)]:
        rows, gone = left.get((g, control, severity, k), []), lost.get((g, control, severity, k), set())
        now = {(r.source, r.target): r for r in rows}
        assert len(now) == len(rows), "no parallel edges"
        whole = {e for e in arcs[g] if not gone & set(e)}
        if control in ("node_deletion", "combined"):
            assert "H1" not in gone and len(gone) == many(len(types[g]) - 1, severity)
        else:
            assert not gone
        if control == "node_deletion":
            assert set(now) == whole
        elif control == "edge_deletion":
            assert set(now) < whole and len(now) == len(whole) - many(len(whole), severity)
        elif control == "edge_direction_reversal":
            turnable = {(s, t) for s, t in whole if s != t and (t, s) not in whole}
            turned = [e for e, r in now.items() if r.turned]
            assert len(turned) == min(many(len(whole), severity), len(turnable)) and {e[::-1] for e in turned} <= turnable
            assert {e for e, r in now.items() if not r.turned} == whole - {e[::-1] for e in turned}
        else:
            swapped = [e for e, r in now.items() if r.swapped]
            assert len(now) == len(whole) and len(swapped) % 2 == 0 and len(swapped) <= 2 * -(-many(len(whole), severity) // 2)
            if control == "edge_endpoint_rewiring":
                degrees = lambda es, i: collections.Counter(e[i] for e in es)
                assert degrees(now, 0) == degrees(whole, 0) and degrees(now, 1) == degrees(whole, 1)
                assert not set(swapped) & whole and not any(s == t for s, t in swapped) and {r.relation for r in rows} == set(arcs[g].values())
            elif not any(r.turned for r in rows) and not swapped:
                assert set(now) == whole


def test_runs_differ_and_repeat(spark, tables, random_runs):
    *_, left = random_runs
    shapes = collections.defaultdict(set)
    for (g, control, severity, _), rows in left.items():
        shapes[g, control, severity].add(frozenset((r.source, r.target) for r in rows))
    assert sum(len(x) > 1 for x in shapes.values()) > len(shapes) / 2
    again = [perturb.perturbation_changes(*tables, replicates=2).orderBy(*perturb.RUN).collect() for _ in range(2)]
    assert again[0] == again[1] and len(again[0]) == 3 * 15 * 2
    assert perturb.perturbation_changes(tables[0], tables[1].limit(0), replicates=1).where("edges_kept < 1 or edges_after > 0").count() == 0


def test_runs_of_a_graph_are_scored_together(random_runs):
    types, arcs, lost, left = random_runs
    for g in types:
        nodes = [{"node_id": n, "node_type": t, "label": t} for n, t in sorted(types[g].items())]
        runs = [(g, c, s, k) for c in perturb.CONTROLS for s in perturb.SEVERITIES for k in range(1, 6)]
        shapes = [(lost.get(r, set()), {(e.source, e.target): e.relation for e in left.get(r, [])}) for r in runs]
        alike, distance, _ = perturb.score_runs(nodes, arcs[g], shapes)
        for (gone, now), a, d in zip(shapes, alike, distance, strict=True):
            kept = {n: t for n, t in types[g].items() if n not in gone}
            assert d == sum(assign.edit_counts(kept, now, types[g], arcs[g]).values())
            assert a == round(perturb.histogram_similarity(perturb.refinement(kept, now), perturb.refinement(types[g], arcs[g])), 6)


def test_no_run_is_shuffled(tables):
    # a run is made and scored where its graph is: one map, and shuffles of graphs only
    for made in (perturb.perturbation_changes(*tables), perturb.perturbation_sweep(*tables)):
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") <= 4 and "Window" not in plan
