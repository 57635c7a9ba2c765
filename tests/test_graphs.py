import itertools
import random

import numpy as np

from causeway.operators import assign, closure, compare, graphs, patch

N = "graph_id long, node_id string, label string, name string, node_type string"
E = "graph_id long, source string, target string, relation string"
def random_graph(rng, n=6, arcs=8):
    """A graph whose nodes all differ in type, so the best assignment is no matter of taste."""
    nodes = [f"n{k}" for k in range(n)]
    pairs = [(a, b) for a in nodes for b in nodes if a != b]
    return {x: x for x in nodes}, {e: rng.choice(["has", "enables", "holds"]) for e in rng.sample(pairs, arcs)}


def test_one_change_costs_what_it_should():
    rng = random.Random(12)
    for _ in range(40):
        types, arcs = random_graph(rng)
        edge = rng.choice(sorted(arcs))
        back = edge[::-1]
        same = assign.edit_counts(types, arcs, types, arcs)
        assert set(same) == set(assign.COUNTS) and not any(same.values())
        assert assign.edit_counts(types, arcs, types | {"more": "more"}, arcs) == same | {"node_insertions": 1}
        assert assign.edit_counts(types | {"more": "more"}, arcs, types, arcs) == same | {"node_deletions": 1}
        assert assign.edit_counts(types, arcs, types, {e: r for e, r in arcs.items() if e != edge}) == same | {"edge_deletions": 1}
        assert assign.edit_counts(types, arcs, types, arcs | {edge: "other"}) == same | {"edge_substitutions": 1}
        if back not in arcs:
            turned = {(back if e == edge else e): r for e, r in arcs.items()}
            assert assign.edit_counts(types, arcs, types, turned) == same | {"edge_insertions": 1, "edge_deletions": 1}


def test_edit_counts_against_exact_distance():
    """The induced path costs at least the exact distance, and as much either way round on plain edges."""
    rng = random.Random(13)
    for _ in range(30):
        (types, arcs), (ref_types, ref_arcs) = random_graph(rng, 4, 4), random_graph(rng, 3, 3)
        kinds = ["event", "entity", "condition"]
        types, ref_types = ({x: rng.choice(kinds) for x in t} for t in (types, ref_types))
        arcs, ref_arcs = (dict.fromkeys(x, "has") for x in (arcs, ref_arcs))
        there = sum(assign.edit_counts(types, arcs, ref_types, ref_arcs).values())
        assert assign.exact_edit_distance(types, set(arcs), ref_types, set(ref_arcs)) <= there <= len(types) + len(ref_types) + len(arcs) + len(ref_arcs)
    assert assign.edit_counts({}, {}, {}, {}) == dict.fromkeys(assign.COUNTS, 0)


def test_costs_of_nodes_by_brute_force():
    """The vectorised costs: relations in and out of two nodes, counted one by one."""
    rng = random.Random(14)
    types, arcs = random_graph(rng, 5, 7)
    names, relations = sorted(types), sorted(set(arcs.values()))
    found = assign._around(names, arcs, relations)
    for way, end in ((0, 1), (1, 0)):
        for i, node in enumerate(names):
            assert found[way, i].tolist() == [sum(r == q and e[end] == node for e, r in arcs.items()) for q in relations]


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        m = int(rng.integers(n, 7))
        cost = rng.integers(0, 9, (n, m)).astype(float)
        to = assign.assign(cost)
        assert len(set(to)) == n
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert cost[np.arange(n), to].sum() == best


def test_matching_maximises_one_plus_similarity():
    rng = random.Random(2)
    for _ in range(100):
        weights = {(a, b): round(rng.uniform(0.4, 1), 2) for a in "abc" for b in "xyz" if rng.random() < 0.6}
        found = sum(1 + s for *_, s in assign.best_matching(weights)) if weights else 0
        best = 0.0
        for k in range(4):
            for left in itertools.permutations("abc", k):
                for right in itertools.combinations("xyz", k):
                    if all(p in weights for p in zip(left, right)):
                        best = max(best, sum(1 + weights[p] for p in zip(left, right)))
        assert abs(found - best) < 1e-9


def test_greedy_edge_matching():
    mapped = {"a": "x", "b": "y"}
    ref = [("x", "y", "has"), ("x", "y", "enables")]
    assert assign.match_edges(mapped, [("a", "b", "enables"), ("a", "b", "enables")], ref, 1.0) == 1
    assert assign.match_edges(mapped, [("a", "b", ""), ("a", "c", "has")], [("x", "y", "")], 0.0) == 1
    assert assign.relation_ratio("has", "") == 0.0 and assign.relation_ratio("", "") == 1.0


def reach_from(arcs, start, banned=None):
    seen, queue = set(), [start]
    while queue:
        for s, t in arcs:
            if s == queue[0] and t not in seen and t != banned:
                seen.add(t)
                queue.append(t)
        queue.pop(0)
    return seen


def test_closure_and_shortcuts_on_random_digraphs(spark):
    rng = random.Random(5)
    rows = {}
    for g in range(60):
        names = [f"n{k}" for k in range(rng.randint(1, 6))]
        rows[g] = [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(1, 10))]
    edges = spark.createDataFrame([(g, s, t, "r", k) for g, arcs in rows.items() for k, (s, t) in enumerate(arcs)], E + ", pos int")
    reach = {tuple(r) for r in closure.reachable(edges).collect()}
    assert reach == {(g, s, t) for g, arcs in rows.items() for s in {a for a, _ in arcs} for t in reach_from(arcs, s)}

    def way_round(arcs, u, d):
        if u == d:
            return False
        seen, queue = {u}, [u]
        while queue:
            x = queue.pop(0)
            for y in {t for s, t in arcs if s == x}:
                if (x, y) == (u, d) or y in seen:
                    continue
                if y == d:
                    return True
                seen.add(y)
                queue.append(y)
        return False

    text = {tuple(r) for r in closure.shortcuts_between_names(edges).collect()}
    assert text == {(g, u, d) for g, arcs in rows.items() for u, d in arcs if way_round(set(arcs), u, d)}

    def other_way(arcs, k):
        u, d = arcs[k]
        rest = [a for i, a in enumerate(arcs) if i != k]
        stack, seen = [t for s, t in rest if s == u], {u}
        while stack:
            x = stack.pop()
            if x == d:
                return True
            if x not in seen:
                seen.add(x)
                stack += [t for s, t in rest if s == x]
        return False

    by_row = {(r.graph_id, r.pos) for r in closure.shortcuts_by_row(edges).collect()}
    assert by_row == {(g, k) for g, arcs in rows.items() for k in range(len(arcs)) if other_way(arcs, k)}


def test_build_audit_and_scores(spark):
    nodes = spark.createDataFrame(
        [(1, "H1", "HazardConsequence", "VCE", "hazardconsequence"), (1, "Ev1", "L", "leak", "event"), (1, "C1", "P", "high", "condition"), (2, "H1", "HazardConsequence", "VCE", "hazardconsequence")], N
    )
    edges = spark.createDataFrame([(1, "C1", "Ev1", "enables", 1), (1, "Ev1", "H1", "enables", 2), (1, "Ev999", "H1", "enables", 3), (1, "C1", "Ev1", "has", 4)], E + ", pos int")
    simple = graphs.simple_edges(edges, nodes)
    assert sorted((r.source, r.target, r.relation) for r in simple.collect()) == [("C1", "Ev1", "has"), ("Ev1", "H1", "enables")]
    rules = {(r.graph_id, r.rule) for r in graphs.ontology_violations(nodes, edges, strict=True).collect()}
    assert {(1, "unknown_endpoint"), (1, "bad_endpoint_types"), (2, "isolated_node"), (2, "hazard_links")} <= rules and (1, "hazard_count") not in rules
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 4)], "graph_id long, ref_id long")
    same = pairs.where("graph_id = ref_id")
    assert [r.similarity for r in compare.refinement_similarity(same, compare.refined_labels(nodes, simple)).collect()] == [1.0]
    both = compare.refinement_similarity(pairs.where("graph_id = 3"), compare.refined_labels(nodes, simple)).collect()
    assert both[0].similarity == 1.0
    edit = {r.graph_id: r for r in assign.bipartite_edit(pairs.where("graph_id <> ref_id"), nodes, simple).collect()}
    assert edit[3].distance == 0 and edit[1].distance == edit[2].distance == 4


def test_patch_order(spark):
    nodes = spark.createDataFrame([(1, "En1"), (1, "Ev1"), (1, "Ev2")], "graph_id long, node_id string")
    edges = spark.createDataFrame([(1, "En1", "Ev1", "has"), (1, "Ev1", "Ev2", "enables")], E)
    changes = spark.createDataFrame(
        [(1, 1, "edge_addition", "En1", "Ev2", "enables"), (1, 2, "edge_addition", "En1", "Zz", "enables"), (1, 3, "edge_update", "En1", "Ev1", "enables"), (1, 4, "edge_deletion", "En1", "Ev1", "has"), (1, 5, "edge_deletion", "Ev1", "Ev2", "enables")],
        "graph_id long, pos long, kind string, source string, target string, relation string",
    )
    after = patch.apply_edge_changes(edges, changes, nodes)
    assert sorted(tuple(r)[1:] for r in after.collect()) == [("En1", "Ev1", "enables"), ("En1", "Ev2", "enables")]
    status = {(r.source, r.target): r.status for r in patch.edge_diff(edges, after).collect()}
    assert status == {("En1", "Ev1"): "changed", ("En1", "Ev2"): "added", ("Ev1", "Ev2"): "deleted"}


def test_condition_needs_a_way_in(spark):
    nodes = spark.createDataFrame([(1, "C1", "condition"), (1, "C2", "condition"), (1, "En1", "entity"), (1, "H1", "hazardconsequence")], "graph_id long, node_id string, node_type string")
    edges = spark.createDataFrame([(1, 1, "C1", "H1", "enables"), (1, 2, "C2", "H1", "enables"), (1, 3, "En1", "C2", "has")], "graph_id long, pos long, source string, target string, relation string")
    found = graphs.ontology_violations(nodes, edges, strict=True, ways_in=True).collect()
    assert [(r.rule, r.item) for r in found] == [("no_way_in", "C1")]


def test_whole_review_plan(spark):
    nodes = spark.createDataFrame([(1, k, "L", k.lower(), t, None, "why") for k, t in [("En1", "entity"), ("Ev1", "event"), ("Ev7", "event"), ("H1", "hazardconsequence")]], N + ", evidence string, explanation string")
    edges = spark.createDataFrame([(1, "En1", "Ev1", "enables"), (1, "Ev1", "Ev7", "enables"), (1, "Ev7", "H1", "enables")], E)
    C = "graph_id long, pos long, kind string, change_type string, target_id string, suggested string, label string, name string, node_type string, evidence string, explanation string"
    rows = [
        (1, 1, "node_update", "Rename", "Ev1", 'rename it to "gasket burst".', *[None] * 5),
        (1, 2, "node_update", "rename", "Ev1", "unchanged", *[None] * 5),
        (1, 3, "node_update", "relabel", "En1", '{"label": "Vessel"}', *[None] * 5),
        (1, 4, "node_update", "update_evidence", "En1", "evidence: page 3; name: x", *[None] * 5),
        (1, 5, "node_addition", None, None, None, "Ignition", "spark", "event", "p. 4", None),
        (1, 6, "node_addition", None, None, None, "", "no label", "event", None, None),
        (1, 7, "node_deletion", None, "Ev7", None, *[None] * 5),
        (1, 8, "node_update", "rename", "Zz9", "nothing", *[None] * 5),
    ]
    links = spark.createDataFrame([(1, 5, "in", "Ev1", None), (1, 5, "out", "H1", "enables"), (1, 5, "out", "Zz", "enables")], "graph_id long, pos long, way string, other string, relation string")
    changes = spark.createDataFrame([(1, 9, "edge_addition", "En1", "H1", "enables")], "graph_id long, pos long, kind string, source string, target string, relation string")
    now, after = patch.apply_review_plan(nodes, edges, spark.createDataFrame(rows, C), links, changes, shortcuts=False)
    got = {r.node_id: r for r in now.collect()}
    assert set(got) == {"En1", "Ev1", "Ev8", "H1"}
    assert got["Ev1"].name == "gasket burst" and got["En1"].label == "Vessel" and got["En1"].evidence == "page 3" and got["Ev8"].name == "spark" and got["En1"].explanation == "why"
    whole = {("En1", "Ev1"), ("Ev1", "Ev8"), ("Ev8", "H1"), ("En1", "H1")}
    assert {(r.source, r.target) for r in after.collect()} == whole
    _, short = patch.apply_review_plan(nodes, edges, spark.createDataFrame(rows, C), links, changes)
    assert {(r.source, r.target) for r in short.collect()} == whole - {("En1", "H1")}
    empty = spark.createDataFrame([], C)
    assert patch.apply_review_plan(nodes, edges, empty, links.limit(0), changes.limit(0), shortcuts=False)[1].count() == 3


def test_suggested_values(spark):
    rows = [("name: a b; label: c", "a b"), ("rename X as Y.", "Y"), ('{"name": " z "}', "z"), ('{"label": "z"}', None), ("Keep", None), ("", None), (None, None), ("plain words", "plain words")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    assert [r.v for r in df.select("k", patch.suggested_value(df.t, "name").alias("v")).orderBy("k").collect()] == [v for _, v in rows]
