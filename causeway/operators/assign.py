"""Optimal assignments on many small graphs: edit distance and typed node matching.

The pairs and their costs come from joins; only the assignment itself runs in Python, one small matrix at a time, with
many graphs in each Arrow batch of a grouped map.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ["node_insertions", "node_deletions", "node_substitutions", "edge_insertions", "edge_deletions", "edge_substitutions"]


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least cost (shortest augmenting paths); rows <= columns."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        least = np.full(m + 1, np.inf)
        used = np.zeros(m + 1, bool)
        j = 0
        while True:
            used[j] = True
            row = owner[j]
            free = ~used[1:]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            open_costs = np.where(free, least[1:], np.inf)
            k = int(open_costs.argmin()) + 1
            delta = open_costs[k - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j = k
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    out = np.empty(n, int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _around(nodes: list[str], arcs: dict[tuple[str, str], str], relations: list[str]) -> np.ndarray:
    """How often each relation goes in and out of each node: (2, nodes, relations)."""
    at, of = {x: i for i, x in enumerate(nodes)}, {r: k for k, r in enumerate(relations)}
    counts = np.zeros((2, len(nodes), len(relations)), np.int64)
    if arcs:
        ends = np.array([(at[t], at[s], of[r]) for (s, t), r in arcs.items()])
        np.add.at(counts, (0, ends[:, 0], ends[:, 2]), 1)
        np.add.at(counts, (1, ends[:, 1], ends[:, 2]), 1)
    return counts


def edit_counts(types: dict[str, str], arcs: dict[tuple[str, str], str], ref_types: dict[str, str], ref_arcs: dict[tuple[str, str], str]) -> dict[str, int]:
    """Edit operations of the path that the optimal node assignment induces."""
    counts = dict.fromkeys(COUNTS, 0)
    mine, theirs = sorted(types), sorted(ref_types)
    n, m = len(mine), len(theirs)
    if n + m == 0:
        return counts

    relations = sorted({*arcs.values(), *ref_arcs.values()})
    own, ref = _around(mine, arcs, relations), _around(theirs, ref_arcs, relations)
    degree, ref_degree = own.sum(axis=2), ref.sum(axis=2)
    # of two multisets of relations the greater size less their common part, in and out
    shared = np.minimum(own[:, :, None, :], ref[:, None, :, :]).sum(axis=3)
    local = (np.maximum(degree[:, :, None], ref_degree[:, None, :]) - shared).sum(axis=0)
    other = np.array([types[a] for a in mine], object)[:, None] != np.array([ref_types[b] for b in theirs], object)[None, :]
    never = 1000.0 * (n + m + len(arcs) + len(ref_arcs) + 1)
    cost = np.zeros((n + m, n + m))
    cost[:n, :m] = other + 0.5 * local
    cost[:n, m:] = never
    cost[n:, :m] = never
    cost[np.arange(n), m + np.arange(n)] = 1 + 0.5 * degree.sum(axis=0)
    cost[n + np.arange(m), np.arange(m)] = 1 + 0.5 * ref_degree.sum(axis=0)
    to = assign(cost)
    partner: dict[str, str] = {}
    for i, a in enumerate(mine):
        if to[i] < m:
            partner[a] = theirs[to[i]]
            counts["node_substitutions"] += types[a] != ref_types[partner[a]]
        else:
            counts["node_deletions"] += 1
    counts["node_insertions"] = int((to[n:] < m).sum())
    taken = set()
    for (s, t), r in arcs.items():
        arc = (partner.get(s), partner.get(t))
        if None not in arc and arc in ref_arcs:
            taken.add(arc)
            counts["edge_substitutions"] += r != ref_arcs[arc]
        else:
            counts["edge_deletions"] += 1
    counts["edge_insertions"] = len(ref_arcs) - len(taken)
    return {k: int(v) for k, v in counts.items()}


def assign_many(cost: np.ndarray, plain: int) -> np.ndarray:
    """``assign`` of many matrices (matrix, row, column) in step, with the same choice among equals if all sums are exact.

    From row ``plain`` on, rows are alike: they cost 0 or at least 1. A search that only goes through columns that
    such rows have without a price ends at the first free column of equal cost, so it isn't made.
    """
    many, n, m = cost.shape
    u, v = np.zeros((many, n), cost.dtype), np.zeros((many, m), cost.dtype)
    owner = np.full((many, m), -1)
    every = np.arange(many)
    for i in range(n):
        least = cost[:, i] - v
        k = least.argmin(axis=1)
        far = least[every, k]
        open_ = owner[every, k] < 0
        if i >= plain and not open_.all():
            a = every[~open_]
            tied, has = least[a] == far[a, None], owner[a]
            stiff = tied & (has >= 0) & ((has < plain) | (u[a[:, None], has] != 0))
            tied &= has < 0
            first = tied.argmax(axis=1)
            end = np.where(stiff.any(axis=1), stiff.argmax(axis=1), m)
            ok = tied[np.arange(len(a)), first] & (first < end)
            k[a[ok]] = first[ok]
            open_[a[ok]] = True
        owner[every[open_], k[open_]] = i
        u[open_, i] = far[open_]
        a = every[~open_]
        least, k, far, prices = least[a], k[a], far[a], v[a]
        way, reached = np.full((len(a), m), -1), np.full((len(a), m), np.inf, cost.dtype)
        while a.size:
            here = np.arange(len(a))
            reached[here, k], least[here, k], prices[here, k] = far, np.inf, -np.inf
            row = owner[a, k]
            reduced = cost[a, row]
            reduced -= prices
            reduced += (far - u[a, row])[:, None]
            better = reduced < least
            np.copyto(least, reduced, where=better)
            np.copyto(way, k[:, None], where=better)
            k = least.argmin(axis=1)
            far = least[here, k]
            done = owner[a, k] < 0
            if not done.any():
                continue
            ended, end, column = a[done], far[done], k[done]
            x, j = np.nonzero(np.isfinite(reached[done]))
            gain = end[x] - reached[done][x, j]
            u[ended[x], owner[ended[x], j]] += gain
            v[ended[x], j] -= gain
            u[ended, i] = end
            before = way[done]
            left = np.arange(len(ended))
            while left.size:
                from_ = before[left, column[left]]
                root = from_ < 0
                owner[ended[left], column[left]] = np.where(root, i, owner[ended[left], from_])
                column[left] = from_
                left = left[~root]
            more = ~done
            a, k, far, least, prices, way, reached = a[more], k[more], far[more], least[more], prices[more], way[more], reached[more]
    out = np.empty((many, n), int)
    x, j = np.nonzero(owner >= 0)
    out[x, owner[x, j]] = j
    return out


#: Cells of cost matrices that are filled at once.
CELLS = 2_000_000


def edit_distances(types: np.ndarray, alive: np.ndarray, run: np.ndarray, source: np.ndarray, target: np.ndarray, relation: np.ndarray, relations: int) -> np.ndarray:
    """The summed ``edit_counts`` of each run of a graph against the graph: its nodes in order with their types, those
    ``alive`` in each run (run, node), and the arcs of all, the graph's own as those of a run after the last."""
    runs, m = alive.shape
    own = run < runs
    ref_arcs = np.full((m, m), -1)
    ref_arcs[source[~own], target[~own]] = relation[~own]
    ref = np.stack([np.bincount(x[~own] * relations + relation[~own], minlength=m * relations).reshape(m, relations) for x in (target, source)])
    ref_degree, ref_size = ref.sum(axis=2), int((~own).sum())
    order = np.argsort(run[own], kind="stable")
    run, source, target, relation = run[own][order], source[own][order], target[own][order], relation[own][order]
    starts = np.searchsorted(run, np.arange(runs + 1))
    sizes, left = np.diff(starts), alive.sum(axis=1)
    out = np.zeros(runs, np.int64)
    for n in np.unique(left).tolist():
        rest = np.flatnonzero(left == n)
        step = max(1, CELLS // (n + m) ** 2)
        for of in (rest[k : k + step] for k in range(0, len(rest), step)):
            arc = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in of])
            at = np.repeat(np.arange(len(of)), sizes[of])
            s, t, r = source[arc], target[arc], relation[arc]
            nodes = np.nonzero(alive[of])[1].reshape(len(of), n)
            local = np.zeros((len(of), n, m), np.int64)
            degrees = np.zeros((len(of), n), np.int64)
            for way, end in enumerate((t, s)):
                around = np.bincount((at * m + end) * relations + r, minlength=len(of) * m * relations).reshape(len(of), m, relations)
                around = np.take_along_axis(around, nodes[:, :, None], axis=1)
                degree = around.sum(axis=2)
                local += np.maximum(degree[:, :, None], ref_degree[way])
                for k in range(relations):
                    local -= np.minimum(around[:, :, None, k], ref[way, :, k])
                degrees += degree
            other = types[nodes][:, :, None] != types
            never = 1000.0 * (n + m + sizes[of] + ref_size + 1)
            exact = 4 * (n + m) * never.max(initial=0) < 1 << 23
            cost = np.zeros((len(of), n + m, n + m), np.float32 if exact else np.float64)
            cost[:, :n, :m] = other + 0.5 * local
            cost[:, :n, m:] = never[:, None, None]
            cost[:, n:, :m] = never[:, None, None]
            cost[:, np.arange(n), m + np.arange(n)] = 1 + 0.5 * degrees
            cost[:, n + np.arange(m), np.arange(m)] = 1 + 0.5 * ref_degree.sum(axis=0)
            to = assign_many(cost, n)
            kept = to[:, :n] < m
            changed = np.take_along_axis(other, np.minimum(to[:, :n], m - 1)[:, :, None], axis=2)[:, :, 0] & kept
            partner = np.full((len(of), m), -1)
            np.put_along_axis(partner, nodes, np.where(kept, to[:, :n], -1), axis=1)
            a, b = partner[at, s], partner[at, t]
            found = np.where((a >= 0) & (b >= 0), ref_arcs[a, b], -1)
            hits = np.bincount(at, found >= 0, len(of)).astype(np.int64)
            relabelled = np.bincount(at, (found >= 0) & (found != r), len(of)).astype(np.int64)
            out[of] = changed.sum(axis=1) + (~kept).sum(axis=1) + (to[:, n:] < m).sum(axis=1) + relabelled + sizes[of] + ref_size - 2 * hits
    return out


def _as_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each graph: graph_id, nodes (id, type), edges (source, target, relation)."""
    n = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "node_type")).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.collect_list(F.struct("source", "target", "relation")).alias("edges"))
    return n.join(e, "graph_id", "left")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows over as many tasks as the session shuffles to: few bytes can be much work, so they aren't put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bipartite_edit(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edit distance of each pair by the optimal node assignment: the six counts, distance, normalised, similarity.

    A graph is held in one row, so this is for graphs of up to some thousands of elements; the pairs may be many. Ties of
    the assignment are broken by node id. Two empty graphs have distance 0.
    """
    graphs = _as_rows(nodes, edges)
    ref = graphs.select(F.col("graph_id").alias("ref_id"), F.col("nodes").alias("ref_nodes"), F.col("edges").alias("ref_edges"))
    both = pairs.select("graph_id", "ref_id").join(graphs, "graph_id", "left").join(ref, "ref_id", "left")
    schema = "graph_id long, " + ", ".join(f"{c} int" for c in COUNTS) + ", elements int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda x: [] if x is None else list(x)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                types, ref_types = ({x["node_id"]: x["node_type"] for x in read(g)} for g in (r.nodes, r.ref_nodes))
                arcs, ref_arcs = ({(x["source"], x["target"]): x["relation"] for x in read(g)} for g in (r.edges, r.ref_edges))
                counts = edit_counts(types, arcs, ref_types, ref_arcs)
                rows.append((r.graph_id, *counts.values(), sum(map(len, (types, arcs, ref_types, ref_arcs)))))
            yield pd.DataFrame(rows, columns=["graph_id", *COUNTS, "elements"])

    counted = spread(both, "graph_id").mapInPandas(run, schema)
    distance = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    part = F.when(F.col("elements") > 0, distance / F.col("elements")).otherwise(F.lit(0.0))
    return counted.select(
        "graph_id", *COUNTS, distance.cast("double").alias("distance"), F.round(part, 6).alias("normalized"), F.round(F.greatest(F.lit(0.0), 1 - part), 6).alias("similarity")
    )


def best_matching(weights: dict[tuple[str, str], float]) -> list[tuple[str, str, float]]:
    """The matching that maximises the sum of 1 + similarity over admissible pairs."""
    mine, theirs = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    cost = np.full((len(mine), len(theirs) + len(mine)), 2.0)
    for (a, b), s in weights.items():
        cost[mine.index(a), theirs.index(b)] = 1 - s
    cost[:, : len(theirs)][cost[:, : len(theirs)] == 2.0] = 1e6
    to = assign(cost)
    return [(a, theirs[j], weights[a, theirs[j]]) for a, j in zip(mine, to, strict=True) if j < len(theirs) and (a, theirs[j]) in weights]


def typed_assignment(candidates: DataFrame, keep_type: bool = False) -> DataFrame:
    """The optimal one-to-one matching within each graph and type: graph_id, node_id, ref_node_id, similarity; node_type with ``keep_type``.

    ``candidates`` is the result of ``typed_candidates``; nodes without a candidate stay unmatched. Pairs of different
    types are never admissible, so each (graph, type) is a problem of its own.
    """
    rows = candidates.groupBy("graph_id", "node_type").agg(F.collect_list(F.struct("node_id", "ref_node_id", "similarity")).alias("pairs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                found = best_matching({(p["node_id"], p["ref_node_id"]): p["similarity"] for p in r.pairs})
                out += [(r.graph_id, r.node_type, *m) for m in found]
            yield pd.DataFrame(out, columns=["graph_id", "node_type", "node_id", "ref_node_id", "similarity"])

    matched = rows.mapInPandas(run, "graph_id long, node_type string, node_id string, ref_node_id string, similarity double")
    return matched if keep_type else matched.drop("node_type")


def relation_ratio(a: str, b: str) -> float:
    """1 for equal relations, 0 if one is blank, else the share of matching blocks."""
    return 1.0 if a == b else 0.0 if not a or not b else SequenceMatcher(None, a, b, False).ratio()


def match_edges(mapped: dict[str, str], edges: list[tuple], ref_edges: list[tuple], threshold: float) -> int:
    """Edges matched greedily in order through the node mapping; each reference edge once, the best relation first."""
    taken: set[int] = set()
    for source, target, relation in edges:
        best, at = 0.0, None
        for k, (s, t, r) in enumerate(ref_edges):
            if k not in taken and s == mapped.get(source) and t == mapped.get(target):
                score = relation_ratio(relation, r)
                if score > best:
                    best, at = score, k
        if at is not None and best >= threshold:
            taken.add(at)
    return len(taken)


def soft_edge_matches(pairs: DataFrame, matches: DataFrame, edges: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Edges of each pair that match through the node mapping: graph_id, edges, ref_edges, matched, precision, recall, f1.

    ``edges`` are written edges with pos. Both empty count as 1, an empty side alone as in the shares: no edges of its
    own is precision 1, no reference edges recall 1.
    """
    listed = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "target", "relation"))).alias("edges"))
    mapping = matches.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "ref_node_id"))).alias("mapped"))
    both = (
        pairs.select("graph_id", "ref_id")
        .join(listed, "graph_id", "left")
        .join(listed.select(F.col("graph_id").alias("ref_id"), F.col("edges").alias("ref_edges")), "ref_id", "left")
        .join(mapping, "graph_id", "left")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda x: [] if x is None else [(e["source"], e["target"], e["relation"]) for e in x]
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                mine, theirs = read(r.edges), read(r.ref_edges)
                rows.append((r.graph_id, len(mine), len(theirs), match_edges(dict(r.mapped or {}), mine, theirs, threshold)))
            yield pd.DataFrame(rows, columns=["graph_id", "edges", "ref_edges", "matched"])

    found = both.mapInPandas(run, "graph_id long, edges int, ref_edges int, matched int")
    p = F.when(F.col("edges") > 0, F.col("matched") / F.col("edges")).otherwise(F.lit(1.0))
    r = F.when(F.col("ref_edges") > 0, F.col("matched") / F.col("ref_edges")).otherwise(F.lit(1.0))
    value = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return found.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(value, 6).alias("f1"))


def exact_edit_distance(types: dict[str, str], arcs: set[tuple[str, str]], ref_types: dict[str, str], ref_arcs: set[tuple[str, str]]) -> int:
    """The exact edit distance of two tiny graphs (labels on nodes, plain edges), by branch and bound over the nodes."""
    mine, theirs = sorted(types), sorted(ref_types)
    best = [len(mine) + len(theirs) + len(arcs) + len(ref_arcs)]

    def go(i: int, to: dict[str, str | None], cost: int) -> None:
        if cost >= best[0]:
            return
        if i == len(mine):
            used = {b for b in to.values() if b is not None}
            extra = len(theirs) - len(used) + sum(s not in used or t not in used for s, t in ref_arcs)
            best[0] = min(best[0], cost + extra)
            return
        a = mine[i]
        for b in [*(x for x in theirs if x not in to.values()), None]:
            step = 1 if b is None else int(types[a] != ref_types[b])
            for other, image in [*to.items(), (a, b)]:
                for s, t in {(a, other), (other, a)}:
                    si, ti = (b if s == a else image), (b if t == a else image)
                    step += ((s, t) in arcs) != (si is not None and ti is not None and (si, ti) in ref_arcs)
            go(i + 1, to | {a: b}, cost + step)

    go(0, {}, 0)
    return best[0]
