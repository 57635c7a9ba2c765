"""Seeded perturbations of graphs as negative controls.

A run is a graph under one control, severity and replicate. The elements of a run are ranked by the md5 of the run and the
element, and the rank decides what happens to each: the first ones are deleted or reversed, and neighbours in rank order
swap their targets. So a run needs no state, can be repeated alone, and any engine with md5 gives the same.

A graph is held in one row and goes to a task, which makes and scores all its runs; nothing of a run is shuffled. Runs of
one graph are scored together, as arrays.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.assign import edit_distances, spread

RUN = ["graph_id", "control", "severity", "replicate"]
CONTROLS = ["node_deletion", "edge_deletion", "edge_direction_reversal", "edge_endpoint_rewiring", "combined"]
SEVERITIES = (0.25, 0.50, 0.75)
REPLICATES = 100
#: Squared elements that are work for one row: greater graphs are several rows, each with a part of the runs.
PART_WORK = 20_000
_RUN_SCHEMA = "graph_id long, control string, severity double, replicate int"
_SIZES = ["nodes_before", "edges_before", "nodes_deleted", "edges_after", "same", "edges_reversed", "edges_rewired"]
_SCORES = ["wl_similarity", "edit_distance", "edit_similarity"]

Arc = tuple[str, str]


def target_count(total: int, severity: float) -> int:
    """How many of ``total`` the severity means: at least one, none only of nothing."""
    return min(total, max(1, round(total * severity))) if total > 0 and severity > 0 else 0


def _ranked(items: list, seed: str, step: str) -> list:
    """Node ids or arcs in the order of their hashes in a step of a run."""
    start = f"{seed}|{step}|"
    if items and isinstance(items[0], str):
        return sorted(items, key=lambda x: (md5((start + x).encode()).digest(), x))
    return sorted(items, key=lambda x: (md5(f"{start}{x[0]}|{x[1]}".encode()).digest(), x))


def rewired(arcs: dict[Arc, str], seed: str, severity: float) -> tuple[set[Arc], dict[Arc, str]]:
    """The arcs that swap their targets with a neighbour in rank order, and what they become.

    A swap that would make a self-loop, an arc that is there, or one that an earlier swap makes is left out; degrees stay.
    """
    order = _ranked(list(arcs), seed, "swap")
    wanted, made, old, new = -(-target_count(len(arcs), severity) // 2), set(), set(), {}
    for (s, t), (other_s, other_t) in zip(order[::2], order[1::2], strict=False):
        if s == other_t or other_s == t:
            continue
        swapped = (s, other_t), (other_s, t)
        bad = any(x in arcs or x in made for x in swapped)
        made.update(swapped)
        if not bad and len(old) < 2 * wanted:
            old |= {(s, t), (other_s, other_t)}
            new |= {swapped[0]: arcs[s, t], swapped[1]: arcs[other_s, other_t]}
    return old, new


def perturb_run(open_nodes: list[str], arcs: dict[Arc, str], turnable: set[Arc], control: str, severity: float, seed: str) -> tuple[set[str], dict[Arc, str], set[Arc], set[Arc]]:
    """One run of a graph: the nodes that go, the arcs that are left, and which of these are turned and swapped.

    ``open_nodes`` may be deleted (all but hazards); ``turnable`` arcs are no self-loops and their reverse isn't there.
    """
    gone: set[str] = set()
    turned: set[Arc] = set()
    swapped: set[Arc] = set()
    if control in ("node_deletion", "combined"):
        gone = set(_ranked(open_nodes, seed, "node")[: target_count(len(open_nodes), severity)])
        arcs = {x: r for x, r in arcs.items() if x[0] not in gone and x[1] not in gone}
    if control == "edge_deletion":
        lost = set(_ranked(list(arcs), seed, "edge")[: target_count(len(arcs), severity)])
        arcs = {x: r for x, r in arcs.items() if x not in lost}
    if control in ("edge_direction_reversal", "combined"):
        hit = set(_ranked([x for x in arcs if x in turnable], seed, "turn")[: target_count(len(arcs), severity)])
        turned = {(t, s) for s, t in hit}
        arcs = {x[::-1] if x in hit else x: r for x, r in arcs.items()}
    if control in ("edge_endpoint_rewiring", "combined"):
        # an arc that is turned and then swapped counts as swapped
        old, new = rewired(arcs, seed, severity)
        arcs, turned, swapped = {x: r for x, r in arcs.items() if x not in old} | new, turned - old, set(new)
    return gone, arcs, turned, swapped


class _Graph:
    """A graph of a row, with what all its runs need."""

    def __init__(self, row: dict, seed: int):
        self.graph_id, self.seed = row["graph_id"], seed
        self.nodes = sorted(row["nodes"], key=lambda x: x["node_id"])
        self.arcs = {(e["source"], e["target"]): e["relation"] for e in row["edges"] or []}
        self.open = [x["node_id"] for x in self.nodes if x["node_id"] != "H1" and x["node_type"] is not None and x["node_type"] != "hazardconsequence"]
        self.turnable = {(s, t) for s, t in self.arcs if s != t and (t, s) not in self.arcs}

    def runs(self, replicates: int, part: int, parts: int) -> Iterator[tuple]:
        """Control, severity and replicate of each run of a part, and the run."""
        no = 0
        for control in CONTROLS:
            for severity in SEVERITIES:
                for replicate in range(1, replicates + 1):
                    if no % parts == part:
                        run_seed = f"{self.seed}|{self.graph_id}|{control}|{severity}|{replicate}"
                        yield control, severity, replicate, perturb_run(self.open, self.arcs, self.turnable, control, severity, run_seed)
                    no += 1


def _graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each graph with a node, or several with a part of its runs each: graph_id, nodes, edges, part, parts."""
    label = F.col("label") if "label" in nodes.columns else F.lit(None).cast("string").alias("label")
    own = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "node_type", label)).alias("nodes"))
    own = own.join(edges.groupBy("graph_id").agg(F.collect_list(F.struct("source", "target", "relation")).alias("edges")), "graph_id", "left")
    size = (F.size("nodes") + F.coalesce(F.size("edges"), F.lit(0))).cast("long")
    parts = F.least(F.lit(len(CONTROLS) * len(SEVERITIES)), 1 + F.floor(size * size / PART_WORK)).cast("int")
    rows = own.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread(rows, "graph_id", "part")


def perturbed(nodes: DataFrame, edges: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, the nodes they delete, and their edges with ``turned`` and ``swapped``. Graphs without a node have no runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g, out = _Graph(row, seed), []
                for control, severity, replicate, (gone, arcs, turned, swapped) in g.runs(replicates, row["part"], row["parts"]):
                    left = [{"source": x[0], "target": x[1], "relation": r, "turned": x in turned, "swapped": x in swapped} for x, r in arcs.items()]
                    out.append({"graph_id": g.graph_id, "control": control, "severity": severity, "replicate": replicate, "gone": list(gone), "left": left})
                yield pa.RecordBatch.from_pylist(out, schema)

    edge = pa.struct([("source", pa.string()), ("target", pa.string()), ("relation", pa.string()), ("turned", pa.bool_()), ("swapped", pa.bool_())])
    schema = pa.schema([*_run_fields(), ("gone", pa.list_(pa.string())), ("left", pa.list_(edge))])
    made = _graph_rows(nodes, edges).mapInArrow(run, f"{_RUN_SCHEMA}, gone array<string>, left array<struct<source:string,target:string,relation:string,turned:boolean,swapped:boolean>>")
    return made.select(*RUN), made.select(*RUN, F.explode("gone").alias("node_id")), made.select(*RUN, F.explode("left").alias("x")).select(*RUN, "x.*")


def _run_fields() -> list[tuple[str, pa.DataType]]:
    return [("graph_id", pa.int64()), ("control", pa.string()), ("severity", pa.float64()), ("replicate", pa.int32())]


def _counted(nodes: DataFrame, edges: DataFrame, replicates: int, seed: int, scores: bool) -> DataFrame:
    """Each run with its sizes, with ``scores`` its scores too and a row ``positive_control`` for each graph."""
    fields = [*_run_fields(), *((c, pa.int32()) for c in _SIZES), *((c, pa.float64()) for c in _SCORES if scores)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g, rows, shapes = _Graph(row, seed), [], []
                if scores and row["part"] == 0:
                    rows.append((g.graph_id, "positive_control", 0.0, 0, *[None] * len(_SIZES)))
                    shapes.append((set(), g.arcs))
                for control, severity, replicate, (gone, arcs, turned, swapped) in g.runs(replicates, row["part"], row["parts"]):
                    same = sum(x in g.arcs for x in arcs)
                    rows.append((g.graph_id, control, severity, replicate, len(g.nodes), len(g.arcs), len(gone), len(arcs), same, len(turned), len(swapped)))
                    if scores:
                        shapes.append((gone, arcs))
                columns = list(zip(*rows, strict=True)) if rows else [()] * (len(RUN) + len(_SIZES))
                if scores:
                    columns += score_runs(g.nodes, g.arcs, shapes)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    schema = ", ".join([_RUN_SCHEMA, *(f"{c} int" for c in _SIZES), *(f"{c} double" for c in _SCORES if scores)])
    return _graph_rows(nodes, edges).mapInArrow(run, schema)


def _changes() -> list:
    before, after = (F.col("nodes_before"), F.col("edges_before")), F.col("edges_after")
    return [
        *before, (before[0] - F.col("nodes_deleted")).alias("nodes_after"), after, "nodes_deleted", (before[1] - after).alias("edges_deleted"), "edges_reversed", "edges_rewired",
        F.round(F.when(before[1] > 0, F.col("same") / before[1]).when(before[1] == 0, 1.0), 6).alias("edges_kept"), F.round(1 - F.col("nodes_deleted") / before[0], 6).alias("nodes_kept"),
    ]


def perturbation_changes(nodes: DataFrame, edges: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Each run with its sizes before and after, its changes, and the shares of edges and nodes that are still there."""
    return _counted(nodes, edges, replicates, seed, False).select(*RUN, *_changes())


def refinement(labels: dict[str, str], arcs: dict[Arc, str], rounds: int = 2) -> Counter:
    """Histogram of the refinement by successors, as ``compare.refined_labels`` has it, of one graph."""
    now = dict(labels)
    counted = Counter((0, x) for x in now.values())
    for k in range(1, rounds + 1):
        after: dict[str, list[str]] = {n: [] for n in now}
        for s, t in arcs:
            after[s].append(now[t])
        now = {n: f"{now[n]}({','.join(sorted(after[n]))})" for n in now}
        counted.update((k, x) for x in now.values())
    return counted


def histogram_similarity(a: Counter, b: Counter) -> float:
    """The normalised kernel of two histograms: 1 for two empty graphs, 0 if only one is empty."""
    if not a or not b:
        return float(not a and not b)
    return sum(n * b[x] for x, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def _refined(codes: np.ndarray, texts: list[str], source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """One round of the refinement of nodes in many graphs: the codes of their labels, and the label of each code."""
    after = codes[target]
    order = np.lexsort((after, source))
    source, after = source[order], after[order]
    degree = np.bincount(source, minlength=len(codes))
    nth = np.arange(len(source)) - (np.cumsum(degree) - degree)[source]
    rows = np.full((len(codes), 1 + int(degree.max(initial=0))), -1, np.int64)
    rows[:, 0] = codes
    rows[source, 1 + nth] = after
    # equal rows are found by a hash and compared
    odd = np.random.default_rng(1).integers(1 << 62, size=rows.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _, first, of = np.unique((rows.astype(np.uint64) * odd).sum(axis=1), return_index=True, return_inverse=True)
    if not (rows == rows[first][of]).all():
        _, first, of = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    known: dict[str, int] = {}
    made = []
    for own, *next_ in rows[first].tolist():
        text = f"{texts[own]}({','.join(sorted(texts[x] for x in next_ if x >= 0))})"
        made.append(known.setdefault(text, len(known)))
    return np.array(made, np.int64)[of.reshape(-1)], list(known)


def refinement_similarities(labels: list[str], alive: np.ndarray, run: np.ndarray, source: np.ndarray, target: np.ndarray, rounds: int = 2) -> np.ndarray:
    """``histogram_similarity`` of each run's ``refinement`` with that of the last run.

    ``alive`` tells the nodes of each run, ``run``, ``source`` and ``target`` the arcs of all.
    """
    runs, n = alive.shape
    known: dict[str, int] = {}
    codes = np.tile(np.array([known.setdefault(x, len(known)) for x in labels], np.int64), runs)
    texts, flat = list(known), alive.reshape(-1)
    cross, own = np.zeros(runs, np.int64), np.zeros(runs, np.int64)
    at = np.repeat(np.arange(runs), n)[flat]
    for k in range(rounds + 1):
        if k:
            codes, texts = _refined(codes, texts, run * n + source, run * n + target)
        there = codes[flat]
        ref = np.bincount(there[at == runs - 1], minlength=len(texts))
        cross += np.bincount(at, ref[there], runs).astype(np.int64)
        cell, many = np.unique(at * len(texts) + there, return_counts=True)
        own += np.bincount(cell // len(texts), many * many, runs).astype(np.int64)
    return np.where(own > 0, cross / np.sqrt(np.maximum(own, 1) * max(own[-1], 1)), float(own[-1] == 0))


def score_runs(nodes: list[dict], arcs: dict[Arc, str], shapes: list[tuple[set[str], dict[Arc, str]]]) -> list[list[float]]:
    """Label-refinement similarity, edit distance and edit similarity of runs (nodes gone, arcs left) against their graph."""
    at = {x["node_id"]: k for k, x in enumerate(nodes)}
    relation = {r: k for k, r in enumerate(sorted(set(arcs.values())))}
    alive = np.ones((len(shapes) + 1, len(nodes)), bool)
    for k, (gone, _) in enumerate(shapes):
        alive[k, [at[x] for x in gone]] = False
    # the graph itself comes last
    rows = [(k, at[s], at[t], relation[r]) for k, (_, left) in enumerate([*shapes, (set(), arcs)]) for (s, t), r in left.items()]
    run, source, target, of = np.array(rows, np.int64).reshape(-1, 4).T
    alike = refinement_similarities([x["label"] for x in nodes], alive, run, source, target)[:-1]
    kinds = {t: k for k, t in enumerate({x["node_type"] for x in nodes})}
    types = np.array([kinds[x["node_type"]] for x in nodes], np.int64)
    distance = edit_distances(types, alive[:-1], run, source, target, of, len(relation))
    elements = [max(1, 2 * len(nodes) - len(gone) + len(arcs) + len(left)) for gone, left in shapes]
    part = [d / n for d, n in zip(distance.tolist(), elements, strict=True)]
    return [[round(x, 6) for x in alike.tolist()], distance.astype(float).tolist(), [round(max(0.0, 1 - x), 6) for x in part]]


def perturbation_sweep(nodes: DataFrame, edges: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Every run with its changes and its scores against the graph it comes from.

    The scores are label-refinement similarity and the edit distance and similarity. A row ``positive_control`` (severity 0,
    replicate 0) scores each graph as it is and has no changes. ``nodes`` has graph_id, node_id, node_type, label.
    """
    return _counted(nodes, edges, replicates, seed, True).select(*RUN, *_SCORES, *_changes())
