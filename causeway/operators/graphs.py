"""Typed directed graphs as node and edge tables, keyed by graph_id.

The loaded tables hold copies, withdrawn rows, padding and dangling ends; these operators give the simple typed digraph
that everything else works on. A graph is small (tens of nodes), there are many of them, and all work is keyed by
graph_id or finer, so it spreads by graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.keys import batch_key, node_type

# Allowed (relation, source type, target type).
ONTOLOGY = [
    ("has", "entity", "entity"),
    ("has", "entity", "condition"),
    ("enables", "event", "event"),
    ("enables", "event", "hazardconsequence"),
    ("enables", "entity", "event"),
    ("enables", "condition", "event"),
    ("enables", "condition", "hazardconsequence"),
]
#: The condition and run whose graph stands for a report's reference graph.
REFERENCE = ("full_pipeline", 1)


def live_nodes(graph_node: DataFrame, texts: bool = True) -> DataFrame:
    """Nodes that aren't withdrawn, one row for each (graph_id, node_id): the row loaded last wins.

    Gives graph_id, node_id, label, name, node_type (canonical), with ``texts`` evidence, explanation, source. Rows without a graph or
    node id are dropped; null labels and types become the unknown ones, a null name the node id.
    """
    rows = graph_node.where("deleted_at is null and graph_id is not null and node_id is not null")
    kept = ["evidence", "explanation", "source"] if texts else []
    fields = ["label", "name", "node_type", *kept]
    last = rows.groupBy("graph_id", "node_id").agg(F.max_by(F.struct(*fields), F.struct("loaded_at", "node_row_id")).alias("n"))
    return last.select(
        "graph_id",
        "node_id",
        F.coalesce(F.nullif(F.trim("n.label"), F.lit("")), F.lit("UNKNOWN_LABEL")).alias("label"),
        F.coalesce(F.nullif(F.trim("n.name"), F.lit("")), F.col("node_id")).alias("name"),
        node_type(F.col("n.node_type"), F.col("node_id")).alias("node_type"),
        *(F.col(f"n.{c}").alias(c) for c in kept),
    )


def written_edges(graph_edge: DataFrame) -> DataFrame:
    """Edges as written, copies once, ends trimmed, blank ends dropped: graph_id, pos (the row id), source, target, relation."""
    ends = graph_edge.where("graph_id is not null").select(
        "graph_id",
        F.col("edge_row_id").alias("pos"),
        F.trim("source").alias("source"),
        F.trim("target").alias("target"),
        F.lower(F.trim(F.coalesce("relation", F.lit("")))).alias("relation"),
    )
    return ends.where("source <> '' and target <> ''").distinct()


def simple_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The simple digraph's edges: both ends are nodes, parallel edges collapse to the last one's relation."""
    one = edges.groupBy("graph_id", "source", "target").agg(F.max_by("relation", "pos").alias("relation"))
    ids = nodes.select("graph_id", "node_id")
    return one.join(ids.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi").join(
        ids.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_semi"
    ).select("graph_id", "source", "target", "relation")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Written edges with an end that is no node, with which end it is."""
    ids = nodes.select("graph_id", F.col("node_id").alias("id"), F.lit(True).alias("there"))
    src = ids.select("graph_id", F.col("id").alias("source"), F.col("there").alias("has_source"))
    dst = ids.select("graph_id", F.col("id").alias("target"), F.col("there").alias("has_target"))
    both = edges.join(src, ["graph_id", "source"], "left").join(dst, ["graph_id", "target"], "left")
    gone = F.when(F.col("has_source").isNull() & F.col("has_target").isNull(), "both").when(F.col("has_source").isNull(), "source").otherwise("target")
    return both.where("has_source is null or has_target is null").select("graph_id", "pos", "source", "target", gone.alias("missing_end"))


def graph_keys(graph_node: DataFrame) -> DataFrame:
    """The key of each graph: graph_id, report_id, batch_id (normal form), case_id, condition_name, run_no."""
    rows = graph_node.where("graph_id is not null").withColumn("batch_id", batch_key("batch_id"))
    return rows.groupBy("graph_id").agg(*(F.min(c).alias(c) for c in ("report_id", "batch_id", "case_id", "condition_name", "run_no")))


def reference_pairs(keys: DataFrame) -> DataFrame:
    """Each graph with its report's reference graph: graph_id, ref_id, and the key."""
    condition, run = REFERENCE
    refs = keys.where((F.col("condition_name") == condition) & (F.col("run_no") == run))
    refs = refs.groupBy("report_id").agg(F.min("graph_id").alias("ref_id"))
    return keys.join(refs, "report_id").where("graph_id <> ref_id")


def linked_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge touches."""
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return nodes.join(ends, ["graph_id", "node_id"], "left_semi")


def degree_factors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, edge/node ratio, density, greatest in- and out-degree of each graph."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    ins = edges.groupBy("graph_id", "target").count().groupBy("graph_id").agg(F.max("count").alias("max_in"), F.sum("count").alias("edges"))
    outs = edges.groupBy("graph_id", "source").count().groupBy("graph_id").agg(F.max("count").alias("max_out"))
    both = n.join(ins, "graph_id", "left").join(outs, "graph_id", "left").na.fill(0, ["edges", "max_in", "max_out"])
    slots = F.col("nodes") * (F.col("nodes") - 1)
    return both.select(
        "graph_id",
        "nodes",
        "edges",
        "max_in",
        "max_out",
        F.round(F.col("edges") / F.col("nodes"), 6).alias("edge_node_ratio"),
        F.round(F.when(slots > 0, F.col("edges") / slots).otherwise(0.0), 6).alias("density"),
        (F.col("nodes") + F.col("edges")).alias("construction_steps"),
    )


def ontology_violations(nodes: DataFrame, edges: DataFrame, strict: bool = False, ways_in: bool = False) -> DataFrame:
    """Violations of the graph schema: graph_id, rule, item. ``edges`` are the written ones.

    Rules: hazard_count (not exactly one), bad_node_id, unknown_endpoint, bad_relation, bad_endpoint_types, self_loop,
    duplicate_edge, isolated_node; strict adds hazard_links (in at least 1, out 0) and no_way_out (a node that is no
    hazard without an edge out); ways_in adds no_way_in (a condition without an edge in). One violation-finding query each, united.
    """
    spark = nodes.sparkSession
    typed = nodes.select("graph_id", "node_id", "node_type")
    hazards = typed.groupBy("graph_id").agg(F.count_if(F.col("node_type") == "hazardconsequence").alias("n")).where("n <> 1")
    bad_id = typed.where(~F.col("node_id").rlike("^(H1|En[1-9][0-9]*|C[1-9][0-9]*|Ev[1-9][0-9]*)$"))
    gone = dangling_edges(edges, nodes)
    arc = F.concat_ws("|", "source", "target", "relation")
    src = typed.select("graph_id", F.col("node_id").alias("source"), F.col("node_type").alias("source_type"))
    dst = typed.select("graph_id", F.col("node_id").alias("target"), F.col("node_type").alias("target_type"))
    joined = edges.join(src, ["graph_id", "source"]).join(dst, ["graph_id", "target"])
    allowed = spark.createDataFrame(ONTOLOGY, "relation string, source_type string, target_type string")
    bad_types = joined.where(F.col("relation").isin("has", "enables")).join(F.broadcast(allowed), ["relation", "source_type", "target_type"], "left_anti")
    copies = edges.groupBy("graph_id", "source", "target", "relation").count().where("count > 1")
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    found = [
        hazards.select("graph_id", F.lit("hazard_count").alias("rule"), F.col("n").cast("string").alias("item")),
        bad_id.select("graph_id", F.lit("bad_node_id"), "node_id"),
        gone.select("graph_id", F.lit("unknown_endpoint"), F.concat_ws("|", "source", "target", "missing_end")),
        edges.where(~F.col("relation").isin("has", "enables")).select("graph_id", F.lit("bad_relation"), arc),
        bad_types.select("graph_id", F.lit("bad_endpoint_types"), arc),
        edges.where("source = target").select("graph_id", F.lit("self_loop"), arc),
        copies.select("graph_id", F.lit("duplicate_edge"), arc),
        typed.join(ends, ["graph_id", "node_id"], "left_anti").select("graph_id", F.lit("isolated_node"), "node_id"),
    ]
    if strict:
        outs = edges.select("graph_id", F.col("source").alias("node_id")).distinct()
        ins = edges.select("graph_id", F.col("target").alias("node_id")).distinct()
        hazard = typed.where("node_type = 'hazardconsequence'")
        found += [
            hazard.join(ins, ["graph_id", "node_id"], "left_anti").select("graph_id", F.lit("hazard_links"), "node_id"),
            hazard.join(outs, ["graph_id", "node_id"], "left_semi").select("graph_id", F.lit("hazard_links"), "node_id"),
            typed.where("node_type <> 'hazardconsequence'").join(outs, ["graph_id", "node_id"], "left_anti").select("graph_id", F.lit("no_way_out"), "node_id"),
        ]
    if ways_in:
        ins = edges.select("graph_id", F.col("target").alias("node_id")).distinct()
        found.append(typed.where("node_type = 'condition'").join(ins, ["graph_id", "node_id"], "left_anti").select("graph_id", F.lit("no_way_in"), "node_id"))
    return reduce(DataFrame.union, found)


def next_node_ids(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """New ids for ``wanted`` nodes (graph_id, prefix, pos): the greatest number of the prefix plus 1, 2, ... in order of pos."""
    used = nodes.select("graph_id", F.regexp_extract("node_id", r"^([A-Za-z]+)(\d+)$", 1).alias("prefix"), F.regexp_extract("node_id", r"(\d+)$", 1).try_cast("int").alias("no"))
    top = used.groupBy("graph_id", "prefix").agg(F.max("no").alias("top"))
    order = F.row_number().over(Window.partitionBy("graph_id", "prefix").orderBy("pos"))
    return wanted.withColumn("nth", order).join(top, ["graph_id", "prefix"], "left").select(
        *wanted.columns, F.concat("prefix", (F.coalesce("top", F.lit(0)) + F.col("nth")).cast("string")).alias("new_node_id")
    )
