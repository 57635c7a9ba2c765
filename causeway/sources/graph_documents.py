"""Graph documents: one JSON file for each case in a tree ``condition/run/batch/case/file.json``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.keys import batch_key, number_at_end
from causeway.sources.schema import EDGE, GROUPS, NODE


def read_documents(spark: SparkSession, root: str, name: str = "*.json", runs: list[str] | None = None) -> DataFrame:
    """Raw documents below ``root``: path, condition_name, run_label, run_no, batch_id, case_id, file_name, modified, body.

    The keys come from the last directories of the path; ``runs`` keeps only these run labels, before any file is read.
    A tree without files gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    part = F.split("path", "/")
    at = lambda k: F.try_element_at(part, F.lit(-k))
    keyed = files.select(
        "path",
        at(5).alias("condition_name"),
        at(4).alias("run_label"),
        number_at_end(at(4)).alias("run_no"),
        batch_key(at(3)).alias("batch_id"),
        at(2).alias("case_id"),
        at(1).alias("file_name"),
        F.col("modificationTime").alias("modified"),
        F.col("content").cast("string").alias("body"),
    )
    return keyed if runs is None else keyed.where(F.col("run_label").isin(runs))


def pick_document(docs: DataFrame, preferred: list[str]) -> DataFrame:
    """One document for each condition, run, batch and case: the first preferred file name, else the first by name."""
    rank = F.coalesce(*(F.when(F.col("file_name") == name, F.lit(k)) for k, name in enumerate(preferred)), F.lit(len(preferred)))
    keys = ["condition_name", "run_label", "batch_id", "case_id"]
    rest = [c for c in docs.columns if c not in keys]
    best = docs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, "file_name")).alias("d"))
    return best.select(*keys, "d.*")


def _items(body: str, group: str, kind: str, single: str) -> Column:
    """The items of a group: a list as it is; an object as a list of one, if ``single`` allows."""
    at = F.get_json_object(body, f"$.{group}")
    many = F.from_json(at, f"array<{kind}>", {"mode": "PERMISSIVE"})
    one = F.when(at.startswith("{"), F.array(F.from_json(at, kind)))
    return F.when(at.startswith("["), many).otherwise(one) if single else F.when(at.startswith("["), many)


def document_nodes(docs: DataFrame, id_cols: list[str], objects: str = "none") -> DataFrame:
    """Nodes of graph documents in written order: ids, group, pos and the node's fields, blank where absent.

    ``objects`` tells where a bare object counts as a list of one: in ``none`` of the groups, for the ``hazard`` only, or
    ``any``. Bodies that are no JSON, and groups of other shapes, give no nodes.
    """
    parts = []
    for k, group in enumerate(GROUPS):
        single = objects == "any" or objects == "hazard" and group == "hazard_consequence_node"
        parts.append(docs.select(*id_cols, F.lit(group).alias("group"), F.lit(k).alias("group_no"), F.posexplode(_items("body", group, NODE, single)).alias("pos", "n")))
    rows = reduce(DataFrame.unionByName, parts).where("n is not null")
    clean = lambda c: F.coalesce(F.trim(f"n.{c}"), F.lit(""))
    named = F.coalesce(F.nullif(clean("name"), F.lit("")), F.nullif(clean("text"), F.lit("")), clean("node_id"))
    fields = [clean(c).alias(c) for c in ("label", "node_id", "node_type", "evidence", "explanation", "source")]
    return rows.select(*id_cols, "group", "group_no", "pos", named.alias("name"), *fields)


def document_edges(docs: DataFrame, id_cols: list[str]) -> DataFrame:
    """Edges of graph documents in written order: ids, pos, source, target, relation (or label). Blank ends are dropped."""
    rows = docs.select(*id_cols, F.posexplode(_items("body", "edges", EDGE, "")).alias("pos", "e")).where("e is not null")
    clean = lambda c: F.coalesce(F.trim(f"e.{c}"), F.lit(""))
    relation = F.coalesce(F.nullif(clean("relation"), F.lit("")), clean("label"))
    return rows.select(*id_cols, "pos", clean("source").alias("source"), clean("target").alias("target"), relation.alias("relation")).where("source <> '' and target <> ''")


def graph_document(nodes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """The JSON document of each graph: id and body, nodes by group and id, edges by source and target.

    A graph's nodes are put in one row, so this is for graphs, not for whole tables.
    """
    groups = {"hazardconsequence": GROUPS[0], "entity": GROUPS[1], "condition": GROUPS[2], "event": GROUPS[3]}
    node = F.struct("node_id", "label", "name", "node_type")
    listed = nodes.groupBy(id_col).agg(*(F.array_sort(F.collect_list(F.when(F.col("node_type") == t, node))).alias(g) for t, g in groups.items()))
    arcs = edges.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("source", "target", "relation"))).alias("edges"))
    both = listed.join(arcs, id_col, "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<source:string,target:string,relation:string>>)")))
    return both.select(id_col, F.to_json(F.struct(*groups.values(), "edges")).alias("body"))
