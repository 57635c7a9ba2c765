"""Review plans applied to graphs: changes of edges, and whole plans with changes of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.closure import shortcuts_by_row
from causeway.operators.graphs import next_node_ids

# Words of a suggestion that leave the value as it is, and the forms in which suggestions name a new one.
KEEP = ["retained", "keep", "unchanged", "no change", "same"]
PHRASES = {
    "label": r"""(?i)\brelabel\b.*?\bas\s+"?([^".;\n]+)"?""",
    "name": r"""(?i)\brename\b.*?\b(?:to|as)\b\s+"?([^".;\n]+)"?""",
    "node_type": r"""(?i)\b(?:retype|change\s+the\s+type|change\s+type)\b.*?\bas\s+"?([^".;\n]+)"?""",
}
# The field that each kind of update changes, and the beginnings of the ids of each type of node.
UPDATES = {"rename": "name", "relabel": "label", "retype": "node_type", "update_evidence": "evidence", "update_explanation": "explanation", "clarify_role": "explanation"}
PREFIXES = {"hazardconsequence": "H", "entity": "En", "condition": "C", "event": "Ev"}


def review_changes(review_edge: DataFrame) -> DataFrame:
    """Edge changes with clean ends: graph_id, pos, kind, source, target, relation. Copies once, blank ends dropped."""
    rows = review_edge.select(
        "graph_id",
        F.col("review_row_id").alias("pos"),
        F.lower(F.trim("change_kind")).alias("kind"),
        F.trim("source").alias("source"),
        F.trim("target").alias("target"),
        F.lower(F.trim(F.coalesce("relation", F.lit("")))).alias("relation"),
    )
    return rows.where("source <> '' and target <> '' and graph_id is not null").distinct()


def apply_edge_changes(edges: DataFrame, changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Accept all changes, in the order additions, updates, deletions: graph_id, source, target, relation, distinct.

    An addition needs a relation and both nodes, and no equal edge. An update gives the edges between its ends its
    relation, the last update winning; a deletion drops edges that have its relation after the updates, so an edge
    that is renamed and deleted under its old relation stays.
    """
    ids = nodes.select("graph_id", "node_id")
    added = changes.where("kind = 'edge_addition' and relation <> ''").select("graph_id", "source", "target", "relation")
    added = added.join(ids.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi")
    added = added.join(ids.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_semi")
    now = edges.select("graph_id", "source", "target", "relation").unionByName(added.select("graph_id", "source", "target", "relation")).distinct()
    updates = changes.where("kind = 'edge_update' and relation <> ''").groupBy("graph_id", "source", "target").agg(F.max_by("relation", "pos").alias("suggested"))
    now = now.join(updates, ["graph_id", "source", "target"], "left").withColumn("relation", F.coalesce("suggested", "relation")).drop("suggested")
    gone = changes.where("kind = 'edge_deletion' and relation <> ''").select("graph_id", "source", "target", "relation").distinct()
    return now.join(gone, ["graph_id", "source", "target", "relation"], "left_anti").select("graph_id", "source", "target", "relation").distinct()


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, deleted and changed edges between two states: graph_id, source, target, status, old, new."""
    a = before.groupBy("graph_id", "source", "target").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("old"))
    b = after.groupBy("graph_id", "source", "target").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("new"))
    both = a.join(b, ["graph_id", "source", "target"], "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("status", status).where("status is not null").select("graph_id", "source", "target", "status", "old", "new")


def suggested_value(suggested: Column, field: str) -> Column:
    """The new value of a field that a suggestion means, or null where it leaves the value as it is.

    A suggestion is an object with the field (``type`` stands for ``node_type``), a text with ``field: value`` in a line or
    between semicolons, a phrase such as ``rename ... to "x"``, or the value itself.
    """
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = some(suggested)
    names = [field, "type"] if field == "node_type" else [field]
    of_object = F.coalesce(*(some(F.get_json_object(text, f"$.{n}")) for n in names))
    of_line = F.coalesce(*(some(F.regexp_extract(text, rf"(?im)(?:^|[;\n])\s*{n}\s*[:=]\s*(.+?)\s*(?:[;\n]|$)", 1)) for n in names))
    of_phrase = some(F.regexp_extract(text, PHRASES[field], 1)) if field in PHRASES else F.lit(None).cast("string")
    value = F.when(text.startswith("{"), of_object).otherwise(F.coalesce(of_line, of_phrase, text))
    return F.when(~F.lower(value).isin(KEEP), value)


def apply_review_plan(nodes: DataFrame, edges: DataFrame, node_changes: DataFrame, links: DataFrame, changes: DataFrame, shortcuts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accept a whole plan: updates of nodes, additions with their links, edge changes, deletions. The nodes and edges after it.

    ``node_changes`` has graph_id, pos, kind (node_update, node_addition, node_deletion), change_type, target_id, suggested,
    label, name, node_type, evidence, explanation; ``links`` graph_id, pos (of the addition), way (in or out), other (a node id), relation;
    ``changes`` is the result of ``review_changes``. Of several updates of a field the last that names a value wins. An
    addition without label, name or type is left out, new ids count on from the greatest of their prefix, and a link needs its other node.
    A deleted node takes its edges along, new ones too. With ``shortcuts`` edges with another way are dropped in the end.
    Changes of nodes that aren't there do nothing; null ids match nothing.
    """
    fields = ["label", "name", "node_type", "evidence", "explanation"]
    kinds = F.create_map(*(F.lit(x) for pair in UPDATES.items() for x in pair))
    asked = node_changes.where("kind = 'node_update'").withColumn("field", F.try_element_at(kinds, F.lower(F.trim("change_type"))))
    last = [F.max_by(suggested_value(F.col("suggested"), f), F.when((F.col("field") == f) & suggested_value(F.col("suggested"), f).isNotNull(), F.col("pos"))).alias(f"new_{f}") for f in fields]
    updates = asked.groupBy("graph_id", F.trim("target_id").alias("node_id")).agg(*last)
    now = nodes.join(updates, ["graph_id", "node_id"], "left").select("graph_id", "node_id", *(F.coalesce(f"new_{f}", f).alias(f) for f in fields))

    given = [F.nullif(F.trim(c), F.lit("")).alias(c) for c in fields]
    added = node_changes.where("kind = 'node_addition'").select("graph_id", "pos", *given).where("label is not null and name is not null and node_type is not null")
    types = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))
    added = next_node_ids(nodes, added.withColumn("prefix", F.coalesce(F.try_element_at(types, F.lower("node_type")), F.lit("Ev"))))
    now = now.unionByName(added.select("graph_id", F.col("new_node_id").alias("node_id"), *fields))

    ids = now.select("graph_id", "node_id")
    linked = links.join(added.select("graph_id", "pos", "new_node_id"), ["graph_id", "pos"]).join(ids.withColumnRenamed("node_id", "other"), ["graph_id", "other"], "left_semi")
    into = F.col("way") == "in"
    relation = F.coalesce(F.nullif(F.lower(F.trim("relation")), F.lit("")), F.lit("enables"))
    linked = linked.select("graph_id", F.when(into, F.col("other")).otherwise(F.col("new_node_id")).alias("source"), F.when(into, F.col("new_node_id")).otherwise(F.col("other")).alias("target"), relation.alias("relation"))
    after = apply_edge_changes(edges.select("graph_id", "source", "target", "relation").unionByName(linked), changes, now)

    gone = node_changes.where("kind = 'node_deletion'").select("graph_id", F.trim("target_id").alias("node_id")).distinct()
    for end in ("source", "target"):
        after = after.join(gone.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    after = after.select("graph_id", "source", "target", "relation")
    if shortcuts:
        rows = after.withColumn("pos", F.xxhash64("source", "target", "relation"))
        after = rows.join(shortcuts_by_row(rows).select("graph_id", "pos"), ["graph_id", "pos"], "left_anti").select("graph_id", "source", "target", "relation")
    return now.join(gone, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id", *fields), after
