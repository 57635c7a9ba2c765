"""Queries of the general problems: nested records (1) and orphan references (2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import nested, references
from causeway.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_records(table(spark, sf_dir, "step_output"))


def _records(spark: SparkSession, sf_dir: str, path: str, fields: list[str]) -> DataFrame:
    nodes = nested.shred(table(spark, sf_dir, "step_output"), "output_id", "payload", [f"{path}.{f}" for f in fields])
    dotted = lambda c: F.array_join(F.col(c), ".")
    return nested.record_table(nodes, "output_id", path, fields).withColumns({"dewey": dotted("dewey"), "parent_dewey": dotted("parent_dewey")})


def p1_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, nested.INCIDENT, ["incident_id", "time_reference", "is_independent_incident"])


def p1_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, nested.SECTION, ["section_title", "text"])


def p1_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, nested.ALTERNATIVE, ["label", "reason"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.graph_orphans(*(table(spark, sf_dir, t) for t in ("graph_edge", "review_edge", "graph_node")))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, month, field and reason."""
    return (
        p2_found(spark, sf_dir)
        .groupBy("ref_table", "load_month", "field_name", "reason")
        .agg(F.count("*").alias("orphans"), F.countDistinct("ref_row_id").alias("ref_rows"))
    )


_P2 = """
with refs as (
  select distinct 'graph_edge' as ref_table, edge_row_id as ref_row_id, graph_id, loaded_at, f.field_name, f.raw
  from graph_edge, lateral (values ('source', source), ('target', target)) f(field_name, raw)
  union
  select distinct 'review_edge', review_row_id, graph_id, loaded_at, f.field_name, f.raw
  from review_edge, lateral (values ('source', source), ('target', target)) f(field_name, raw)
), keyed as (
  select ref_table, ref_row_id, graph_id, loaded_at, field_name,
         trim(raw, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(160)) as node_id
  from refs where raw is not null
), judged as (
  select k.ref_table, k.ref_row_id, k.field_name, k.loaded_at,
         count(n.node_id) as versions,
         count(case when n.loaded_at <= k.loaded_at then 1 end) as loaded,
         count(case when n.loaded_at <= k.loaded_at and (n.deleted_at is null or n.deleted_at > k.loaded_at) then 1 end) as live
  from keyed k left join graph_node n on n.graph_id = k.graph_id and n.node_id = k.node_id
  where k.node_id <> ''
  group by all
), found as (
  select ref_table, ref_row_id, field_name,
         case when versions = 0 then 'missing' when loaded > 0 then 'deleted' else 'late' end as reason,
         strftime(loaded_at, '%Y-%m') as load_month
  from judged where live = 0
)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_incidents": p1_incidents,
    "p1_sections": p1_sections,
    "p1_alternatives": p1_alternatives,
    "p2_found": p2_found,
    "p2_report": p2_report,
}
SQL = {
    "p2_found": _P2 + "select * from found",
    "p2_report": _P2
    + """select ref_table, load_month, field_name, reason, count(*) as orphans, count(distinct ref_row_id) as ref_rows
from found group by all""",
}
