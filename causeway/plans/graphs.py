"""Queries on typed graphs, and the SQL that checks them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import vectors
from causeway.functions.text import BLANKS
from causeway.operators import assign, closure, compare, graphs, patch, perturb, postprocess
from causeway.session import BROADCAST_BYTES, BROADCAST_ROWS, ROW_BYTES, durable
from causeway.sources.tables import table


class Graphs(NamedTuple):
    """Tables of one folder: keys, nodes, written edges, simple edges, and the pairs with a reference graph."""

    keys: DataFrame
    nodes: DataFrame
    written: DataFrame
    edges: DataFrame
    pairs: DataFrame


def load(spark: SparkSession, sf_dir: str, texts: bool = False) -> Graphs:
    """The tables; nodes with their long ``texts`` only where asked for, as all columns are shuffled."""
    raw = table(spark, sf_dir, "graph_node")
    nodes = graphs.live_nodes(raw, texts)
    written = graphs.written_edges(table(spark, sf_dir, "graph_edge"))
    keys = graphs.graph_keys(raw)
    return Graphs(keys, nodes, written, graphs.simple_edges(written, nodes), graphs.reference_pairs(keys))


def cut(g: Graphs) -> Graphs:
    """The same with the nodes and edges written once, for plans that use them several times."""
    nodes = durable(g.nodes)
    written = durable(g.written)
    return g._replace(nodes=nodes, written=written, edges=durable(graphs.simple_edges(written, nodes)))


def _hazards(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'hazardconsequence'").select("graph_id", F.col("name").alias("hazard"))


class Vectors(NamedTuple):
    """The embeddings by the rank of their ids, gaps or not (nth, vector, unit, norm): how many, the longest, and whether they may be broadcast."""

    table: DataFrame
    ids: int
    longest: int
    small: bool

    def pick(self, text_col: str) -> Column:
        """The rank of the vector of a text; the table has no text column, so the hash of the text stands for the lookup."""
        return (F.conv(F.left(F.md5(text_col), F.lit(8)), 16, 10).cast("long") % F.lit(max(self.ids, 1))).alias("nth")

    def of(self, *columns: str) -> DataFrame:
        chosen = self.table.select("nth", *columns)
        return F.broadcast(chosen) if self.small else chosen


def load_vectors(spark: SparkSession, sf_dir: str) -> Vectors:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.max("vector").alias("vector"))
    parts = Window.partitionBy("part").orderBy("vec_id")
    ranged = rows.withColumn("part", F.floor(F.col("vec_id") / 10_000)).withColumn("in_part", F.row_number().over(parts))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = ranged.join(before, "part").where("vector is not null").select((F.col("before") + F.col("in_part") - 1).alias("nth"), "vector", vectors.unit("vector").alias("unit"), vectors.norm("vector").alias("norm"))
    nth = durable(nth)
    size = nth.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("longest"), F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("cells")).first()
    # a null vector is no member of anything but counts as an id
    return Vectors(nth, rows.count(), size.longest, size.n <= BROADCAST_ROWS and 16 * size.cells + ROW_BYTES * size.n <= BROADCAST_BYTES)


def graph_nodes(spark, sf_dir):
    return load(spark, sf_dir).nodes.select("graph_id", "node_id", "label", "name", "node_type")


def graph_edges(spark, sf_dir):
    return load(spark, sf_dir).edges


def graph_dangling_edges(spark, sf_dir):
    g = load(spark, sf_dir)
    return graphs.dangling_edges(g.written, g.nodes)


def graph_parallel_edges(spark, sf_dir):
    """Written edges between the same nodes: how many, how many relations, and the last one."""
    many = load(spark, sf_dir).written.groupBy("graph_id", "source", "target")
    return many.agg(F.count("*").alias("copies"), F.countDistinct("relation").alias("relations"), F.max_by("relation", "pos").alias("last")).where("copies > 1")


def graph_degree_factors(spark, sf_dir):
    g = load(spark, sf_dir)
    return graphs.degree_factors(g.nodes, g.edges)


def graph_ontology_violations(spark, sf_dir):
    g = load(spark, sf_dir)
    return graphs.ontology_violations(g.nodes, g.written, strict=True).groupBy("graph_id", "rule").agg(F.count("*").alias("items"), F.min("item").alias("first_item"))


def graph_strict_audit(spark, sf_dir):
    """The whole strict audit: the rules of graph_ontology_violations and that every condition has an edge in."""
    g = load(spark, sf_dir)
    found = graphs.ontology_violations(g.nodes, g.written, strict=True, ways_in=True)
    return found.groupBy("graph_id", "rule").agg(F.count("*").alias("items"), F.min("item").alias("first_item"))


def graph_validity(spark, sf_dir):
    """Per condition and run: graphs, valid ones, and those with a directed cycle."""
    g = cut(load(spark, sf_dir))
    errors = graphs.ontology_violations(g.nodes, g.written).where("rule <> 'isolated_node'").select("graph_id", F.lit(1).alias("bad")).distinct()
    cyclic = closure.cycle_nodes(closure.reachable(g.edges)).select("graph_id", F.lit(1).alias("cyclic")).distinct()
    joined = g.keys.join(errors, "graph_id", "left").join(cyclic, "graph_id", "left")
    return joined.groupBy("condition_name", "run_no").agg(
        F.count("*").alias("graphs"), F.count_if(F.col("bad").isNull()).alias("valid"), F.count_if(F.col("cyclic") == 1).alias("with_cycle")
    )


def graph_signature_prf(spark, sf_dir):
    """Precision, recall and F1 of node and edge signatures against the reference graph, and the mean of both F1."""
    g = cut(load(spark, sf_dir))
    nodes = compare.signature_scores(g.pairs, durable(compare.node_signatures(g.nodes)), "node")
    edges = compare.signature_scores(g.pairs, durable(compare.edge_signatures(g.edges, g.nodes)), "edge")
    keyed = g.pairs.select("graph_id", "report_id", "condition_name", "run_no")
    return keyed.join(nodes, "graph_id").join(edges, "graph_id").withColumn("overall", F.round((F.col("node_f1") + F.col("edge_f1")) / 2, 6))


def graph_signature_extra(spark, sf_dir):
    g = load(spark, sf_dir)
    return compare.signature_difference(g.pairs, compare.edge_signatures(g.edges, g.nodes), True)


def graph_signature_missing(spark, sf_dir):
    g = load(spark, sf_dir)
    return compare.signature_difference(g.pairs, compare.edge_signatures(g.edges, g.nodes), False)


def graph_reachability(spark, sf_dir):
    """Pairs of nodes with a way, and nodes on a cycle, of each graph."""
    reach = closure.reachable(load(spark, sf_dir).edges)
    return reach.groupBy("graph_id").agg(F.count("*").alias("reachable_pairs"), F.count_if(F.col("source") == F.col("target")).alias("cycle_nodes"))


def graph_shortcuts_text(spark, sf_dir):
    return closure.shortcuts_between_names(load(spark, sf_dir).edges)


def graph_shortcuts_pipeline(spark, sf_dir):
    return closure.shortcuts_by_row(load(spark, sf_dir).written).select("graph_id", "pos", "source", "target", "relation")


def graph_longest_path(spark, sf_dir):
    g = cut(load(spark, sf_dir))
    return closure.longest_path(g.nodes, g.edges, durable(closure.reachable(g.edges)))


def graph_wl_similarity(spark, sf_dir, g=None):
    g = g or load(spark, sf_dir)
    return compare.refinement_similarity(g.pairs, durable(compare.refined_labels(g.nodes, g.edges)))


def graph_local_edge_cost(spark, sf_dir):
    g = load(spark, sf_dir)
    return compare.local_edge_cost(g.pairs, g.nodes, g.edges)


def graph_bipartite_ged(spark, sf_dir, g=None):
    g = g or load(spark, sf_dir)
    return assign.bipartite_edit(g.pairs, g.nodes, g.edges)


def graph_assemble_linked(spark, sf_dir):
    g = load(spark, sf_dir)
    kept = graphs.linked_nodes(g.nodes, g.edges)
    return kept.groupBy("graph_id", "node_type").agg(F.count("*").alias("linked_nodes"))


def _text(spark, sf_dir):
    g = load(spark, sf_dir)
    return durable(postprocess.tagged_text_edges(g.written, g.nodes)), durable(_hazards(g.nodes))


def text_reverse_tagged(spark, sf_dir):
    edges, _ = _text(spark, sf_dir)
    return postprocess.without_tagged_reverse(edges)


def text_hazard_upstream(spark, sf_dir):
    edges, hazards = _text(spark, sf_dir)
    return postprocess.without_hazard_upstream(edges, hazards)


def text_tagged_links(spark, sf_dir):
    edges, hazards = _text(spark, sf_dir)
    return postprocess.tagged_links(edges, hazards)


def text_renumbered(spark, sf_dir):
    edges, hazards = _text(spark, sf_dir)
    return postprocess.renumbered(edges, hazards)


def text_clean_up(spark, sf_dir):
    """Edges that each stage of the clean-up chain removes, per stage and graph."""
    edges, hazards = _text(spark, sf_dir)
    _, removed = postprocess.clean_up(edges, hazards)
    return removed.groupBy("stage", "graph_id").agg(F.count("*").alias("removed"))


def graph_apply_patch(spark, sf_dir):
    g = load(spark, sf_dir)
    changes = patch.review_changes(table(spark, sf_dir, "review_edge"))
    return patch.apply_edge_changes(g.edges, changes, g.nodes)


def graph_patch_diff(spark, sf_dir):
    g = load(spark, sf_dir)
    changes = patch.review_changes(table(spark, sf_dir, "review_edge"))
    return patch.edge_diff(g.edges, patch.apply_edge_changes(g.edges, changes, g.nodes))


def graph_review_cards(spark, sf_dir):
    """Changes of each graph in reading order: by severity, kind and row."""
    from causeway.functions.keys import severity_rank

    rows = table(spark, sf_dir, "review_edge").select("review_row_id", "graph_id", "change_kind", "severity").distinct()
    order = Window.partitionBy("graph_id").orderBy(severity_rank("severity"), F.lower("change_kind"), "review_row_id")
    return rows.select("review_row_id", "graph_id", F.row_number().over(order).alias("card_no"))


def graph_new_node_ids(spark, sf_dir):
    """Ids for nodes that reviews name but graphs lack, counted on from the greatest number of the prefix."""
    g = load(spark, sf_dir)
    changes = patch.review_changes(table(spark, sf_dir, "review_edge")).where("kind = 'edge_addition'")
    gone = graphs.dangling_edges(changes.select("graph_id", "pos", "source", "target"), g.nodes).where("missing_end = 'target'")
    wanted = gone.select("graph_id", "pos", F.regexp_extract("target", r"^([A-Za-z]+)\d+$", 1).alias("prefix")).where("prefix <> ''")
    return graphs.next_node_ids(g.nodes, wanted)


def _references(spark, sf_dir):
    g = load(spark, sf_dir)
    refs = g.pairs.select(F.col("ref_id").alias("graph_id")).distinct()
    return durable(g.nodes.join(refs, "graph_id", "left_semi")), durable(g.edges.join(refs, "graph_id", "left_semi"))


def graph_perturb_sweep(spark, sf_dir):
    """The reference graphs under every control, severity and replicate, with their changes and scores."""
    return perturb.perturbation_sweep(*_references(spark, sf_dir))


def graph_perturb_changes(spark, sf_dir):
    """The same runs without the scores."""
    return perturb.perturbation_changes(*_references(spark, sf_dir))


def _typed(spark, sf_dir, g=None, picked=None):
    g, picked = g or load(spark, sf_dir), picked or load_vectors(spark, sf_dir)
    typed = g.nodes.select("graph_id", "node_id", "node_type", picked.pick("name"))
    if picked.small:
        return g, compare.typed_candidates(g.pairs, typed, 0.4, picked.of("vector", "norm"))
    return g, compare.typed_candidates(g.pairs, typed.join(picked.of("vector", "norm"), "nth").drop("nth"), 0.4)


def nodes_typed_candidates(spark, sf_dir):
    _, found = _typed(spark, sf_dir)
    return found.groupBy("graph_id", "node_type").agg(F.count("*").alias("candidates"), F.round(F.max("similarity"), 5).alias("best"))


def typed_matches(spark, sf_dir, g=None, picked=None):
    """The graphs and the matches of their nodes with the reference graph's."""
    g, found = _typed(spark, sf_dir, g, picked)
    return g, assign.typed_assignment(found)


def nodes_typed_assignment(spark, sf_dir, matched=None):
    """Soft node precision, recall and F1: the summed similarity of the matches over the nodes of each side."""
    g, matches = matched or typed_matches(spark, sf_dir)
    total = matches.groupBy("graph_id").agg(F.sum("similarity").alias("sum"), F.count("*").alias("matched"))
    sizes = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    both = g.pairs.select("graph_id", "ref_id").join(total, "graph_id", "left").join(sizes, "graph_id").join(sizes.select(F.col("graph_id").alias("ref_id"), F.col("n").alias("m")), "ref_id")
    p, r = F.coalesce("sum", F.lit(0.0)) / F.col("n"), F.coalesce("sum", F.lit(0.0)) / F.col("m")
    return both.select("graph_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(compare.f1(p, r), 6).alias("f1"))


def edges_soft_match(spark, sf_dir, matched=None):
    g, matches = matched or typed_matches(spark, sf_dir)
    return assign.soft_edge_matches(g.pairs, matches, g.written)


def relation_similarity(spark, sf_dir):
    """Distinct pairs of relations of one edge in a graph and its reference, with their similarity."""
    g = load(spark, sf_dir)
    ref = g.edges.select(F.col("graph_id").alias("ref_id"), "source", "target", F.col("relation").alias("ref_relation"))
    both = g.pairs.select("graph_id", "ref_id").join(g.edges, "graph_id").join(ref, ["ref_id", "source", "target"])
    counted = both.groupBy("relation", "ref_relation").agg(F.count("*").alias("edges"))

    def ratio(a, b):
        import pyarrow as pa

        return pa.array([assign.relation_ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return counted.withColumn("similarity", F.round(F.arrow_udf(ratio, "double")("relation", "ref_relation"), 6))


def graph_sentence_cosine(spark, sf_dir, g=None, picked=None):
    g, picked = g or load(spark, sf_dir), picked or load_vectors(spark, sf_dir)
    bag = compare.triple_sentences(g.edges, g.nodes).groupBy("graph_id", picked.pick("sentence")).agg(F.count("*").alias("times"))
    members = bag.join(picked.of("unit"), "nth").select("graph_id", "times", F.col("unit").alias("vector"))
    return compare.centroid_cosine(g.pairs, members, picked.longest, "times")


def threshold_grid(spark, sf_dir):
    """The threshold with the best mean F1 of mutually best node matches, on a grid of twelve; of equals the stricter."""
    g, found = _typed(spark, sf_dir)
    found = durable(found.withColumn("similarity", F.round("similarity", 6)))
    mine = Window.partitionBy("graph_id", "node_id").orderBy(F.desc("similarity"), "ref_node_id")
    theirs = Window.partitionBy("graph_id", "ref_node_id").orderBy(F.desc("similarity"), "node_id")
    mutual = found.withColumns({"a": F.row_number().over(mine), "b": F.row_number().over(theirs)}).where("a = 1 and b = 1")
    grid = F.explode(F.array(*(F.lit(round(0.40 + 0.05 * k, 2)) for k in range(12)))).alias("threshold")
    sizes = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    pairs = g.pairs.select("graph_id", "ref_id").join(sizes, "graph_id").join(sizes.select(F.col("graph_id").alias("ref_id"), F.col("n").alias("m")), "ref_id")
    hits = mutual.select("graph_id", "similarity", grid).where("similarity >= threshold").groupBy("graph_id", "threshold").agg(F.count("*").alias("hits"))
    cells = pairs.select("graph_id", "n", "m", grid).join(hits, ["graph_id", "threshold"], "left").na.fill(0, ["hits"])
    means = cells.groupBy("threshold").agg(F.round(F.avg(2 * F.col("hits") / (F.col("n") + F.col("m"))), 9).alias("mean_f1"))
    return means.agg(F.max(F.struct("mean_f1", "threshold")).alias("best")).select("best.threshold", F.round("best.mean_f1", 6).alias("mean_f1"))


_B = BLANKS.replace("'", "''")
NODES_SQL = f"""
live as (
  select graph_id, node_id, label, name, node_type from graph_node
  where deleted_at is null and graph_id is not null and node_id is not null
  qualify row_number() over (partition by graph_id, node_id order by loaded_at desc, node_row_id desc) = 1
), nodes as (
  select graph_id, node_id, coalesce(nullif(trim(label), ''), 'UNKNOWN_LABEL') as label, coalesce(nullif(trim(name), ''), node_id) as name,
    coalesce(nullif(case when lower(trim(node_type)) = 'intermediateevent' then 'event' else lower(trim(node_type)) end, ''),
      case when starts_with(node_id, 'H') then 'hazardconsequence' when starts_with(node_id, 'En') then 'entity'
           when starts_with(node_id, 'C') then 'condition' when starts_with(node_id, 'Ev') then 'event' end, 'unknown_node_type') as node_type
  from live
), written as (
  select distinct graph_id, edge_row_id as pos, trim(source) as source, trim(target) as target, lower(trim(coalesce(relation, ''))) as relation
  from graph_edge where trim(source) <> '' and trim(target) <> '' and graph_id is not null
), edges as (
  select graph_id, source, target, arg_max(relation, pos) as relation from written
  where exists (select 1 from nodes n where n.graph_id = written.graph_id and n.node_id = written.source)
    and exists (select 1 from nodes n where n.graph_id = written.graph_id and n.node_id = written.target)
  group by all
), keys as (
  select graph_id, min(report_id) as report_id, min(lower(regexp_replace(trim(batch_id), '(?i)_output_round_\\d+$', ''))) as batch_id,
    min(case_id) as case_id, min(condition_name) as condition_name, min(run_no) as run_no
  from graph_node where graph_id is not null group by graph_id
), pairs as (
  select k.*, r.ref_id from keys k join (select report_id, min(graph_id) as ref_id from keys where condition_name = 'full_pipeline' and run_no = 1 group by 1) r
    on k.report_id = r.report_id where k.graph_id <> r.ref_id
), names as (
  select graph_id, node_id, trim(regexp_replace(lower(name), '{_B}', ' ', 'g')) as name from nodes
), named as (
  select e.*, coalesce(s.name, e.source) as source_name, coalesce(t.name, e.target) as target_name
  from edges e left join names s on s.graph_id = e.graph_id and s.node_id = e.source left join names t on t.graph_id = e.graph_id and t.node_id = e.target
), node_sigs as (
  select distinct n.graph_id, concat_ws('|', n.node_type, lower(n.label), m.name) as sig from nodes n join names m using (graph_id, node_id)
), edge_sigs as (
  select distinct graph_id, concat_ws('|', source_name, relation, target_name) as sig from named
)"""


def _with(body: str, more: str = "", recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{NODES_SQL}{', ' + more if more else ''}\n{body.lstrip()}"


def _scores(sigs: str, prefix: str) -> str:
    return f"""
{prefix}_sizes as (select graph_id, count(*) as size from {sigs} group by 1),
{prefix}_hits as (select p.graph_id, count(*) as hits from pairs p join {sigs} a on a.graph_id = p.graph_id join {sigs} b on b.graph_id = p.ref_id and b.sig = a.sig group by 1),
{prefix}_pr as (
  select p.graph_id, case when coalesce(m.size, 0) > 0 then coalesce(h.hits, 0) / m.size else 0.0 end as p,
    case when coalesce(t.size, 0) > 0 then coalesce(h.hits, 0) / t.size else 0.0 end as r
  from pairs p left join {prefix}_sizes m on m.graph_id = p.graph_id left join {prefix}_sizes t on t.graph_id = p.ref_id left join {prefix}_hits h on h.graph_id = p.graph_id
),
{prefix}_scores as (
  select graph_id, round(p, 6) as {prefix}_precision, round(r, 6) as {prefix}_recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as {prefix}_f1 from {prefix}_pr
)"""


PRF_SQL = f"{_scores('node_sigs', 'node')}, {_scores('edge_sigs', 'edge')}"
_REACH = """reach as (
  select graph_id, source, target from edges
  union select r.graph_id, r.source, e.target from reach r join edges e on e.graph_id = r.graph_id and e.source = r.target
)"""
_AVOID = """avoid as (
  select distinct graph_id, source, target as via, target from {edges} where source <> target
  union select a.graph_id, a.source, a.via, e.target from avoid a join {edges} e on e.graph_id = a.graph_id and e.source = a.target where e.target <> a.source
)"""
_VIOLATIONS = """typed as (select graph_id, node_id, node_type from nodes),
gone as (
  select w.graph_id, w.pos, w.source, w.target, case when s.node_id is null and t.node_id is null then 'both' when s.node_id is null then 'source' else 'target' end as missing_end
  from written w left join nodes s on s.graph_id = w.graph_id and s.node_id = w.source left join nodes t on t.graph_id = w.graph_id and t.node_id = w.target
  where s.node_id is null or t.node_id is null
),
ends as (select graph_id, source as node_id from written union select graph_id, target from written),
loose as (
  select graph_id, 'hazard_count' as rule, count(case when node_type = 'hazardconsequence' then 1 end)::varchar as item from typed group by graph_id
    having count(case when node_type = 'hazardconsequence' then 1 end) <> 1
  union all select graph_id, 'bad_node_id', node_id from typed where not regexp_matches(node_id, '^(H1|En[1-9][0-9]*|C[1-9][0-9]*|Ev[1-9][0-9]*)$')
  union all select graph_id, 'unknown_endpoint', concat_ws('|', source, target, missing_end) from gone
  union all select graph_id, 'bad_relation', concat_ws('|', source, target, relation) from written where relation not in ('has', 'enables')
  union all select w.graph_id, 'bad_endpoint_types', concat_ws('|', w.source, w.target, w.relation) from written w
    join typed s on s.graph_id = w.graph_id and s.node_id = w.source join typed t on t.graph_id = w.graph_id and t.node_id = w.target
    where w.relation in ('has', 'enables') and (w.relation, s.node_type, t.node_type) not in (('has', 'entity', 'entity'), ('has', 'entity', 'condition'),
      ('enables', 'event', 'event'), ('enables', 'event', 'hazardconsequence'), ('enables', 'entity', 'event'), ('enables', 'condition', 'event'), ('enables', 'condition', 'hazardconsequence'))
  union all select graph_id, 'self_loop', concat_ws('|', source, target, relation) from written where source = target
  union all select graph_id, 'duplicate_edge', concat_ws('|', source, target, relation) from written group by graph_id, source, target, relation having count(*) > 1
  union all select graph_id, 'isolated_node', node_id from typed where (graph_id, node_id) not in (select graph_id, node_id from ends)
),
strict as (
  select * from loose
  union all select graph_id, 'hazard_links', node_id from typed where node_type = 'hazardconsequence' and (graph_id, node_id) not in (select graph_id, target from written)
  union all select graph_id, 'hazard_links', node_id from typed where node_type = 'hazardconsequence' and (graph_id, node_id) in (select graph_id, source from written)
  union all select graph_id, 'no_way_out', node_id from typed where node_type <> 'hazardconsequence' and (graph_id, node_id) not in (select graph_id, source from written)
)"""
_TEXT = """hazard_of as (select graph_id, min(name) as hazard from nodes where node_type = 'hazardconsequence' group by 1),
texts as (
  select n.graph_id, n.node_id, case when n.node_type = 'condition' and h.hazard is not null then n.name || ' <' || h.hazard || '>' else n.name end as text
  from nodes n left join hazard_of h using (graph_id)
),
te as (
  select w.graph_id, w.pos, s.text as src, t.text as dst from written w
  join texts s on s.graph_id = w.graph_id and s.node_id = w.source join texts t on t.graph_id = w.graph_id and t.node_id = w.target
),
bases as (select distinct graph_id, trim(regexp_replace(trim(name), '\\s+\\d+\\s*$', '')) as base from nodes where node_type = 'hazardconsequence'),
tnodes as (select graph_id, src as node from te union select graph_id, dst from te),
parsed as (
  select graph_id, node, trim(regexp_replace(trim(split_part(node, '<', 1)), '\\s+\\d+\\s*$', '')) as base, nullif(trim(regexp_extract(node, '<([^>]+)>', 1)), '') as tag from tnodes
)"""
_CHANGES = """changes as (
  select distinct graph_id, review_row_id as pos, lower(trim(change_kind)) as kind, trim(source) as source, trim(target) as target, lower(trim(coalesce(relation, ''))) as relation
  from review_edge where trim(source) <> '' and trim(target) <> '' and graph_id is not null
)"""
_PATCHED = (
    _CHANGES
    + """,
added as (
  select graph_id, source, target, relation from edges
  union select c.graph_id, c.source, c.target, c.relation from changes c where kind = 'edge_addition' and relation <> ''
    and (graph_id, source) in (select graph_id, node_id from nodes) and (graph_id, target) in (select graph_id, node_id from nodes)
), updates as (select graph_id, source, target, arg_max(relation, pos) as suggested from changes where kind = 'edge_update' and relation <> '' group by 1, 2, 3
), updated as (select distinct a.graph_id, a.source, a.target, coalesce(u.suggested, a.relation) as relation from added a left join updates u using (graph_id, source, target)
), patched as (
  select * from updated where (graph_id, source, target, relation) not in (select graph_id, source, target, relation from changes where kind = 'edge_deletion' and relation <> '')
)"""
)
_RUN = "graph_id, control, severity, replicate"


def _target(total: str) -> str:
    return f"(case when {total} > 0 then least({total}, greatest(1, round_even({total} * severity, 0)::int)) else 0 end)"


def _turned(name: str, edges: str) -> str:
    return f"""{name}_r as (select *, turnable and row_number() over (partition by {_RUN}, turnable order by md5(concat_ws('|', seed, 'turn', source, target)), source, target) <= {_target("total")} as turned
  from (select *, count(*) over (partition by {_RUN}) as total from {edges})),
{name} as (select {_RUN}, seed, case when turned then target else source end as source, case when turned then source else target end as target, turned from {name}_r)"""


def _swapped(name: str, edges: str) -> str:
    return f"""{name}_o as (select *, row_number() over w as nth, ceil({_target("total")} / 2) as wanted, lead(source) over w as s2, lead(target) over w as t2
  from (select *, count(*) over (partition by {_RUN}) as total from {edges}) window w as (partition by {_RUN} order by md5(concat_ws('|', seed, 'swap', source, target)), source, target)),
{name}_m as (select * from {name}_o where nth % 2 = 1 and s2 is not null and source <> t2 and s2 <> target),
{name}_n as (select {_RUN}, seed, wanted, nth, source, t2 as target, target as old_target from {name}_m union all select {_RUN}, seed, wanted, nth, s2, target, t2 from {name}_m),
{name}_b as (select n.*, e.source is not null or row_number() over (partition by n.graph_id, n.control, n.severity, n.replicate, n.source, n.target order by n.nth) > 1 as bad
  from {name}_n n left join {edges} e using ({_RUN}, source, target)),
{name}_g as (select * from (select *, bool_or(bad) over (partition by {_RUN}, nth) as out from {name}_b) where not out),
{name}_s as (select * from (select *, dense_rank() over (partition by {_RUN} order by nth) as swap_no from {name}_g) where swap_no <= wanted),
{name} as (select {_RUN}, source, target, false as swapped from {edges} e where not exists (select 1 from {name}_s s where s.graph_id = e.graph_id and s.control = e.control and s.severity = e.severity
    and s.replicate = e.replicate and s.source = e.source and s.old_target = e.target)
  union all select {_RUN}, source, target, true from {name}_s)"""


def _spared(edges: str) -> str:
    at = "x.graph_id = e.graph_id and x.control = e.control and x.severity = e.severity and x.replicate = e.replicate"
    return f"select * from {edges} e where not exists (select 1 from gone x where {at} and x.node_id in (e.source, e.target))"


_PERTURB = f"""refs as (select distinct ref_id as graph_id from pairs),
runs as (select *, concat_ws('|', 42, graph_id, control, severity, replicate) as seed from (select distinct graph_id from nodes semi join refs using (graph_id))
  cross join (select unnest(['node_deletion', 'edge_deletion', 'edge_direction_reversal', 'edge_endpoint_rewiring', 'combined']) as control)
  cross join (select unnest([0.25, 0.5, 0.75])::double as severity) cross join (select unnest(range(1, 101)) as replicate)),
eligible as (select r.*, n.node_id, count(*) over (partition by {_RUN}) as total from runs r join nodes n using (graph_id)
  where control in ('node_deletion', 'combined') and node_id <> 'H1' and node_type <> 'hazardconsequence'),
gone as (select * from eligible qualify row_number() over (partition by {_RUN} order by md5(concat_ws('|', seed, 'node', node_id)), node_id) <= {_target("total")}),
re as (select r.*, e.source, e.target, e.source <> e.target and not exists (select 1 from edges b where b.graph_id = e.graph_id and b.source = e.target and b.target = e.source) as turnable
  from runs r join edges e using (graph_id)),
nd as ({_spared("(select * from re where control = 'node_deletion')")}),
ed as (select * from (select *, count(*) over (partition by {_RUN}) as total from re where control = 'edge_deletion')
  qualify row_number() over (partition by {_RUN} order by md5(concat_ws('|', seed, 'edge', source, target)), source, target) > {_target("total")}),
rv_in as (select * from re where control = 'edge_direction_reversal'), {_turned("rv", "rv_in")},
rw_in as (select * from re where control = 'edge_endpoint_rewiring'), {_swapped("rw", "rw_in")},
cb_in as ({_spared("(select * from re where control = 'combined')")}), {_turned("ct", "cb_in")}, {_swapped("cs", "ct")},
after as (
  select {_RUN}, source, target, false as turned, false as swapped from nd union all select {_RUN}, source, target, false, false from ed
  union all select {_RUN}, source, target, turned, false from rv union all select {_RUN}, source, target, false, swapped from rw
  union all select cs.graph_id, cs.control, cs.severity, cs.replicate, cs.source, cs.target, coalesce(ct.turned, false), cs.swapped from cs left join ct using ({_RUN}, source, target)
),
kept as (select a.graph_id, a.control, a.severity, a.replicate, count(*) as edges_after, count(e.source) as same, count(case when turned then 1 end) as turned, count(case when swapped then 1 end) as swapped
  from after a left join edges e using (graph_id, source, target) group by 1, 2, 3, 4),
lost as (select {_RUN}, count(*) as n from gone group by all),
sizes as (select n.graph_id, n.n as nodes, coalesce(e.n, 0) as edges from (select graph_id, count(*) as n from nodes group by 1) n left join (select graph_id, count(*) as n from edges group by 1) e using (graph_id))"""
_VEC = "(select vec_id, any_value(embedding)::double[] as v, count(*) over () as n, row_number() over (order by vec_id) - 1 as nth from embeddings where vec_id is not null group by vec_id)"
_CAND = f"""vec as {_VEC},
tv as (select x.graph_id, x.node_id, x.node_type, v.v from nodes x join vec v on ('0x' || substr(md5(x.name), 1, 8))::bigint % v.n = v.nth),
cand as (
  select p.graph_id, a.node_type, a.node_id, b.node_id as ref_node_id, list_cosine_similarity(a.v, b.v) as similarity
  from pairs p join tv a on a.graph_id = p.graph_id join tv b on b.graph_id = p.ref_id and b.node_type = a.node_type
  where list_cosine_similarity(a.v, b.v) >= 0.4
)"""

QUERIES = {
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "graph_dangling_edges": graph_dangling_edges,
    "graph_parallel_edges": graph_parallel_edges,
    "graph_degree_factors": graph_degree_factors,
    "graph_ontology_violations": graph_ontology_violations,
    "graph_strict_audit": graph_strict_audit,
    "graph_validity": graph_validity,
    "graph_signature_prf": graph_signature_prf,
    "graph_signature_extra": graph_signature_extra,
    "graph_signature_missing": graph_signature_missing,
    "graph_reachability": graph_reachability,
    "graph_shortcuts_text": graph_shortcuts_text,
    "graph_shortcuts_pipeline": graph_shortcuts_pipeline,
    "graph_longest_path": graph_longest_path,
    "graph_wl_similarity": graph_wl_similarity,
    "graph_local_edge_cost": graph_local_edge_cost,
    "graph_bipartite_ged": graph_bipartite_ged,
    "graph_assemble_linked": graph_assemble_linked,
    "text_reverse_tagged": text_reverse_tagged,
    "text_hazard_upstream": text_hazard_upstream,
    "text_tagged_links": text_tagged_links,
    "text_renumbered": text_renumbered,
    "text_clean_up": text_clean_up,
    "graph_apply_patch": graph_apply_patch,
    "graph_patch_diff": graph_patch_diff,
    "graph_review_cards": graph_review_cards,
    "graph_new_node_ids": graph_new_node_ids,
    "graph_perturb_sweep": graph_perturb_sweep,
    "graph_perturb_changes": graph_perturb_changes,
    "nodes_typed_candidates": nodes_typed_candidates,
    "nodes_typed_assignment": nodes_typed_assignment,
    "edges_soft_match": edges_soft_match,
    "relation_similarity": relation_similarity,
    "graph_sentence_cosine": graph_sentence_cosine,
    "threshold_grid": threshold_grid,
}
SQL = {
    "graph_nodes": _with("select graph_id, node_id, label, name, node_type from nodes"),
    "graph_edges": _with("select * from edges"),
    "graph_dangling_edges": _with("select * from gone", _VIOLATIONS),
    "graph_parallel_edges": _with(
        "select graph_id, source, target, count(*) as copies, count(distinct relation) as relations, arg_max(relation, pos) as last from written group by 1, 2, 3 having count(*) > 1"
    ),
    "graph_degree_factors": _with("""
, n as (select graph_id, count(*) as nodes from nodes group by 1),
i as (select graph_id, max(c) as max_in, sum(c) as edges from (select graph_id, target, count(*) as c from edges group by 1, 2) group by 1),
o as (select graph_id, max(c) as max_out from (select graph_id, source, count(*) as c from edges group by 1, 2) group by 1)
select graph_id, nodes, coalesce(edges, 0)::bigint as edges, coalesce(max_in, 0) as max_in, coalesce(max_out, 0) as max_out, round(coalesce(edges, 0) / nodes, 6) as edge_node_ratio,
  round(case when nodes > 1 then coalesce(edges, 0) / (nodes * (nodes - 1)) else 0.0 end, 6) as density, (nodes + coalesce(edges, 0))::bigint as construction_steps
from n left join i using (graph_id) left join o using (graph_id)"""),
    "graph_ontology_violations": _with("select graph_id, rule, count(*) as items, min(item) as first_item from strict group by 1, 2", _VIOLATIONS),
    "graph_validity": _with(
        """select condition_name, run_no, count(*) as graphs,
  count(case when graph_id not in (select graph_id from loose where rule <> 'isolated_node') then 1 end) as valid,
  count(case when graph_id in (select graph_id from reach where source = target) then 1 end) as with_cycle
from keys group by 1, 2""",
        f"{_VIOLATIONS}, {_REACH}",
        True,
    ),
    "graph_signature_prf": _with(
        """select graph_id, report_id, condition_name, run_no, node_precision, node_recall, node_f1, edge_precision, edge_recall, edge_f1, round((node_f1 + edge_f1) / 2, 6) as overall
from pairs join node_scores using (graph_id) join edge_scores using (graph_id)""",
        PRF_SQL,
    ),
    "graph_signature_extra": _with(
        "select p.graph_id, a.sig from pairs p join edge_sigs a on a.graph_id = p.graph_id left join edge_sigs b on b.graph_id = p.ref_id and b.sig = a.sig where b.sig is null"
    ),
    "graph_signature_missing": _with(
        "select p.graph_id, b.sig from pairs p join edge_sigs b on b.graph_id = p.ref_id left join edge_sigs a on a.graph_id = p.graph_id and b.sig = a.sig where a.sig is null"
    ),
    "graph_reachability": _with("select graph_id, count(*) as reachable_pairs, count(case when source = target then 1 end) as cycle_nodes from reach group by 1", _REACH, True),
    "graph_shortcuts_text": _with(
        "select graph_id, source, target from edges e where source <> target and exists (select 1 from avoid a where a.graph_id = e.graph_id and a.source = e.source and a.target = e.target and a.via <> a.target)",
        _AVOID.format(edges="edges"),
        True,
    ),
    "graph_shortcuts_pipeline": _with(
        """select graph_id, pos, source, target, relation from written e where
  (source <> target and exists (select 1 from avoid a where a.graph_id = e.graph_id and a.source = e.source and a.target = e.target and a.via <> a.target))
  or (source = target and exists (select 1 from avoid a join written b on b.graph_id = a.graph_id and b.source = a.target and b.target = a.source where a.graph_id = e.graph_id and a.source = e.source))
  or (select count(*) from written w where w.graph_id = e.graph_id and w.source = e.source and w.target = e.target) > 1""",
        _AVOID.format(edges="written"),
        True,
    ),
    "graph_longest_path": _with(
        "select graph_id, max(steps)::int as longest from walk group by 1",
        _REACH
        + """, part as (
  select n.graph_id, n.node_id, least(n.node_id, coalesce(min(b.target), n.node_id)) as part from nodes n
  left join (select a.graph_id, a.source, a.target from reach a join reach b on a.graph_id = b.graph_id and a.source = b.target and a.target = b.source) b on b.graph_id = n.graph_id and b.source = n.node_id
  group by 1, 2
), arcs as (
  select distinct e.graph_id, a.part as a, b.part as b from edges e join part a on a.graph_id = e.graph_id and a.node_id = e.source join part b on b.graph_id = e.graph_id and b.node_id = e.target where a.part <> b.part
), walk as (
  select distinct graph_id, part, 0 as steps from part
  union select w.graph_id, a.b, w.steps + 1 from walk w join arcs a on a.graph_id = w.graph_id and a.a = w.part
)""",
        True,
    ),
    "graph_wl_similarity": _with("""
, l0 as (select graph_id, node_id, label from nodes),
l1 as (select l.graph_id, l.node_id, md5(l.label || '(' || coalesce(string_agg(t.label, ',' order by t.label), '') || ')') as label from l0 l
  left join edges e on e.graph_id = l.graph_id and e.source = l.node_id left join l0 t on t.graph_id = e.graph_id and t.node_id = e.target group by l.graph_id, l.node_id, l.label),
l2 as (select l.graph_id, l.node_id, md5(l.label || '(' || coalesce(string_agg(t.label, ',' order by t.label), '') || ')') as label from l1 l
  left join edges e on e.graph_id = l.graph_id and e.source = l.node_id left join l1 t on t.graph_id = e.graph_id and t.node_id = e.target group by l.graph_id, l.node_id, l.label),
h as (select graph_id, 0 as round, label, count(*) as n from l0 group by all union all select graph_id, 1, label, count(*) from l1 group by all union all select graph_id, 2, label, count(*) from l2 group by all),
own as (select graph_id, sum(n * n)::double as k from h group by 1),
x as (select p.graph_id, sum(a.n * b.n)::double as x from pairs p join h a on a.graph_id = p.graph_id join h b on b.graph_id = p.ref_id and b.round = a.round and b.label = a.label group by 1)
select p.graph_id, round(case when a.k is null and b.k is null then 1.0 else coalesce(x.x / sqrt(a.k * b.k), 0.0) end, 6) as similarity
from pairs p left join own a on a.graph_id = p.graph_id left join own b on b.graph_id = p.ref_id left join x on x.graph_id = p.graph_id"""),
    "graph_local_edge_cost": _with("""
, c as (select graph_id, node_id, way, relation, count(*) as n from (select graph_id, source as node_id, 'out' as way, relation from edges union all select graph_id, target, 'in', relation from edges) group by all),
shared as (select p.graph_id, p.ref_id, a.node_id from pairs p join nodes a on a.graph_id = p.graph_id join nodes b on b.graph_id = p.ref_id and b.node_id = a.node_id),
r as (select graph_id, node_id, way, relation, sum(a) as a, sum(b) as b from (
  select s.graph_id, s.node_id, c.way, c.relation, c.n as a, 0 as b from shared s join c on c.graph_id = s.graph_id and c.node_id = s.node_id
  union all select s.graph_id, s.node_id, c.way, c.relation, 0, c.n from shared s join c on c.graph_id = s.ref_id and c.node_id = s.node_id) group by all),
w as (select graph_id, node_id, way, greatest(sum(a), sum(b)) - sum(least(a, b)) as cost from r group by all),
t as (select graph_id, node_id, sum(cost) * 0.5 as cost from w group by all)
select s.graph_id, s.node_id, coalesce(t.cost, 0)::double as cost from shared s left join t using (graph_id, node_id)"""),
    "graph_assemble_linked": _with("""select graph_id, node_type, count(*) as linked_nodes from nodes
where (graph_id, node_id) in (select graph_id, source from edges union select graph_id, target from edges) group by 1, 2"""),
    "text_reverse_tagged": _with(
        "select graph_id, pos, src, dst from te e where not exists (select 1 from te r where r.graph_id = e.graph_id and r.src = e.dst and r.dst = e.src and contains(r.dst, '<') and contains(r.dst, '>'))",
        _TEXT,
    ),
    "text_hazard_upstream": _with(
        """select e.graph_id, e.pos, e.src, e.dst from te e where not exists (
  select 1 from hz h join up u on u.graph_id = h.graph_id and u.base = h.base where h.graph_id = e.graph_id and h.node = e.src and u.node = e.dst)""",
        _TEXT
        + """, hz as (select p.graph_id, p.node, p.base from parsed p join bases b using (graph_id, base)),
up as (
  select h.graph_id, h.base, e.src as node from hz h join te e on e.graph_id = h.graph_id and e.dst = h.node
  union select u.graph_id, u.base, e.src from up u join te e on e.graph_id = u.graph_id and e.dst = u.node
)""",
        True,
    ),
    "text_tagged_links": _with(
        """select graph_id, node as src, tag as dst from picked where node <> tag and (ends = 0 and outs = 0 or ends > 0 and nth = 1)
  and (graph_id, node, tag) not in (select graph_id, src, dst from te)""",
        _TEXT
        + """, tagged as (select p.graph_id, p.node, p.tag from parsed p join bases b on b.graph_id = p.graph_id and b.base = trim(regexp_replace(p.tag, '\\s+\\d+\\s*$', '')) where p.tag is not null),
arcs as (select distinct graph_id, src, dst from te),
out_n as (select graph_id, src as node, count(*) as outs from arcs group by 1, 2),
away as (
  select graph_id, node, 0 as d from tnodes where (graph_id, node) not in (select graph_id, node from out_n)
  union select a.graph_id, a.src, w.d + 1 from away w join arcs a on a.graph_id = w.graph_id and a.dst = w.node where w.d < 40
),
near as (select graph_id, node, min(d) as d from away group by 1, 2),
ranked as (
  select t.graph_id, t.tag, t.node, coalesce(o.outs, 0) as outs, coalesce(n.d, 1000000000) as d,
    exists (select 1 from arcs a join tagged x on x.graph_id = a.graph_id and x.node = a.dst and x.tag = t.tag where a.graph_id = t.graph_id and a.src = t.node) as inner_
  from tagged t left join out_n o using (graph_id, node) left join near n using (graph_id, node)
),
picked as (select *, min(outs) over (partition by graph_id, tag) as ends, row_number() over (partition by graph_id, tag order by inner_, case when inner_ then d else outs end, node) as nth from ranked)""",
        True,
    ),
    "graph_apply_patch": _with("select * from patched", _PATCHED),
    "graph_patch_diff": _with(
        """, a as (select graph_id, source, target, string_agg(distinct relation, ',' order by relation) as old from edges group by 1, 2, 3),
b as (select graph_id, source, target, string_agg(distinct relation, ',' order by relation) as new from patched group by 1, 2, 3)
select graph_id, source, target, case when old is null then 'added' when new is null then 'deleted' else 'changed' end as status, old, new
from a full join b using (graph_id, source, target) where old is distinct from new""",
        _PATCHED,
    ),
    "graph_review_cards": """
select review_row_id, graph_id, row_number() over (partition by graph_id order by case lower(trim(severity)) when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end,
  lower(change_kind) nulls first, review_row_id) as card_no
from (select distinct review_row_id, graph_id, change_kind, severity from review_edge)""",
    "graph_new_node_ids": _with(
        """, gone as (
  select c.graph_id, c.pos, regexp_extract(c.target, '^([A-Za-z]+)\\d+$', 1) as prefix from changes c
  where kind = 'edge_addition' and (graph_id, source) in (select graph_id, node_id from nodes) and (graph_id, target) not in (select graph_id, node_id from nodes)
), top as (select graph_id, regexp_extract(node_id, '^([A-Za-z]+)(\\d+)$', 1) as prefix, max(try_cast(regexp_extract(node_id, '(\\d+)$', 1) as int)) as top from nodes group by 1, 2)
select g.graph_id, g.pos, g.prefix, g.prefix || (coalesce(t.top, 0) + row_number() over (partition by g.graph_id, g.prefix order by g.pos))::varchar as new_node_id
from gone g left join top t using (graph_id, prefix) where g.prefix <> ''""",
        _CHANGES,
    ),
    "graph_perturb_changes": _with(
        """select graph_id, control, severity, replicate, nodes as nodes_before, edges as edges_before, nodes - coalesce(l.n, 0) as nodes_after, coalesce(k.edges_after, 0) as edges_after,
  coalesce(l.n, 0) as nodes_deleted, edges - coalesce(k.edges_after, 0) as edges_deleted, coalesce(k.turned, 0) as edges_reversed, coalesce(k.swapped, 0) as edges_rewired,
  round(case when edges > 0 then coalesce(k.same, 0) / edges else 1.0 end, 6) as edges_kept, round(1 - coalesce(l.n, 0) / nodes, 6) as nodes_kept
from runs r join sizes using (graph_id) left join kept k using (graph_id, control, severity, replicate) left join lost l using (graph_id, control, severity, replicate)""",
        _PERTURB,
    ),
    "nodes_typed_candidates": _with("select graph_id, node_type, count(*) as candidates, round(max(similarity), 5) as best from cand group by 1, 2", _CAND),
    "graph_sentence_cosine": _with(
        """select p.graph_id, round(coalesce(x.x / sqrt(a.k * b.k), 0.0), 6) as cosine from pairs p left join len a on a.graph_id = p.graph_id left join len b on b.graph_id = p.ref_id
left join (select p.graph_id, sum(a.x * b.x) as x from pairs p join mean a on a.graph_id = p.graph_id join mean b on b.graph_id = p.ref_id and b.nth = a.nth group by 1) x on x.graph_id = p.graph_id""",
        f"""vec as {_VEC},
sentences as (select distinct graph_id, concat_ws(' ', source_name, case when relation = '' then 'related_to' else relation end, target_name) as sentence from named),
uv as (select s.graph_id, v.v, sqrt(list_dot_product(v.v, v.v)) as size from sentences s join vec v on ('0x' || substr(md5(s.sentence), 1, 8))::bigint % v.n = v.nth),
cells as (select graph_id, unnest(v) / size as x, generate_subscripts(v, 1) as nth from uv),
mean as (select graph_id, nth, avg(x) as x from cells group by 1, 2),
len as (select graph_id, sum(x * x) as k from mean group by 1)""",
    ),
    "threshold_grid": _with(
        """select threshold, round(mean_f1, 6) as mean_f1 from means order by mean_f1 desc, threshold desc limit 1""",
        _CAND
        + """, r as (select graph_id, node_id, ref_node_id, round(similarity, 6) as similarity from cand),
mutual as (select * from r qualify row_number() over (partition by graph_id, node_id order by similarity desc, ref_node_id) = 1 and row_number() over (partition by graph_id, ref_node_id order by similarity desc, node_id) = 1),
sizes as (select graph_id, count(*) as n from nodes group by 1),
grid as (select round(0.40 + 0.05 * k, 2)::double as threshold from range(12) t(k)),
cells as (select p.graph_id, g.threshold, a.n, b.n as m, (select count(*) from mutual u where u.graph_id = p.graph_id and u.similarity >= g.threshold) as hits
  from pairs p join sizes a on a.graph_id = p.graph_id join sizes b on b.graph_id = p.ref_id cross join grid g),
means as (select threshold, round(avg(2 * hits / (n + m)), 9) as mean_f1 from cells group by 1)""",
    ),
}
