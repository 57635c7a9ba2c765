"""Evaluations put together from the graph and panel operators, and the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import text
from causeway.functions.keys import severity_rank
from causeway.operators import assign, compare, graphs, nested, panel, patch, postprocess
from causeway.operators.assign import COUNTS
from causeway.plans.graphs import _B, _PATCHED, _TEXT, NODES_SQL, PRF_SQL, SQL as GRAPH_SQL, _scores, _typed, cut, graph_bipartite_ged, graph_signature_prf, load, load_vectors
from causeway.plans.panels import PANEL_SQL, _mean, scores
from causeway.session import durable
from causeway.sources.tables import table

SIGNATURE_METRICS = [f"{side}_{m}" for side in ("node", "edge") for m in ("precision", "recall", "f1")] + ["overall"]
#: Thresholds that are tried, and reports that calibrate: those of the first run.
GRID = [round(0.40 + 0.05 * k, 2) for k in range(12)]
DEVELOPMENT_RUN = 1


def _cases(g, scored: DataFrame) -> DataFrame:
    """Every graph but the references with its scores and status: ``failed`` where its report has no reference graph."""
    refs = g.pairs.select(F.col("ref_id").alias("graph_id")).distinct()
    cases = g.keys.join(refs, "graph_id", "left_anti").join(scored, "graph_id", "left")
    return cases.withColumn("status", F.when(F.col("overall").isNull(), "failed").otherwise("ok"))


def panel_metric_rollup(spark, sf_dir):
    """Each condition and batch, each condition and all: cases, ok and failed ones, the means of all scores and the totals of the sizes."""
    g = cut(load(spark, sf_dir))
    scored = durable(graph_signature_prf(spark, sf_dir)).select("graph_id", *SIGNATURE_METRICS)
    sizes = graphs.degree_factors(g.nodes, g.edges).select("graph_id", "nodes", "edges")
    rows = _cases(g, scored).join(sizes, "graph_id", "left").select(
        *(F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("condition_name", "batch_id")), "status", *SIGNATURE_METRICS, F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges")
    )
    out = rows.rollup("condition_name", "batch_id").agg(
        F.count("*").alias("cases"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"),
        *(panel.exact_mean(m).alias(f"mean_{m}") for m in SIGNATURE_METRICS), F.sum("nodes").alias("total_nodes"), F.sum("edges").alias("total_edges"),
    )
    return out.select(*(F.coalesce(k, F.lit("all")).alias(k) for k in ("condition_name", "batch_id")), *(c for c in out.columns if c not in ("condition_name", "batch_id")))


def panel_results_table(spark, sf_dir):
    """Each condition and score: the mean of the run means, their spread, and the spread in percent, as numbers and as written."""
    rows = durable(graph_signature_prf(spark, sf_dir))
    long = rows.select("condition_name", "run_no", F.expr(f"stack({len(SIGNATURE_METRICS)}, {', '.join(f'{m!r}, {m}' for m in SIGNATURE_METRICS)}) as (metric, score)"))
    runs = long.groupBy("condition_name", "metric", "run_no").agg(panel.exact_mean("score").alias("m"))
    out = runs.groupBy("condition_name", "metric").agg(F.count("*").alias("runs"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    cv = F.when(F.col("mean") != 0, 100 * F.col("sd") / F.col("mean"))
    return out.select(
        "condition_name", "metric", "runs", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(cv, 4).alias("cv_percent"),
        F.when(F.col("sd").isNotNull(), F.format_string("%.3f±%.3f", F.round("mean", 3), F.round("sd", 3))).alias("written"),
    )


def graph_case_evaluation(spark, sf_dir):
    """One row for each graph against its reference: status, warnings, sizes and scores, and the edge scores with all review changes accepted."""
    g = cut(load(spark, sf_dir))
    wl = compare.refinement_similarity(g.pairs, durable(compare.refined_labels(g.nodes, g.edges))).withColumnRenamed("similarity", "wl_similarity")
    nodes = compare.signature_scores(g.pairs, durable(compare.node_signatures(g.nodes)), "node").select("graph_id", "node_f1")
    sigs = durable(compare.edge_signatures(g.edges, g.nodes))
    edges = compare.signature_scores(g.pairs, sigs, "edge").select("graph_id", "edge_f1")
    changes = patch.review_changes(table(spark, sf_dir, "review_edge"))
    patched = durable(compare.edge_signatures(patch.apply_edge_changes(g.edges, changes, g.nodes), g.nodes))
    # accepted changes are those of the graph; its reference stays as it is
    refs = g.pairs.select(F.col("ref_id").alias("graph_id")).distinct()
    both = patched.join(refs, "graph_id", "left_anti").unionByName(sigs.join(refs, "graph_id", "left_semi"))
    accepted = compare.signature_scores(g.pairs, durable(both), "accepted_edge").select("graph_id", "accepted_edge_f1")
    gone = graphs.dangling_edges(g.written, g.nodes).groupBy("graph_id").agg(F.count("*").alias("warnings"))
    sizes = graphs.degree_factors(g.nodes, g.edges).select("graph_id", "nodes", "edges")
    ref_sizes = g.pairs.select("graph_id", "ref_id").join(sizes.select(F.col("graph_id").alias("ref_id"), F.col("nodes").alias("ref_nodes"), F.col("edges").alias("ref_edges")), "ref_id").drop("ref_id")
    scored = wl.join(nodes, "graph_id").join(edges, "graph_id").join(accepted, "graph_id").withColumn("overall", F.round((F.col("node_f1") + F.col("edge_f1")) / 2, 6))
    cases = _cases(g, scored).join(sizes, "graph_id", "left").join(ref_sizes, "graph_id", "left").join(gone, "graph_id", "left").na.fill(0, ["warnings", "nodes", "edges"])
    columns = ["wl_similarity", "node_f1", "edge_f1", "overall", "accepted_edge_f1"]
    return cases.select("graph_id", "report_id", "condition_name", "run_no", "status", "warnings", "nodes", "edges", "ref_nodes", "ref_edges", *columns)


def graph_edit_totals(spark, sf_dir):
    """Edit operations of each condition and kind, and each kind's share of them."""
    counted = graph_bipartite_ged(spark, sf_dir).select("graph_id", *COUNTS).join(graphs.graph_keys(table(spark, sf_dir, "graph_node")).select("graph_id", "condition_name"), "graph_id")
    sums = counted.groupBy("condition_name").agg(*(F.sum(c).alias(c) for c in COUNTS))
    long = sums.select("condition_name", F.expr(f"stack({len(COUNTS)}, {', '.join(f'{c!r}, {c}' for c in COUNTS)}) as (operation, total)"))
    whole = F.sum("total").over(Window.partitionBy("condition_name"))
    return long.withColumn("share", F.round(F.when(whole > 0, F.col("total") / whole).otherwise(0.0), 6))


def threshold_calibration(spark, sf_dir):
    """Each threshold with the mean soft node F1 of the optimal typed assignment on the graphs of the first run; the best one, of equals the stricter, is marked.

    Similarities of matched nodes are summed, so a threshold is one problem for each graph and type; all run at once.
    """
    g, found = _typed(spark, sf_dir)
    pairs = g.pairs.where(F.col("run_no") == DEVELOPMENT_RUN).select("graph_id", "ref_id")
    found = durable(found.join(pairs.select("graph_id"), "graph_id", "left_semi"))
    keyed = found.withColumn("threshold", F.explode(F.array(*map(F.lit, GRID)))).where(F.round("similarity", 9) >= F.col("threshold"))
    keyed = keyed.withColumn("node_type", F.concat_ws("|", "node_type", F.col("threshold").cast("string")))
    matched = assign.typed_assignment(keyed, keep_type=True).groupBy("graph_id", F.substring_index("node_type", "|", -1).cast("double").alias("threshold")).agg(F.sum("similarity").alias("sum"))
    sizes = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    cells = pairs.join(sizes, "graph_id").join(sizes.select(F.col("graph_id").alias("ref_id"), F.col("n").alias("m")), "ref_id").withColumn("threshold", F.explode(F.array(*map(F.lit, GRID))))
    cells = cells.join(matched, ["graph_id", "threshold"], "left").na.fill(0.0, ["sum"])
    means = cells.groupBy("threshold").agg(F.count("*").alias("graphs"), F.round(F.avg(compare.f1(F.col("sum") / F.col("n"), F.col("sum") / F.col("m"))), 9).alias("mean_f1"))
    best = means.agg(F.max(F.struct("mean_f1", "threshold")).alias("best")).select(F.col("best.threshold").alias("best"))
    return means.crossJoin(F.broadcast(best)).select("threshold", "graphs", F.round("mean_f1", 6).alias("mean_f1"), (F.col("threshold") == F.col("best")).alias("chosen"))


def panel_structure_regression(spark, sf_dir):
    """Lines of the reports' mean scores on four properties of their reference graphs, per condition: slope, its error, intercept, r, r²."""
    g = cut(load(spark, sf_dir))
    refs = g.pairs.select("report_id", F.col("ref_id").alias("graph_id")).distinct()
    properties = ["nodes", "edges", "edge_node_ratio", "max_in"]
    graph = refs.join(graphs.degree_factors(g.nodes, g.edges), "graph_id").select("report_id", *(F.col(p).cast("double").alias(p) for p in properties))
    means = scores(spark, sf_dir).groupBy("condition_name", "report_id").agg(panel.exact_mean("node_f1").alias("node_f1"), panel.exact_mean("edge_f1").alias("edge_f1"))
    rows = means.join(graph, "report_id")
    cells = F.array(*(F.struct(F.lit(p).alias("property"), F.lit(m).alias("metric"), F.col(p).alias("x"), F.col(m).alias("y")) for p in properties for m in ("node_f1", "edge_f1")))
    long = rows.select("condition_name", F.explode(cells).alias("c")).select("condition_name", "c.*")
    out = long.groupBy("condition_name", "property", "metric").agg(
        F.count("*").alias("reports"), F.covar_samp("y", "x").alias("both"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy")
    )
    slope = F.try_divide("both", F.col("sx") * F.col("sx"))
    out = out.withColumns({"slope": slope, "intercept": F.col("my") - slope * F.col("mx"), "r": F.try_divide("both", F.col("sx") * F.col("sy"))})
    # a property or score without spread has no line
    moves = (F.col("sx") > 0) & (F.col("sy") > 0)
    out = out.withColumns({c: F.when(moves, F.col(c)) for c in ("slope", "intercept", "r")})
    error = F.when(moves & (F.col("reports") > 2), F.try_divide("sy", "sx") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r") * F.col("r")) / F.greatest(F.col("reports") - 2, F.lit(1))))
    return out.select("condition_name", "property", "metric", "reports", *(F.round(c, 4).alias(c) for c in ("slope", "intercept", "r")), F.round(F.col("r") * F.col("r"), 4).alias("r2"), F.round(error, 4).alias("slope_error"))


def panel_density_2d(spark, sf_dir):
    """Gaussian density of both scores on a grid of eleven by eleven, per condition. Each row adds to the grid, pre-aggregated."""
    axis, width = [k / 10 for k in range(11)], 0.1
    grid = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in axis for y in axis))).alias("g")
    at = scores(spark, sf_dir).select("condition_name", "node_f1", "edge_f1", grid).select("condition_name", "node_f1", "edge_f1", "g.*")
    square = ((F.col("x") - F.col("node_f1")) / width) ** 2 + ((F.col("y") - F.col("edge_f1")) / width) ** 2
    return at.groupBy("condition_name", "x", "y").agg(F.round(F.avg(F.exp(-0.5 * square)) / (2 * F.pi() * width * width), 5).alias("density"))


def panel_round_completeness(spark, sf_dir):
    """Reports of each condition with all the runs that the condition has, and the runs that are missing."""
    rows = graphs.graph_keys(table(spark, sf_dir, "graph_node")).select("condition_name", "report_id", "run_no").distinct()
    runs = rows.select("condition_name", "run_no").distinct().groupBy("condition_name").agg(F.count("*").alias("runs"))
    own = rows.groupBy("condition_name", "report_id").agg(F.count("*").alias("own"))
    return own.join(F.broadcast(runs), "condition_name").groupBy("condition_name").agg(
        F.count("*").alias("reports"), F.count_if(F.col("own") == F.col("runs")).alias("complete"), F.sum(F.col("runs") - F.col("own")).alias("missing_runs")
    )


def graph_sorted_edges(spark, sf_dir):
    """The place of each edge among its graph's by source name, relation, target name and ids."""
    g = load(spark, sf_dir)
    order = Window.partitionBy("graph_id").orderBy("source_name", "relation", "target_name", "source", "target")
    return compare.named_edges(g.edges, g.nodes).select("graph_id", "source", "target", "relation", F.row_number().over(order).alias("place"))


def graph_review_markdown(spark, sf_dir):
    """The changes of each graph's reviews as lines of markdown, in reading order."""
    rows = table(spark, sf_dir, "review_edge").where("graph_id is not null").select("review_row_id", "graph_id", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("change_kind", "severity", "source", "target", "relation"))).distinct()
    line = F.concat(F.lit("- **"), F.lower("change_kind"), F.lit("** `"), "source", F.lit("` -["), F.lower("relation"), F.lit("]-> `"), "target", F.lit("`"))
    item = F.struct(severity_rank("severity").alias("rank"), F.lower("change_kind").alias("kind"), "review_row_id", line.alias("line"))
    return rows.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("markdown"))


def text_duplicate_keys(spark, sf_dir):
    """Payloads whose JSON repeats a key within one object: output_id, and how many keys are repeated."""
    return nested.duplicate_keys(table(spark, sf_dir, "step_output"), "output_id", "payload")


def narrative_cosine(spark, sf_dir):
    """The cosine of graph and reference by all their sentences, repeated ones counting as often as they stand, and its gap to that by distinct ones."""
    g = load(spark, sf_dir)
    named = compare.named_edges(g.written.join(g.nodes.select("graph_id", F.col("node_id").alias("source")), ["graph_id", "source"], "left_semi"), g.nodes)
    relation = F.when(F.col("relation") == "", "related_to").otherwise(F.col("relation"))
    said = named.select("graph_id", F.concat_ws(" ", "source_name", relation, "target_name").alias("sentence")).groupBy("graph_id", "sentence").agg(F.count("*").alias("times"))
    picked = load_vectors(spark, sf_dir)
    bag = durable(said.groupBy("graph_id", picked.pick("sentence")).agg(F.count("*").alias("once"), F.sum("times").alias("times")))
    members = bag.join(picked.of("unit"), "nth").withColumnRenamed("unit", "vector")
    once = compare.centroid_cosine(g.pairs, members, picked.longest, "once")
    often = compare.centroid_cosine(g.pairs, members, picked.longest, "times").withColumnRenamed("cosine", "narrative")
    return often.join(once, "graph_id").select("graph_id", "narrative", F.col("cosine").alias("distinct_sentences"), F.round(F.col("narrative") - F.col("cosine"), 6).alias("delta"))


def text_hazard_forms(spark, sf_dir):
    """Choices of each hazard, its name without case and number, and how many spellings it has."""
    names = table(spark, sf_dir, "hazard_choice").where("name is not null").select("choice_id", "name").distinct()
    return names.groupBy(text.hazard_form("name").alias("hazard")).agg(F.count("*").alias("choices"), F.count_distinct("name").alias("spellings"))


def text_node_classes(spark, sf_dir):
    """Nodes of each graph's text edges by class, each once whatever its case: tagged, hazard, condition or neutral, and the hidden ones."""
    g = load(spark, sf_dir)
    edges = postprocess.tagged_text_edges(g.written, g.nodes)
    ends = edges.select("graph_id", F.posexplode(F.array("src", "dst")).alias("end", "node"), "pos").withColumn("key", F.lower("node"))
    first = ends.groupBy("graph_id", "key").agg(F.min_by("node", F.struct("pos", "end")).alias("node"))
    named = lambda kind: g.nodes.where(F.col("node_type") == kind).select("graph_id", F.lower("name").alias("key"), F.lit(True).alias(kind)).distinct()
    rows = first.join(named("hazardconsequence"), ["graph_id", "key"], "left").join(named("condition"), ["graph_id", "key"], "left")
    kind = F.when(text.first_tag("node").isNotNull(), "tagged").when(F.col("hazardconsequence"), "hazard").when(F.col("condition"), "condition").otherwise("neutral")
    return rows.groupBy("graph_id", kind.alias("class")).agg(F.count("*").alias("nodes"), F.count_if(text.is_hidden("node")).alias("hidden"))


def text_xml(spark, sf_dir):
    """Documents of each source with characters that XML doesn't allow, and how many."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("source", (F.length("text") - F.length(text.xml_text("text"))).alias("illegal"))
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("illegal") > 0).alias("with_illegal"), F.sum("illegal").alias("illegal"))


_CASES = f"""with {NODES_SQL}, {PRF_SQL},
sizes as (select n.graph_id, n.n as nodes, coalesce(e.n, 0) as edges from (select graph_id, count(*) as n from nodes group by 1) n left join (select graph_id, count(*) as n from edges group by 1) e using (graph_id)),
cases as (
  select k.*, n.node_precision, n.node_recall, n.node_f1, e.edge_precision, e.edge_recall, e.edge_f1, round((n.node_f1 + e.edge_f1) / 2, 6) as overall, case when n.node_f1 is null then 'failed' else 'ok' end as status
  from keys k left join node_scores n using (graph_id) left join edge_scores e using (graph_id) where graph_id not in (select ref_id from pairs)
)"""
_WL = GRAPH_SQL["graph_wl_similarity"].split("\n, l0 as", 1)[1].split("\nselect p.graph_id", 1)
_REGRESSIONS = " union all ".join(f"select condition_name, '{p}' as property, '{m}' as metric, {p}::double as x, {m} as y from r" for p in ("nodes", "edges", "edge_node_ratio", "max_in") for m in ("node_f1", "edge_f1"))

QUERIES = {
    f.__name__: f
    for f in (
        panel_metric_rollup, panel_results_table, graph_case_evaluation, graph_edit_totals, threshold_calibration, panel_structure_regression, panel_density_2d, panel_round_completeness,
        graph_sorted_edges, graph_review_markdown, text_duplicate_keys, narrative_cosine, text_hazard_forms, text_node_classes, text_xml,
    )
}
SQL = {
    "panel_metric_rollup": _CASES
    + f""" select coalesce(condition_name, 'all') as condition_name, coalesce(batch_id, 'all') as batch_id, count(*) as cases, count(case when status = 'ok' then 1 end) as ok, count(case when status = 'failed' then 1 end) as failed,
  {", ".join(f"{_mean(m)} as mean_{m}" for m in SIGNATURE_METRICS)}, sum(nodes) as total_nodes, sum(edges) as total_edges
from (select coalesce(condition_name, '') as condition_name, coalesce(batch_id, '') as batch_id, status, {", ".join(SIGNATURE_METRICS)}, coalesce(nodes, 0)::bigint as nodes, coalesce(edges, 0)::bigint as edges
  from cases left join sizes using (graph_id)) group by rollup (condition_name, batch_id)""",
    "panel_results_table": _CASES
    + f""", long as ({" union all ".join(f"select condition_name, run_no, '{m}' as metric, {m} as score from cases where status = 'ok'" for m in SIGNATURE_METRICS)}),
runs as (select condition_name, metric, run_no, {_mean("score")} as m from long group by 1, 2, 3)
select condition_name, metric, count(*) as runs, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, round(case when avg(m) <> 0 then 100 * stddev_samp(m) / avg(m) end, 4) as cv_percent,
  printf('%.3f', round(avg(m), 3)) || '±' || printf('%.3f', round(stddev_samp(m), 3)) as written from runs group by 1, 2""",
    "graph_case_evaluation": _CASES
    + f""", l0 as{_WL[0]},
{_PATCHED}, patched_edges as (
  select e.graph_id, coalesce(s.name, e.source) as source_name, e.relation, coalesce(t.name, e.target) as target_name from patched e left join names s on s.graph_id = e.graph_id and s.node_id = e.source
  left join names t on t.graph_id = e.graph_id and t.node_id = e.target
), both_sigs as (
  select distinct graph_id, concat_ws('|', source_name, relation, target_name) as sig from patched_edges where graph_id not in (select ref_id from pairs)
  union all select * from edge_sigs where graph_id in (select ref_id from pairs)
), {_scores("both_sigs", "accepted_edge").strip()},
wl as (select p.graph_id{_WL[1]}),
gone as (select w.graph_id, count(*) as warnings from written w where (graph_id, source) not in (select graph_id, node_id from nodes) or (graph_id, target) not in (select graph_id, node_id from nodes) group by 1)
select c.graph_id, c.report_id, c.condition_name, c.run_no, c.status, coalesce(warnings, 0) as warnings, coalesce(s.nodes, 0) as nodes, coalesce(s.edges, 0) as edges, r.nodes as ref_nodes, r.edges as ref_edges,
  wl.similarity as wl_similarity, node_f1, edge_f1, overall, a.accepted_edge_f1
from cases c left join sizes s using (graph_id) left join pairs p using (graph_id) left join sizes r on r.graph_id = p.ref_id left join wl on wl.graph_id = c.graph_id left join accepted_edge_scores a on a.graph_id = c.graph_id
left join gone g on g.graph_id = c.graph_id""",
    "panel_structure_regression": PANEL_SQL
    + f""", props as (
  select k.report_id, (select count(*) from nodes n where n.graph_id = k.ref_id) as nodes, (select count(*) from edges e where e.graph_id = k.ref_id) as edges,
    coalesce((select max(c) from (select count(*) as c from edges e where e.graph_id = k.ref_id group by target)), 0) as max_in from (select distinct report_id, ref_id from pairs) k
), r as (select rep.*, nodes, edges, max_in, round(edges / nodes, 6) as edge_node_ratio from rep join props using (report_id)),
long as ({_REGRESSIONS}),
lines as (select condition_name, property, metric, count(*) as reports, stddev_samp(x) > 0 and stddev_samp(y) > 0 as moves, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, corr(y, x) as r,
  stddev_samp(x) as sx, stddev_samp(y) as sy from long group by 1, 2, 3)
select condition_name, property, metric, reports, round(case when moves then slope end, 4) as slope, round(case when moves then intercept end, 4) as intercept, round(case when moves then r end, 4) as r,
  round(case when moves then r * r end, 4) as r2, round(case when moves and reports > 2 then sy / sx * sqrt(greatest(0.0, 1 - r * r) / (reports - 2)) end, 4) as slope_error from lines""",
    "panel_density_2d": PANEL_SQL
    + """select condition_name, x, y, round(avg(exp(-0.5 * (((x - node_f1) / 0.1) ** 2 + ((y - edge_f1) / 0.1) ** 2))) / (2 * pi() * 0.1 * 0.1), 5) as density from panel
cross join (select k / 10.0::double as x from range(11) t(k)) cross join (select k / 10.0::double as y from range(11) t(k)) group by 1, 2, 3""",
    "panel_round_completeness": PANEL_SQL
    + """, own as (select condition_name, report_id, count(distinct run_no) as own from keys group by 1, 2), runs as (select condition_name, count(distinct run_no) as runs from keys group by 1)
select condition_name, count(*) as reports, count(case when own = runs then 1 end) as complete, sum(runs - own)::bigint as missing_runs from own join runs using (condition_name) group by 1""",
    "text_hazard_forms": f"""
with n as (select distinct choice_id, name, trim(regexp_replace(lower(name), '{_B}', ' ', 'g')) as form from hazard_choice where name is not null),
f as (select *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(form, '\\s+number(?:\\s*\\d+)?$', '')), '\\s*\\(\\s*\\d+\\s*\\)\\s*$', '')), '[\\s\\-_]*\\d+$', '')) as hazard from n)
select hazard, count(*) as choices, count(distinct name) as spellings from f group by 1""",
    "text_node_classes": f"""with {NODES_SQL}, {_TEXT},
ends as (select graph_id, pos, 0 as e, src as node from te union all select graph_id, pos, 1, dst from te),
firsts as (select graph_id, lower(node) as key, arg_min(node, (pos, e)) as node from ends group by 1, 2),
marked as (select f.*, case when nullif(trim(regexp_extract(node, '<([^>]+)>', 1)), '') is not null then 'tagged'
  when exists (select 1 from nodes n where n.graph_id = f.graph_id and n.node_type = 'hazardconsequence' and lower(n.name) = f.key) then 'hazard'
  when exists (select 1 from nodes n where n.graph_id = f.graph_id and n.node_type = 'condition' and lower(n.name) = f.key) then 'condition' else 'neutral' end as class from firsts f)
select graph_id, class, count(*) as nodes, count(case when trim(regexp_replace(lower(node), '{_B}', ' ', 'g')) in ('not specified', 'not dispersed', 'not dispered') then 1 end) as hidden from marked group by 1, 2""",
    "text_xml": """
with d as (select source, length(text) - length(regexp_replace(text, '[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{FFFE}\\x{FFFF}]', '', 'g')) as illegal from documents where text is not null)
select source, count(*) as documents, count(case when illegal > 0 then 1 end) as with_illegal, sum(illegal)::bigint as illegal from d group by 1""",
    "graph_sorted_edges": f"with {NODES_SQL} select graph_id, source, target, relation, row_number() over (partition by graph_id order by source_name, relation, target_name, source, target) as place from named",
    "graph_review_markdown": """
select graph_id, string_agg(line, chr(10) order by rank, kind, review_row_id) as markdown from (
  select distinct review_row_id, graph_id, case lower(trim(severity)) when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end as rank, lower(trim(coalesce(change_kind, ''))) as kind,
    '- **' || lower(trim(coalesce(change_kind, ''))) || '** `' || trim(coalesce(source, '')) || '` -[' || lower(trim(coalesce(relation, ''))) || ']-> `' || trim(coalesce(target, '')) || '`' as line
  from review_edge where graph_id is not null) group by 1""",
}
