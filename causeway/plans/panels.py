"""Queries on the panel of graph scores (condition, run, report), and the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.keys import case_key, difference_bucket, numeric_first
from causeway.operators import compare, graphs, panel
from causeway.plans.graphs import (
    NODES_SQL, PRF_SQL, cut, edges_soft_match, graph_bipartite_ged, graph_perturb_sweep, graph_sentence_cosine, graph_wl_similarity, load, load_vectors, nodes_typed_assignment, typed_matches,
)
from causeway.session import durable, released
from causeway.sources.tables import table

#: The conditions that have all runs beside the reference graph.
CONDITIONS = ["no_few_shot", "no_revision", "single_pass"]
RUNS = 5
METRICS = ["node_f1", "edge_f1"]
#: All conditions: full_pipeline enters with the runs that aren't the reference graph.
ALL_CONDITIONS = ["full_pipeline", *CONDITIONS]
ALL_RUNS = [2, 3, 4, 5]
#: The nine scores of the family of tests.
ALL_METRICS = ["edit_similarity", "wl_similarity", *(f"soft_{side}_{m}" for side in ("node", "edge") for m in ("precision", "recall", "f1")), "sentence_cosine"]
RESAMPLES = 10_000


def scores(spark, sf_dir, g=None):
    """The panel: report_id, batch_id, case_id, condition_name, run_no, nodes, edges, node_f1, edge_f1."""
    g = g or cut(load(spark, sf_dir))
    nodes = compare.signature_scores(g.pairs, durable(compare.node_signatures(g.nodes)), "node").select("graph_id", "node_f1")
    edges = compare.signature_scores(g.pairs, durable(compare.edge_signatures(g.edges, g.nodes)), "edge").select("graph_id", "edge_f1")
    sizes = graphs.degree_factors(g.nodes, g.edges).select("graph_id", "nodes", "edges")
    return g.pairs.drop("ref_id").join(nodes, "graph_id").join(edges, "graph_id").join(sizes, "graph_id")


def panel_rollup(spark, sf_dir):
    return panel.rollup(scores(spark, sf_dir), ["condition_name", "batch_id"], METRICS)


def panel_run_summary(spark, sf_dir):
    return panel.run_summary(scores(spark, sf_dir), "node_f1")


def panel_report_means(spark, sf_dir):
    return panel.report_means(scores(spark, sf_dir), "node_f1", CONDITIONS)


def panel_complete_reports(spark, sf_dir):
    return panel.complete_reports(scores(spark, sf_dir), CONDITIONS, RUNS).select("report_id", "condition_name", "run_no", "node_f1")


def panel_paired_contrasts(spark, sf_dir):
    return panel.contrasts(panel.differences(scores(spark, sf_dir), "node_f1", CONDITIONS)).drop("p")


def panel_p_values(spark, sf_dir):
    """t-test p-values of the contrasts of both metrics, adjusted together."""
    rows = durable(scores(spark, sf_dir))
    both = [panel.contrasts(panel.differences(rows, m, CONDITIONS)).withColumn("metric", F.lit(m)) for m in METRICS]
    return panel.holm(both[0].unionByName(both[1]).withColumn("family", F.lit("panel")), "p", ["family"]).drop("family")


def panel_holm(spark, sf_dir):
    """Share of reports whose difference isn't positive, as a p-value per contrast and metric, Holm-adjusted."""
    rows = durable(scores(spark, sf_dir))
    both = [panel.differences(rows, m, CONDITIONS).withColumn("metric", F.lit(m)) for m in METRICS]
    tests = both[0].unionByName(both[1]).groupBy("metric", "contrast").agg(((F.count_if(F.round("diff", 9) <= 0) + 1) / (F.count("*") + 1)).alias("p"))
    adjusted = panel.holm(tests.withColumn("family", F.lit("panel")), "p", ["family"])
    return adjusted.select("metric", "contrast", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


def panel_balanced_anova(spark, sf_dir):
    return panel.balanced_anova(durable(scores(spark, sf_dir)), "node_f1", CONDITIONS, RUNS)


def panel_bootstrap_dz(spark, sf_dir):
    return panel.bootstrap_dz(durable(panel.differences(scores(spark, sf_dir), "node_f1", CONDITIONS)))


def all_scores(spark, sf_dir):
    """The panel with every score of the graph queries: ``scores`` and the other ``ALL_METRICS``.

    The graphs, the vectors and the node matches are made once for all; each score is written before the next, so that
    the shuffles of one are there at a time.
    """
    g, picked = cut(load(spark, sf_dir)), load_vectors(spark, sf_dir)
    g = g._replace(pairs=durable(g.pairs))
    matched = g, released(spark, lambda: typed_matches(spark, sf_dir, g, picked)[1])
    rows = released(spark, lambda: scores(spark, sf_dir, g))
    soft = {side: {m: f"soft_{side}_{m}" for m in ("precision", "recall", "f1")} for side in ("node", "edge")}
    for score, named in (
        (lambda: graph_wl_similarity(spark, sf_dir, g), {"similarity": "wl_similarity"}), (lambda: graph_bipartite_ged(spark, sf_dir, g), {"similarity": "edit_similarity"}),
        (lambda: graph_sentence_cosine(spark, sf_dir, g, picked), {"cosine": "sentence_cosine"}),
        (lambda: nodes_typed_assignment(spark, sf_dir, matched), soft["node"]), (lambda: edges_soft_match(spark, sf_dir, matched), soft["edge"]),
    ):
        scored = released(spark, lambda score=score, named=named: score().select("graph_id", *(F.col(k).alias(v) for k, v in named.items())))
        rows = rows.join(scored, "graph_id", "left")
    return rows


def _planned(rows, metrics):
    return reduce(DataFrame.unionByName, (panel.differences(rows, m, ALL_CONDITIONS).withColumn("metric", F.lit(m)) for m in metrics))


def panel_planned_contrasts(spark, sf_dir):
    """All contrasts of the four conditions for every score, Holm-adjusted as one family."""
    rows = durable(all_scores(spark, sf_dir))
    tests = [panel.contrasts(panel.differences(rows, m, ALL_CONDITIONS)).withColumn("metric", F.lit(m)) for m in ALL_METRICS]
    return panel.holm(reduce(DataFrame.unionByName, tests).withColumn("family", F.lit("panel")), "p", ["family"]).drop("family")


def panel_planned_means(spark, sf_dir):
    """The report means of every score in the four conditions."""
    rows = durable(all_scores(spark, sf_dir))
    return reduce(DataFrame.unionByName, (panel.report_means(rows, m, ALL_CONDITIONS).withColumn("metric", F.lit(m)) for m in [*METRICS, *ALL_METRICS]))


def panel_planned_anova(spark, sf_dir):
    """The balanced model of the node score on the runs that all four conditions have."""
    return panel.balanced_anova(durable(scores(spark, sf_dir).where(F.col("run_no").isin(ALL_RUNS))), "node_f1", ALL_CONDITIONS, len(ALL_RUNS))


def panel_planned_bootstrap(spark, sf_dir):
    """Intervals of d_z from 10,000 resamples for each contrast of the four conditions in both signature scores."""
    diffs = durable(_planned(durable(scores(spark, sf_dir)), METRICS))
    keyed = diffs.select(F.concat_ws("|", "metric", "contrast").alias("contrast"), "report_id", "diff")
    return panel.bootstrap_dz(keyed, RESAMPLES)


def panel_quartiles(spark, sf_dir):
    """Quartiles of the edge score by the number of nodes."""
    q = F.percentile("edge_f1", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = scores(spark, sf_dir).groupBy("nodes").agg(F.count("*").alias("graphs"), q.alias("q"))
    return out.select("nodes", "graphs", *(F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)))


def panel_signed_bucket(spark, sf_dir):
    """Mean scores by the bucket of the signed difference in nodes to the reference."""
    g = load(spark, sf_dir)
    sizes = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    diff = g.pairs.select("graph_id", "ref_id").join(sizes, "graph_id").join(sizes.select(F.col("graph_id").alias("ref_id"), F.col("n").alias("m")), "ref_id")
    rows = scores(spark, sf_dir).join(diff.select("graph_id", (F.col("n") - F.col("m")).alias("difference")), "graph_id")
    return rows.groupBy(difference_bucket("difference").alias("bucket")).agg(F.count("*").alias("graphs"), panel.exact_mean("node_f1").alias("mean_node_f1"))


def panel_regression(spark, sf_dir):
    """Lines of the node score on the number of nodes and of edges, per condition."""
    rows = scores(spark, sf_dir).select("condition_name", "node_f1", F.col("nodes").cast("double").alias("x"))
    out = rows.groupBy("condition_name").agg(
        F.count("*").alias("graphs"), F.regr_slope("node_f1", "x").alias("slope"), F.regr_intercept("node_f1", "x").alias("intercept"), F.corr("node_f1", "x").alias("r")
    )
    return out.select("condition_name", "graphs", *(F.round(c, 4).alias(c) for c in ("slope", "intercept", "r")), F.round(F.col("r") * F.col("r"), 4).alias("r2"))


def panel_low_decile(spark, sf_dir):
    """Graphs at or below the first decile of their condition's node score."""
    rows = durable(scores(spark, sf_dir))
    low = rows.groupBy("condition_name").agg(F.round(F.percentile("node_f1", F.lit(0.1)), 9).alias("low"))
    return rows.join(low, "condition_name").where("node_f1 <= low").select("graph_id", "condition_name", "node_f1")


def panel_histogram(spark, sf_dir):
    """Counts of node scores in tenths, and each one's share of its condition."""
    rows = scores(spark, sf_dir).withColumn("bin", F.least(F.floor(F.round(F.col("node_f1") * 10, 6)), F.lit(9)))
    counted = rows.groupBy("condition_name", "bin").agg(F.count("*").alias("graphs"))
    whole = F.sum("graphs").over(Window.partitionBy("condition_name"))
    return counted.withColumn("share", F.round(F.col("graphs") / whole, 6))


def panel_kde(spark, sf_dir):
    rows = scores(spark, sf_dir)
    return panel.kernel_density(rows, "condition_name", "node_f1", [k / 20 for k in range(21)], 0.08)


def panel_monotonicity(spark, sf_dir):
    """Whether the mean node score never rises with the number of nodes, per condition."""
    means = scores(spark, sf_dir).groupBy("condition_name", "nodes").agg(panel.exact_mean("node_f1").alias("mean"))
    return panel.monotonicity(means, ["condition_name"], "nodes", "mean")


def panel_audit(spark, sf_dir):
    """Rows, reports, runs, runs of a report, repeated cells and missing batches of each condition."""
    rows = graphs.graph_keys(table(spark, sf_dir, "graph_node"))
    cells = rows.groupBy("condition_name", "report_id", "run_no").agg(F.count("*").alias("n"), F.count_if(F.col("batch_id").isNull()).alias("blank"))
    reports = cells.groupBy("condition_name", "report_id").agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.sum((F.col("n") > 1).cast("int")).alias("repeated"), F.sum("blank").alias("blank"))
    runs = cells.groupBy("condition_name").agg(F.countDistinct("run_no").alias("runs"))
    out = reports.groupBy("condition_name").agg(
        F.sum("n").alias("rows"), F.count("*").alias("reports"), F.min("runs").alias("least_runs"), F.max("runs").alias("most_runs"), F.sum("repeated").alias("repeated_cells"), F.sum("blank").alias("blank_batches")
    )
    return out.join(runs, "condition_name")


def panel_key_set_diff(spark, sf_dir):
    """Reports and runs that graphs have and step outputs should have: both, missing or extra, per run."""
    expected = graphs.graph_keys(table(spark, sf_dir, "graph_node")).select("report_id", "run_no").distinct().withColumn("e", F.lit(1))
    there = table(spark, sf_dir, "step_output").select("report_id", "run_no").distinct().withColumn("f", F.lit(1))
    status = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("both")
    return expected.join(there, ["report_id", "run_no"], "full").groupBy("run_no", status.alias("status")).agg(F.count("*").alias("cells"))


def panel_round_pairs(spark, sf_dir):
    """Stability of a condition over its runs: mean difference of the scores of each two runs of a report."""
    rows = durable(scores(spark, sf_dir).select("condition_name", "report_id", "run_no", "node_f1"))
    b = rows.select("condition_name", "report_id", F.col("run_no").alias("other"), F.col("node_f1").alias("f"))
    pairs = rows.join(b, ["condition_name", "report_id"]).where("run_no < other")
    gap = F.abs(F.col("node_f1") - F.col("f"))
    return pairs.groupBy("condition_name").agg(F.count("*").alias("pairs"), F.countDistinct("report_id").alias("reports"), panel.exact_mean(gap).alias("mean_gap"))


def panel_history(spark, sf_dir):
    """The scores of a report's last three runs up to each run."""
    order = Window.partitionBy("condition_name", "report_id").orderBy("run_no")
    rows = scores(spark, sf_dir).select("condition_name", "report_id", "run_no", "node_f1")
    return rows.withColumns({"history": F.collect_list("node_f1").over(order.rowsBetween(-2, 0)), "change": F.round(F.col("node_f1") - F.lag("node_f1").over(order), 6)})


def panel_top_reports(spark, sf_dir):
    """The five reports with the lowest blended score of both metrics."""
    means = scores(spark, sf_dir).groupBy("report_id").agg(panel.exact_mean("node_f1").alias("node_f1"), panel.exact_mean("edge_f1").alias("edge_f1"))
    blended = means.withColumn("blended", F.round(0.5 * F.col("node_f1") + 0.5 * F.col("edge_f1"), 9))
    return blended.orderBy("blended", "report_id").limit(5).select("report_id", F.round("blended", 6).alias("blended"))


def panel_label_frequency(spark, sf_dir):
    """Labels by falling frequency, then name: the ten first."""
    counted = load(spark, sf_dir).nodes.groupBy("label").agg(F.count("*").alias("nodes"))
    return counted.orderBy(F.desc("nodes"), "label").limit(10)


def panel_case_order(spark, sf_dir):
    """The place of each case in its batch, numbers first in numeric order."""
    cases = graphs.graph_keys(table(spark, sf_dir, "graph_node")).select("batch_id", "case_id").distinct().where("batch_id is not null and case_id is not null")
    order = Window.partitionBy("batch_id").orderBy(*numeric_first("case_id"))
    return cases.select("batch_id", "case_id", case_key("batch_id", "case_id").alias("case_key"), F.row_number().over(order).alias("place"))


def heldout_documents(spark, sf_dir):
    """Documents by whether their case is on the evaluation list: kept or excluded, per source."""
    docs = table(spark, sf_dir, "documents").select("source", F.lower(F.trim("case_ref")).alias("case_key"))
    cases = table(spark, sf_dir, "eval_item").select(F.lower(F.trim("case_key")).alias("case_key"), F.lit(True).alias("listed")).distinct()
    marked = docs.join(cases, "case_key", "left")
    return marked.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("listed").alias("excluded"), F.count_if(F.col("listed").isNull()).alias("kept"))


def heldout_reports(spark, sf_dir):
    """Panel rows of the reports without a hazard choice in the same run (an anti-join on both keys), per condition."""
    rows = graphs.graph_keys(table(spark, sf_dir, "graph_node"))
    chosen = table(spark, sf_dir, "hazard_choice").select("report_id", "run_no").distinct()
    return rows.join(chosen, ["report_id", "run_no"], "left_anti").groupBy("condition_name").agg(F.count("*").alias("rows"), F.countDistinct("report_id").alias("reports"))


def latest_outputs(spark, sf_dir):
    """The step output received last for each report and step."""
    rows = table(spark, sf_dir, "step_output").where("received_at is not null")
    last = rows.groupBy("report_id", "step_name").agg(F.max(F.struct("received_at", "output_id")).alias("last"), F.countDistinct("output_id").alias("outputs"))
    return last.select("report_id", "step_name", "last.output_id", "outputs")


def _control_means(spark, sf_dir):
    """Negative controls: the mean scores of a report (its reference graph) over the replicates, per control, severity and metric."""
    scored = graph_perturb_sweep(spark, sf_dir).where("control <> 'positive_control'")
    # the summary reads them twice
    means = durable(scored.groupBy("control", "severity", "graph_id").agg(panel.exact_mean("wl_similarity").alias("wl"), panel.exact_mean("edit_similarity").alias("edit")))
    return means.select("control", "severity", "graph_id", F.expr("stack(2, 'wl_similarity', wl, 'edit_similarity', edit) as (metric, score)"))


def controls_summary(spark, sf_dir):
    """Negative controls per control, severity and score: mean with its 95 % t-interval, mean decrease, d_z, and Holm-adjusted p-values."""
    means = _control_means(spark, sf_dir).withColumn("contrast", F.concat_ws("|", "control", F.col("severity").cast("string"), "metric"))
    diffs = means.select("contrast", F.col("graph_id").alias("report_id"), (1 - F.col("score")).alias("diff"))
    tests = panel.holm(panel.contrasts(diffs).withColumn("family", F.lit("controls")), "p", ["family"]).drop("family")
    return tests.join(panel.t_interval(means, ["contrast"], "score"), "contrast")


def controls_monotonicity(spark, sf_dir):
    """Whether the mean score never rises with the severity of a control, per control and score."""
    means = _control_means(spark, sf_dir).groupBy("control", "metric", "severity").agg(panel.exact_mean("score").alias("score"))
    return panel.monotonicity(means, ["control", "metric"], "severity", "score")


PANEL_SQL = f"""with {NODES_SQL}, {PRF_SQL},
panel as (
  select p.graph_id, p.report_id, p.batch_id, p.case_id, p.condition_name, p.run_no, n.node_f1, e.edge_f1, s.nodes
  from pairs p join node_scores n using (graph_id) join edge_scores e using (graph_id) join (select graph_id, count(*) as nodes from nodes group by 1) s using (graph_id)
),
rep as (select report_id, condition_name, sum(round(node_f1 * 1e6)::bigint)::double / count(*) / 1e6 as node_f1, sum(round(edge_f1 * 1e6)::bigint)::double / count(*) / 1e6 as edge_f1 from panel group by 1, 2),
diffs as (
  select a.condition_name || ' - ' || b.condition_name as contrast, a.report_id, a.node_f1 - b.node_f1 as diff, a.edge_f1 - b.edge_f1 as edge_diff
  from rep a join rep b on a.report_id = b.report_id and a.condition_name < b.condition_name
  where a.condition_name in ('no_few_shot', 'no_revision', 'single_pass') and b.condition_name in ('no_few_shot', 'no_revision', 'single_pass')
),
whole as (
  select * from panel where condition_name in ('no_few_shot', 'no_revision', 'single_pass') and report_id in (
    select report_id from panel where condition_name in ('no_few_shot', 'no_revision', 'single_pass') group by 1 having count(*) = 15 and count(distinct condition_name || run_no) = 15)
)
"""


def _mean(x: str) -> str:
    return f"sum(round({x} * 1e6)::bigint)::double / count({x}) / 1e6"


_U = "('0x' || substr(md5(contrast || '|' || report_id || '|' || resample), 1, 8))::bigint / 4294967296.0"
_W = " + ".join(f"case when u >= {c!r} then 1 else 0 end" for c in panel.POISSON)

QUERIES = {
    f.__name__: f
    for f in (
        panel_rollup, panel_run_summary, panel_report_means, panel_complete_reports, panel_paired_contrasts, panel_p_values, panel_holm,
        panel_balanced_anova, panel_bootstrap_dz, panel_planned_contrasts, panel_planned_means, panel_planned_anova, panel_planned_bootstrap, panel_quartiles, panel_signed_bucket, panel_regression, panel_low_decile, panel_histogram,
        panel_kde, panel_monotonicity, panel_audit, panel_key_set_diff, panel_round_pairs, panel_history, panel_top_reports,
        panel_label_frequency, panel_case_order, heldout_documents, heldout_reports, latest_outputs, controls_summary,
        controls_monotonicity,
    )
}
SQL = {
    "panel_rollup": PANEL_SQL
    + f"""select coalesce(condition_name, 'all') as condition_name, coalesce(batch_id, 'all') as batch_id, count(*) as rows, {_mean("node_f1")} as mean_node_f1, {_mean("edge_f1")} as mean_edge_f1
from (select coalesce(condition_name, '') as condition_name, coalesce(batch_id, '') as batch_id, node_f1, edge_f1 from panel) group by rollup (condition_name, batch_id)""",
    "panel_run_summary": PANEL_SQL
    + f"""select condition_name, count(*) as runs, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, round(100 * stddev_samp(m) / avg(m), 4) as cv_percent
from (select condition_name, run_no, {_mean("node_f1")} as m from panel group by 1, 2) group by 1""",
    "panel_report_means": PANEL_SQL
    + """select report_id, max(case when condition_name = 'no_few_shot' then node_f1 end) as no_few_shot, max(case when condition_name = 'no_revision' then node_f1 end) as no_revision,
  max(case when condition_name = 'single_pass' then node_f1 end) as single_pass from rep group by 1""",
    "panel_complete_reports": PANEL_SQL + "select report_id, condition_name, run_no, node_f1 from whole",
    "panel_paired_contrasts": PANEL_SQL
    + """select contrast, count(*) as reports, round(avg(diff), 6) as mean, round(stddev_samp(diff), 6) as sd, round(avg(diff) / stddev_samp(diff), 5) as dz,
  round(avg(diff) / stddev_samp(diff) * sqrt(count(*)), 5) as t from diffs group by 1""",
    "panel_holm": PANEL_SQL
    + """, tests as (
  select 'node_f1' as metric, contrast, (count(case when round(diff, 9) <= 0 then 1 end) + 1) / (count(*) + 1) as p from diffs group by 2
  union all select 'edge_f1', contrast, (count(case when round(edge_diff, 9) <= 0 then 1 end) + 1) / (count(*) + 1) from diffs group by 2
), steps as (select *, (count(*) over () - row_number() over (order by p) + 1) * p as step from tests)
select metric, contrast, round(p, 6) as p, round(least(1.0, max(step) over (order by p rows unbounded preceding)), 6) as p_holm from steps""",
    "panel_balanced_anova": PANEL_SQL
    + """, r as (select report_id, avg(node_f1) as m from whole group by 1), c as (select condition_name, avg(node_f1) as m from whole group by 1), u as (select run_no, avg(node_f1) as m from whole group by 1),
g as (select avg(node_f1) as m, count(distinct report_id) as n from whole),
ss as (select sum((w.node_f1 - r.m - c.m - u.m + 2 * g.m) ** 2) as residual from whole w join r using (report_id) join c using (condition_name) join u using (run_no) cross join g),
ms as (select residual / (n * 15 - n - 3 - 5 + 2) as sigma, (select sum((r.m - g.m) ** 2) from r) * 15 / (n - 1) as report_ms, n from ss cross join g),
va as (select sigma, greatest(0.0, (report_ms - sigma) / 15) as tau, n from ms)
select condition_name, round(c.m, 6) as adjusted_mean, round(sqrt(tau / n + sigma / (n * 5)), 6) as se, round(sqrt(2 * sigma / (n * 5)), 6) as se_difference from c cross join va""",
    "panel_bootstrap_dz": PANEL_SQL
    + f""", drawn as (select contrast, report_id, diff, resample, {_U} as u from diffs cross join (select unnest(range(1, 201)) as resample)),
weighted as (select contrast, resample, diff, {_W} as w from drawn),
sums as (select contrast, resample, sum(w) as n, sum(w * diff) as s, sum(w * diff * diff) as q from weighted group by 1, 2),
dz as (select contrast, s / n / sqrt((q - n * (s / n) * (s / n)) / (n - 1)) as dz from sums where n > 1 and (q - n * (s / n) * (s / n)) / (n - 1) > 1e-15)
select contrast, count(*) as resamples, round(quantile_cont(dz, 0.025), 5) as low, round(quantile_cont(dz, 0.975), 5) as high from dz group by 1""",
    "panel_quartiles": PANEL_SQL
    + "select nodes, count(*) as graphs, round(quantile_cont(edge_f1, 0.25), 4) as q1, round(quantile_cont(edge_f1, 0.5), 4) as q2, round(quantile_cont(edge_f1, 0.75), 4) as q3 from panel group by 1",
    "panel_signed_bucket": PANEL_SQL
    + f""", sizes as (select graph_id, count(*) as n from nodes group by 1), d as (select p.graph_id, a.n - b.n as d from pairs p join sizes a on a.graph_id = p.graph_id join sizes b on b.graph_id = p.ref_id)
select case when d <= -6 then '<=-6' when d <= -3 then '-5..-3' when d <= -1 then '-2..-1' when d = 0 then '0' when d <= 2 then '1..2' when d <= 5 then '3..5' else '>=6' end as bucket,
  count(*) as graphs, {_mean("node_f1")} as mean_node_f1 from panel join d using (graph_id) group by 1""",
    "panel_regression": PANEL_SQL
    + """select condition_name, count(*) as graphs, round(regr_slope(node_f1, nodes), 4) as slope, round(regr_intercept(node_f1, nodes), 4) as intercept, round(corr(node_f1, nodes), 4) as r,
  round(corr(node_f1, nodes) ** 2, 4) as r2 from panel group by 1""",
    "panel_low_decile": PANEL_SQL
    + "select graph_id, condition_name, node_f1 from panel join (select condition_name, round(quantile_cont(node_f1, 0.1), 9) as low from panel group by 1) using (condition_name) where node_f1 <= low",
    "panel_histogram": PANEL_SQL
    + """, b as (select condition_name, least(floor(round(node_f1 * 10, 6)), 9)::bigint as bin, count(*) as graphs from panel group by 1, 2)
select condition_name, bin, graphs, round(graphs / sum(graphs) over (partition by condition_name), 6) as share from b""",
    "panel_kde": PANEL_SQL
    + """select condition_name, x, round(avg(exp(-0.5 * ((x - node_f1) / 0.08) ** 2) / (0.08 * sqrt(2 * pi()))), 6) as density from panel cross join (select k / 20.0::double as x from range(21) t(k)) group by 1, 2""",
    "panel_monotonicity": PANEL_SQL
    + f""", m as (select condition_name, nodes, {_mean("node_f1")} as mean from panel group by 1, 2), r as (select *, mean - lag(mean) over (partition by condition_name order by nodes) as rise from m)
select condition_name, coalesce(bool_and(rise <= 1e-12), true) as monotone, round(max(rise), 6) as greatest_rise from r group by 1""",
    "panel_audit": PANEL_SQL
    + """, cells as (select condition_name, report_id, run_no, count(*) as n, count(case when batch_id is null then 1 end) as blank from keys group by 1, 2, 3),
r as (select condition_name, report_id, count(*) as runs, sum(n) as n, sum(case when n > 1 then 1 else 0 end) as repeated, sum(blank) as blank from cells group by 1, 2)
select condition_name, sum(n)::bigint as rows, count(*) as reports, min(runs) as least_runs, max(runs) as most_runs, sum(repeated)::bigint as repeated_cells, sum(blank)::bigint as blank_batches,
  (select count(distinct run_no) from cells c where c.condition_name = r.condition_name) as runs from r group by 1""",
    "panel_key_set_diff": PANEL_SQL
    + """, e as (select distinct report_id, run_no from keys), f as (select distinct report_id, run_no from step_output)
select run_no, case when f.report_id is null then 'missing' when e.report_id is null then 'extra' else 'both' end as status, count(*) as cells from e full join f using (report_id, run_no) group by 1, 2""",
    "panel_round_pairs": PANEL_SQL
    + f"""select a.condition_name, count(*) as pairs, count(distinct a.report_id) as reports, {_mean("abs(a.node_f1 - b.node_f1)")} as mean_gap
from panel a join panel b on a.condition_name = b.condition_name and a.report_id = b.report_id and a.run_no < b.run_no group by 1""",
    "panel_history": PANEL_SQL
    + """select condition_name, report_id, run_no, node_f1, list(node_f1) over w as history, round(node_f1 - lag(node_f1) over (partition by condition_name, report_id order by run_no), 6) as change
from panel window w as (partition by condition_name, report_id order by run_no rows between 2 preceding and current row)""",
    "panel_top_reports": PANEL_SQL
    + f"""select report_id, round(blended, 6) as blended from (select report_id, round(0.5 * ({_mean("node_f1")}) + 0.5 * ({_mean("edge_f1")}), 9) as blended from panel group by 1) order by 2, 1 limit 5""",
    "panel_label_frequency": PANEL_SQL + "select label, count(*) as nodes from nodes group by 1 order by 2 desc, 1 limit 10",
    "panel_case_order": PANEL_SQL
    + """select batch_id, case_id, batch_id || '/' || lower(trim(case_id)) as case_key, row_number() over (partition by batch_id order by coalesce(try_cast(case_id as bigint), 1000000000), case_id) as place
from (select distinct batch_id, case_id from keys where batch_id is not null and case_id is not null)""",
    "heldout_documents": """
select source, count(*) as documents, count(case when c.case_key is not null then 1 end) as excluded, count(case when c.case_key is null then 1 end) as kept
from documents d left join (select distinct lower(trim(case_key)) as case_key from eval_item) c on c.case_key = lower(trim(d.case_ref)) group by 1""",
    "heldout_reports": PANEL_SQL
    + "select condition_name, count(*) as rows, count(distinct report_id) as reports from keys k where not exists (select 1 from hazard_choice h where h.report_id = k.report_id and h.run_no = k.run_no) group by 1",
    "latest_outputs": """
select report_id, step_name, arg_max(output_id, (received_at, output_id)) as output_id, count(distinct output_id) as outputs from step_output where received_at is not null group by 1, 2""",
}
