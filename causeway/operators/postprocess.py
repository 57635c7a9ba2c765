"""Clean-up of graphs written as text edges ``A -> B`` whose names may carry a ``<hazard>`` tag.

Text edges have graph_id, pos, src, dst; hazards have graph_id, hazard (a name). Order of the chain: shortcuts, reverse
edges of tagged nodes, edges from a hazard back to its ancestors, links from tagged conditions, numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.text import before_tag, first_tag, hazard_base
from causeway.operators.closure import fixpoint, shortcuts_between_names
from causeway.session import durable


def tagged_text_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Text edges of typed graphs: names of the ends, conditions tagged with their graph's hazard."""
    hazard = nodes.where("node_type = 'hazardconsequence'").groupBy("graph_id").agg(F.min("name").alias("hazard"))
    tagged = F.when((F.col("node_type") == "condition") & F.col("hazard").isNotNull(), F.concat("name", F.lit(" <"), "hazard", F.lit(">"))).otherwise(F.col("name"))
    names = nodes.join(hazard, "graph_id", "left").select("graph_id", "node_id", tagged.alias("text"))
    src = names.select("graph_id", F.col("node_id").alias("source"), F.col("text").alias("src"))
    dst = names.select("graph_id", F.col("node_id").alias("target"), F.col("text").alias("dst"))
    return edges.join(src, ["graph_id", "source"]).join(dst, ["graph_id", "target"]).select("graph_id", "pos", "src", "dst")


def without_shortcuts(edges: DataFrame) -> DataFrame:
    named = edges.select("graph_id", F.col("src").alias("source"), F.col("dst").alias("target"))
    cut = shortcuts_between_names(named).select("graph_id", F.col("source").alias("src"), F.col("target").alias("dst"))
    return edges.join(cut, ["graph_id", "src", "dst"], "left_anti").select("graph_id", "pos", "src", "dst")


def without_tagged_reverse(edges: DataFrame) -> DataFrame:
    """Drop the exact reverse of every edge into a tagged node."""
    reverse = edges.where(F.col("dst").contains("<") & F.col("dst").contains(">")).select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return edges.join(reverse, ["graph_id", "src", "dst"], "left_anti").select("graph_id", "pos", "src", "dst")


def without_hazard_upstream(edges: DataFrame, hazards: DataFrame) -> DataFrame:
    """Drop edges from a hazard node to an ancestor of any node of the same hazard, numbers apart."""
    bases = hazards.select("graph_id", hazard_base("hazard").alias("base")).distinct()
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("base", hazard_base(before_tag("node")))
    nodes = durable(ends.join(bases, ["graph_id", "base"], "left_semi"))
    arcs = durable(edges.select("graph_id", F.col("src").alias("up"), F.col("dst").alias("node")).distinct())
    seed = nodes.join(arcs, ["graph_id", "node"]).select("graph_id", "base", F.col("up").alias("node"))
    above = fixpoint(seed, lambda new: new.join(arcs, ["graph_id", "node"]).select("graph_id", "base", F.col("up").alias("node")))
    cut = nodes.select("graph_id", "base", F.col("node").alias("src")).join(above.withColumnRenamed("node", "dst"), ["graph_id", "base"])
    cut = edges.select("graph_id", "src", "dst").distinct().join(cut.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_semi")
    return edges.join(cut, ["graph_id", "src", "dst"], "left_anti").select("graph_id", "pos", "src", "dst")


def tagged_links(edges: DataFrame, hazards: DataFrame) -> DataFrame:
    """New edges from tagged conditions to their tag: graph_id, src, dst.

    All conditions of a tag without an edge out are linked; if there are none, the one most downstream: without an edge
    to another of its tag by fewest edges out, else nearest to a sink; ties by name.
    """
    bases = hazards.select("graph_id", hazard_base("hazard").alias("base")).distinct()
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    tagged = nodes.withColumn("tag", first_tag("node")).where("tag is not null").withColumn("base", hazard_base("tag"))
    tagged = durable(tagged.join(bases, ["graph_id", "base"], "left_semi").select("graph_id", "tag", "node"))
    arcs = durable(edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    outs = arcs.groupBy("graph_id", "node").agg(F.count("*").alias("outs"))
    within = tagged.join(arcs, ["graph_id", "node"]).join(tagged.withColumnRenamed("node", "next"), ["graph_id", "tag", "next"], "left_semi").select("graph_id", "tag", "node", F.lit(True).alias("inner")).distinct()
    sinks = nodes.join(outs, ["graph_id", "node"], "left_anti").withColumn("away", F.lit(0))
    known = new = durable(sinks)
    while not new.isEmpty():
        step = new.withColumnRenamed("node", "next").join(arcs, ["graph_id", "next"]).groupBy("graph_id", "node").agg((F.min("away") + 1).alias("away"))
        new = durable(step.join(known, ["graph_id", "node"], "left_anti"))
        known = durable(known.unionByName(new))
    ranked = (
        tagged.join(outs, ["graph_id", "node"], "left").join(within, ["graph_id", "tag", "node"], "left").join(known, ["graph_id", "node"], "left")
        .na.fill(0, ["outs"]).withColumns({"away": F.coalesce("away", F.lit(10**9)), "inner": F.coalesce("inner", F.lit(False))})
    )
    group = Window.partitionBy("graph_id", "tag")
    picked = F.row_number().over(group.orderBy("inner", F.when(F.col("inner"), F.col("away")).otherwise(F.col("outs")), "node"))
    chosen = ranked.withColumns({"ends": F.min("outs").over(group) == 0, "nth": picked}).where((F.col("ends") & (F.col("outs") == 0)) | (~F.col("ends") & (F.col("nth") == 1)))
    new_edges = chosen.where("node <> tag").select("graph_id", F.col("node").alias("src"), F.col("tag").alias("dst"))
    return new_edges.join(edges.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti").distinct()


def renumbered(edges: DataFrame, hazards: DataFrame) -> DataFrame:
    """Drop the trailing number of a hazard, as a name or a tag, whose base stands only once among all ends of the graph."""
    bases = hazards.select("graph_id", hazard_base("hazard").alias("base")).distinct()
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("text"))
    said = ends.select("graph_id", F.explode(F.filter(F.array(hazard_base(first_tag("text")), hazard_base(before_tag("text"))), lambda x: x.isNotNull())).alias("base"))
    once = said.join(bases, ["graph_id", "base"], "left_semi").groupBy("graph_id", "base").count().where("count = 1")
    lone = once.groupBy("graph_id").agg(F.collect_set("base").alias("lone"))

    def short(text: str):
        tag = first_tag(text)
        tagged = F.when(F.array_contains("lone", hazard_base(tag)), F.replace(F.col(text), F.concat(F.lit("<"), F.regexp_extract(text, "<([^>]+)>", 1), F.lit(">")), F.concat(F.lit("<"), hazard_base(tag), F.lit(">")))).otherwise(F.col(text))
        base = hazard_base(before_tag(text))
        rest = F.regexp_extract(tagged, r"<.*$", 0)
        whole = F.when(F.array_contains("lone", base), F.when(rest != "", F.concat(base, F.lit(" "), rest)).otherwise(base)).otherwise(tagged)
        return F.coalesce(F.when(F.col("lone").isNotNull(), whole), F.col(text))

    return edges.join(lone, "graph_id", "left").select("graph_id", "pos", short("src").alias("src"), short("dst").alias("dst"))


def clean_up(edges: DataFrame, hazards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole chain: the clean edges, and the removed ones with the stage that removed them."""
    stages = [("shortcut", without_shortcuts), ("tagged_reverse", without_tagged_reverse), ("hazard_upstream", lambda e: without_hazard_upstream(e, hazards))]
    removed = None
    for name, stage in stages:
        kept = durable(stage(edges))
        gone = edges.join(kept, ["graph_id", "pos"], "left_anti").withColumn("stage", F.lit(name))
        removed = gone if removed is None else removed.unionByName(gone)
        edges = kept
    linked = edges.unionByName(tagged_links(edges, hazards).withColumn("pos", F.lit(None).cast("long")))
    return renumbered(linked, hazards), removed
