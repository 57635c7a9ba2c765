"""Reachability on many small graphs: fixpoints of joins, with durable cuts.

Every relation here is keyed by graph_id and grows with the graphs, never across them. A round joins only the rows that
were new in the last one (semi-naive); the rounds are as many as the longest way in any graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.session import durable


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 10_000) -> DataFrame:
    """All rows that come from ``seed`` by repeated steps. ``step`` maps new rows to their successors, same columns."""
    pieces = [durable(seed.distinct())]
    for _ in range(rounds):
        known = reduce(DataFrame.unionByName, pieces)
        new = durable(step(pieces[-1]).distinct().join(known, known.columns, "left_anti"))
        if new.isEmpty():
            break
        pieces.append(new)
    return reduce(DataFrame.unionByName, pieces)


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("source").alias("mid"), F.col("target").alias("next")).distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """graph_id, source, target: target can be reached from source over one edge or more."""
    arcs = durable(_arcs(edges))
    seed = arcs.select("graph_id", F.col("mid").alias("source"), F.col("next").alias("target"))
    return fixpoint(seed, lambda new: new.withColumnRenamed("target", "mid").join(arcs, ["graph_id", "mid"]).select("graph_id", "source", F.col("next").alias("target")))


def avoiding_source(edges: DataFrame, forks: bool = False) -> DataFrame:
    """graph_id, source, via, target: (source, via) is an edge, and target is reached from via without passing source.

    target = via is contained. Self-loops start nothing. With ``forks`` only from sources with two edges out or more.
    """
    arcs = durable(_arcs(edges))
    seed = arcs.where("mid <> next").select("graph_id", F.col("mid").alias("source"), F.col("next").alias("via"), F.col("next").alias("target"))
    if forks:
        many = seed.groupBy("graph_id", "source").agg(F.count("*").alias("n")).where("n > 1").select("graph_id", "source")
        seed = seed.join(many, ["graph_id", "source"], "left_semi")

    def step(new: DataFrame) -> DataFrame:
        on = new.withColumnRenamed("target", "mid").join(arcs, ["graph_id", "mid"]).where("next <> source")
        return on.select("graph_id", "source", "via", F.col("next").alias("target"))

    return fixpoint(seed, step)


def shortcuts_between_names(edges: DataFrame) -> DataFrame:
    """Distinct (graph_id, source, target) edges with another way of two edges or more; parallel copies are one edge.

    Every edge is judged on the whole graph. Self-loops are never shortcuts, nor is a source's only edge.
    """
    ways = avoiding_source(edges, forks=True).where("via <> target").select("graph_id", "source", "target").distinct()
    return edges.where("source <> target").select("graph_id", "source", "target").distinct().join(ways, ["graph_id", "source", "target"], "left_semi")


def shortcuts_by_row(edges: DataFrame) -> DataFrame:
    """Rows of ``edges`` (with pos) with another way; a parallel copy is one, and a self-loop's is any way back."""
    ways = avoiding_source(edges)
    other = ways.where("via <> target").select("graph_id", "source", "target")
    back = ways.select("graph_id", "source", F.col("target").alias("mid")).join(_arcs(edges), ["graph_id", "mid"]).where("next = source")
    copies = edges.groupBy("graph_id", "source", "target").count().where("count > 1").drop("count")
    all_ways = other.union(back.select("graph_id", "source", F.col("source").alias("target"))).union(copies).distinct()
    return edges.join(all_ways, ["graph_id", "source", "target"], "left_semi")


def cycle_nodes(reach: DataFrame) -> DataFrame:
    """Nodes on a directed cycle."""
    return reach.where("source = target").select("graph_id", F.col("source").alias("node_id"))


def longest_path(nodes: DataFrame, edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Edges on the longest path of each graph's condensation (strongly connected parts as one node): graph_id, longest."""
    back = reach.select("graph_id", F.col("source").alias("node_id"), F.col("target").alias("other")).join(
        reach.select("graph_id", F.col("target").alias("node_id"), F.col("source").alias("other")), ["graph_id", "node_id", "other"]
    )
    part = nodes.select("graph_id", "node_id").join(back, ["graph_id", "node_id"], "left")
    part = durable(part.groupBy("graph_id", "node_id").agg(F.min(F.least(F.col("node_id"), F.coalesce("other", F.col("node_id")))).alias("part")))
    a = part.select("graph_id", F.col("node_id").alias("source"), F.col("part").alias("mid"))
    b = part.select("graph_id", F.col("node_id").alias("target"), F.col("part").alias("next"))
    arcs = durable(edges.join(a, ["graph_id", "source"]).join(b, ["graph_id", "target"]).where("mid <> next").select("graph_id", "mid", "next").distinct())
    at = part.select("graph_id", F.col("part").alias("mid"), F.lit(0).alias("steps")).distinct()
    best = at
    for _ in range(10_000):
        at = at.join(arcs, ["graph_id", "mid"]).groupBy("graph_id", F.col("next").alias("mid")).agg((F.max("steps") + 1).alias("steps"))
        at = durable(at)
        if at.isEmpty():
            break
        best = durable(best.unionByName(at).groupBy("graph_id").agg(F.max("steps").alias("steps")).withColumn("mid", F.lit("")).select("graph_id", "mid", "steps"))
    return best.groupBy("graph_id").agg(F.max("steps").alias("longest"))
