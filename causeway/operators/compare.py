"""Scores of graph pairs: signature sets, label refinement, local edge costs, sentence vectors.

``pairs`` always holds graph_id and ref_id; scores join on the pair and a signature, label or node, never on the pair
alone, so nothing is compared all with all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import vectors
from causeway.functions.text import normalize


def f1(precision: Column, recall: Column) -> Column:
    """The harmonic mean, 0 where both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def share(part: Column, whole: Column, empty: float) -> Column:
    """part / whole; ``empty`` where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def node_signatures(nodes: DataFrame) -> DataFrame:
    """graph_id, sig: type, label and name of the nodes, distinct."""
    sig = F.concat_ws("|", "node_type", F.lower("label"), normalize("name"))
    return nodes.select("graph_id", sig.alias("sig")).distinct()


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the normal names of their ends; an end that is no node keeps its id."""
    names = nodes.select("graph_id", "node_id", normalize("name").alias("name"))
    src = names.select("graph_id", F.col("node_id").alias("source"), F.col("name").alias("source_name"))
    dst = names.select("graph_id", F.col("node_id").alias("target"), F.col("name").alias("target_name"))
    both = edges.join(src, ["graph_id", "source"], "left").join(dst, ["graph_id", "target"], "left")
    return both.withColumns({"source_name": F.coalesce("source_name", "source"), "target_name": F.coalesce("target_name", "target")})


def edge_signatures(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, sig: source name, relation and target name of the edges, distinct."""
    sig = F.concat_ws("|", "source_name", "relation", "target_name")
    return named_edges(edges, nodes).select("graph_id", sig.alias("sig")).distinct()


def signature_scores(pairs: DataFrame, sigs: DataFrame, prefix: str) -> DataFrame:
    """Precision, recall and F1 of a graph's signatures against its reference's; 0 where a side is empty."""
    sizes = sigs.groupBy("graph_id").agg(F.count("*").alias("size"))
    own = pairs.select("graph_id", "ref_id").join(sigs, "graph_id")
    hits = own.join(sigs.withColumnRenamed("graph_id", "ref_id"), ["ref_id", "sig"]).groupBy("graph_id").agg(F.count("*").alias("hits"))
    table = (
        pairs.select("graph_id", "ref_id")
        .join(sizes.select("graph_id", F.col("size").alias("mine")), "graph_id", "left")
        .join(sizes.select(F.col("graph_id").alias("ref_id"), F.col("size").alias("theirs")), "ref_id", "left")
        .join(hits, "graph_id", "left")
        .na.fill(0, ["mine", "theirs", "hits"])
    )
    p, r = share(F.col("hits"), F.col("mine"), 0.0), share(F.col("hits"), F.col("theirs"), 0.0)
    return table.select(
        "graph_id", F.round(p, 6).alias(f"{prefix}_precision"), F.round(r, 6).alias(f"{prefix}_recall"), F.round(f1(p, r), 6).alias(f"{prefix}_f1")
    )


def signature_difference(pairs: DataFrame, sigs: DataFrame, extra: bool) -> DataFrame:
    """Signatures that a graph has beyond its reference (``extra``), or lacks: graph_id, sig."""
    mine = pairs.select("graph_id", "ref_id").join(sigs, "graph_id")
    theirs = pairs.select("graph_id", "ref_id").join(sigs.withColumnRenamed("graph_id", "ref_id"), "ref_id")
    a, b = (mine, theirs) if extra else (theirs, mine)
    return a.join(b, ["graph_id", "ref_id", "sig"], "left_anti").select("graph_id", "sig")


def refined_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Label histogram of the refinement by successors: graph_id, round, label, n.

    Labels count as written; those of later rounds are hashes.
    """
    at = nodes.select("graph_id", "node_id", "label")
    counted = [at.withColumn("round", F.lit(0))]
    for k in range(1, rounds + 1):
        of = at.select("graph_id", F.col("node_id").alias("target"), F.col("label").alias("next"))
        after = edges.join(of, ["graph_id", "target"]).groupBy("graph_id", F.col("source").alias("node_id")).agg(F.array_sort(F.collect_list("next")).alias("all"))
        at = at.join(after, ["graph_id", "node_id"], "left").select(
            "graph_id", "node_id", F.md5(F.concat("label", F.lit("("), F.coalesce(F.array_join("all", ","), F.lit("")), F.lit(")"))).alias("label")
        )
        counted.append(at.withColumn("round", F.lit(k)))
    return reduce(DataFrame.unionByName, counted).groupBy("graph_id", "round", "label").agg(F.count("*").alias("n"))


def refinement_similarity(pairs: DataFrame, histogram: DataFrame) -> DataFrame:
    """The normalised label-refinement kernel of each pair: 1 for two empty graphs, 0 if only one is empty."""
    own = histogram.groupBy("graph_id").agg(F.sum(F.col("n") * F.col("n")).alias("k"))
    ref = histogram.select(F.col("graph_id").alias("ref_id"), "round", "label", F.col("n").alias("m"))
    cross = pairs.select("graph_id", "ref_id").join(histogram, "graph_id").join(ref, ["ref_id", "round", "label"])
    cross = cross.groupBy("graph_id").agg(F.sum(F.col("n") * F.col("m")).alias("cross"))
    table = (
        pairs.select("graph_id", "ref_id")
        .join(own, "graph_id", "left")
        .join(own.select(F.col("graph_id").alias("ref_id"), F.col("k").alias("ref_k")), "ref_id", "left")
        .join(cross, "graph_id", "left")
    )
    value = F.when(F.col("k").isNull() & F.col("ref_k").isNull(), 1.0).otherwise(F.coalesce(F.col("cross") / F.sqrt(F.col("k").cast("double") * F.col("ref_k")), F.lit(0.0)))
    return table.select("graph_id", F.round(value, 6).alias("similarity"))


def local_edge_cost(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Local edge cost of the nodes that a graph and its reference have under one id: graph_id, node_id, cost.

    For each direction the cost of two multisets of relations is max(n, m) less their common part; the node's cost is
    half the sum over both directions.
    """
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit("out").alias("way")), F.struct(F.col("target").alias("node_id"), F.lit("in").alias("way")))).alias("e"), "relation")
    counts = ends.groupBy("graph_id", "e.node_id", "e.way", "relation").agg(F.count("*").alias("n"))
    ids = nodes.select("graph_id", "node_id")
    shared = pairs.select("graph_id", "ref_id").join(ids, "graph_id").join(ids.withColumnRenamed("graph_id", "ref_id"), ["ref_id", "node_id"])
    mine = shared.join(counts, ["graph_id", "node_id"]).select("graph_id", "node_id", "way", "relation", F.col("n").alias("a"), F.lit(0).alias("b"))
    theirs = shared.join(counts.withColumnRenamed("graph_id", "ref_id"), ["ref_id", "node_id"]).select("graph_id", "node_id", "way", "relation", F.lit(0).alias("a"), F.col("n").alias("b"))
    by_relation = mine.unionByName(theirs).groupBy("graph_id", "node_id", "way", "relation").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by_way = by_relation.groupBy("graph_id", "node_id", "way").agg((F.greatest(F.sum("a"), F.sum("b")) - F.sum(F.least("a", "b"))).alias("cost"))
    cost = by_way.groupBy("graph_id", "node_id").agg((F.sum("cost") * 0.5).alias("cost"))
    return shared.join(cost, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def triple_sentences(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, sentence of each edge, distinct: source name, relation (related_to where blank), target name."""
    relation = F.when(F.col("relation") == "", "related_to").otherwise(F.col("relation"))
    return named_edges(edges, nodes).select("graph_id", F.concat_ws(" ", "source_name", relation, "target_name").alias("sentence")).distinct()


def centroid_cosine(pairs: DataFrame, members: DataFrame, longest: int, weight: str | None = None) -> DataFrame:
    """The cosine of the mean vectors of a graph's members (graph_id, vector: of length 1) and its reference's."""
    mean = vectors.mean_vector(members, ["graph_id"], "vector", longest, weight)
    both = pairs.select("graph_id", "ref_id").join(mean, "graph_id", "left").join(mean.select(F.col("graph_id").alias("ref_id"), F.col("vector").alias("ref")), "ref_id", "left")
    return both.select("graph_id", F.round(vectors.cosine("vector", "ref"), 6).alias("cosine"))


def typed_candidates(pairs: DataFrame, typed: DataFrame, threshold: float, table: DataFrame | None = None) -> DataFrame:
    """Pairs of nodes of one type with a cosine of at least ``threshold``: graph_id, node_id, ref_node_id, similarity.

    ``typed`` has graph_id, node_id, node_type, and vector and norm, or nth with a ``table`` (nth, vector, norm) to be
    broadcast: then vectors join the pairs and aren't shuffled. The join is on the pair of graphs and the type, so it
    grows with the square of the nodes of a type in one graph only.
    """
    named = ["vector", "norm"] if table is None else ["nth"]
    ref = typed.select(F.col("graph_id").alias("ref_id"), F.col("node_id").alias("ref_node_id"), "node_type", *(F.col(c).alias(f"ref_{c}") for c in named))
    both = pairs.select("graph_id", "ref_id").join(typed, "graph_id").join(ref, ["ref_id", "node_type"])
    if table is not None:
        both = both.join(table, "nth").join(table.select(*(F.col(c).alias(f"ref_{c}") for c in table.columns)), "ref_nth")
    fit = (F.size("vector") == F.size("ref_vector")) & (F.size("vector") > 0) & (F.col("norm") * F.col("ref_norm") > 0)
    cosine = F.when(fit, vectors.dot("vector", "ref_vector") / (F.col("norm") * F.col("ref_norm")))
    scored = both.withColumn("similarity", F.coalesce(cosine, F.lit(0.0)))
    return scored.where(F.col("similarity") >= threshold).select("graph_id", "node_type", "node_id", "ref_node_id", "similarity")
