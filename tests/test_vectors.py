"""Mean vectors and the scores that use them: columns instead of cells, one load of graphs and vectors for all scores."""

import os

import pytest
from pyspark.sql import functions as F

from causeway.functions import vectors
from causeway.operators import compare
from causeway.plans import graphs, panels

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("wide", [128, 2])
def test_weighted_means_of_ragged_vectors(spark, monkeypatch, wide):
    monkeypatch.setattr(vectors, "WIDE", wide)
    rows = [(1, [1.0, 2.0, 3.0], 1), (1, [3.0, 4.0], 3), (1, None, 5), (2, [1.0, None], 2), (3, [], 1)]
    df = spark.createDataFrame(rows, "g long, v array<double>, n int")
    assert {r.g: r.v for r in vectors.mean_vector(df, ["g"], "v", 3).collect()} == {1: [2.0, 3.0, 3.0], 2: [1.0, None]}
    assert {r.g: r.v for r in vectors.mean_vector(df, ["g"], "v", 3, "n").collect()} == {1: [2.5, 3.5, 3.0], 2: [1.0, None]}


def test_candidates_with_vectors_before_or_after(spark):
    pairs = spark.createDataFrame([(1, 2)], "graph_id long, ref_id long")
    nodes = spark.createDataFrame([(1, "a", "event", 0), (1, "b", "event", 1), (2, "c", "event", 1), (2, "d", "event", 2)], "graph_id long, node_id string, node_type string, nth long")
    table = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0])], "nth long, vector array<double>").withColumn("norm", vectors.norm("vector"))
    late = compare.typed_candidates(pairs, nodes, 0.4, F.broadcast(table)).collect()
    assert late == compare.typed_candidates(pairs, nodes.join(table, "nth").drop("nth"), 0.4).collect()
    assert [(r.node_id, r.ref_node_id, round(r.similarity, 9)) for r in late] == [("b", "c", 1.0)]


@needs_data
def test_vectors_of_sentences_are_not_exploded_or_shuffled(spark):
    plan = graphs.graph_sentence_cosine(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "broadcast" in plan
    assert "evidence" not in graphs.load(spark, DATA).nodes.columns


@needs_data
def test_all_scores_load_the_graphs_once(spark, monkeypatch):
    read, load = [], graphs.load
    for module in (graphs, panels):
        monkeypatch.setattr(module, "load", lambda *a: read.append(a) or load(*a))
    panels.all_scores(spark, DATA)
    assert len(read) == 1
