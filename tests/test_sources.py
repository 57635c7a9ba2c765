import json

import pytest

from causeway.operators import catalogue
from causeway.sources import graph_documents as G
from causeway.sources import panels, sinks

NODE = {"label": "Material", "name": " acid ", "node_id": "En1", "node_type": "Entity"}
DOC = {
    "hazard_consequence_node": {"name": "VCE", "node_id": "H1", "node_type": "HazardConsequence"},
    "entity_nodes": [NODE, None, {"node_id": "En2"}],
    "event_nodes": {"node_id": "Ev1"},
    "edges": [{"source": "En1", "target": "Ev1", "label": "has"}, {"source": "", "target": "Ev1"}, {"source": "Ev1", "target": "H1", "relation": "enables", "label": "x"}],
}


@pytest.fixture
def tree(tmp_path):
    for run, batch, case, name, body in [
        ("round_1", "batch_1_output_round_1", "7", "graph.json", json.dumps(DOC)),
        ("round_2", "batch_1", "7", "later_a.json", "not json"),
        ("round_2", "batch_1", "7", "later_b.json", json.dumps(DOC)),
    ]:
        place = tmp_path / "revision" / run / batch / case
        place.mkdir(parents=True, exist_ok=True)
        (place / name).write_text(body)
    return str(tmp_path)


def test_graph_documents(spark, tree):
    docs = G.read_documents(spark, tree)
    assert {(r.condition_name, r.run_no, r.batch_id, r.case_id) for r in docs.collect()} == {("revision", 1, "batch_1", "7"), ("revision", 2, "batch_1", "7")}
    assert G.read_documents(spark, tree, runs=["round_2"]).count() == 2
    picked = {r.run_no: r.file_name for r in G.pick_document(docs, ["graph.json", "later_b.json"]).collect()}
    assert picked == {1: "graph.json", 2: "later_b.json"}
    one = docs.where("file_name = 'graph.json'")
    count = lambda objects: sorted((r.node_id, r.name) for r in G.document_nodes(one, ["path"], objects).collect())
    assert count("none") == [("En1", "acid"), ("En2", "En2")]
    assert count("hazard") == [("En1", "acid"), ("En2", "En2"), ("H1", "VCE")]
    assert len(count("any")) == 4
    assert sorted((r.pos, r.source, r.relation) for r in G.document_edges(one, ["path"]).collect()) == [(0, "En1", "has"), (2, "Ev1", "enables")]
    assert G.document_nodes(docs.where("body = 'not json'"), ["path"], "any").count() == 0


def test_document_round_trip(spark):
    nodes = spark.createDataFrame([(1, "H1", "l", "n", "hazardconsequence"), (1, "En1", "l", "n", "entity")], "graph_id long, node_id string, label string, name string, node_type string")
    edges = spark.createDataFrame([(1, "En1", "H1", "enables")], "graph_id long, source string, target string, relation string")
    body = G.graph_document(nodes, edges, "graph_id")
    assert G.document_nodes(body, ["graph_id"]).count() == 2
    assert [r.relation for r in G.document_edges(body, ["graph_id"]).collect()] == ["enables"]


def test_results_and_exclusions(spark, tmp_path, tree):
    latest = panels.latest_results(spark, tree, "*.json").collect()
    assert any(r.by_name.endswith("later_b.json") for r in latest)
    (tmp_path / "x.json").write_text(json.dumps({"description": "d", "excluded_cases": ["batch_1_output_round_2/1", "batch_2/3"]}))
    keys = panels.read_exclusions(spark, str(tmp_path / "x.json"))
    assert {r.case_key for r in keys.collect()} == {"batch_1/1", "batch_2/3"}
    rows = spark.createDataFrame([("batch_1/1",), ("batch_9/1",)], "case_key string")
    kept, gone = panels.held_out(rows, keys)
    assert sinks.exclusion_audit(kept, gone).first().asDict() == {"kept": 1, "excluded": 1}
    (tmp_path / "y.json").write_text(json.dumps(["batch_1/1", "batch_1_output_round_2/1"]))
    with pytest.raises(ValueError):
        panels.read_exclusions(spark, str(tmp_path / "y.json"))
    good = {"custom_id": "a", "response": {"status_code": 200, "body": {"output": [{"content": [{"text": "x"}, {"text": "y"}]}]}}}
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\n" + json.dumps({"custom_id": "b", "error": "no"}) + "\nbroken\n")
    assert sorted((r.status, r.text) for r in panels.read_batch_results(spark, str(tmp_path / "r.jsonl")).collect()) == [("bad", None), ("failed", None), ("ok", "xy")]
    (tmp_path / "t.txt").write_text("a pres-\n sure rise")
    assert [r.text for r in panels.read_texts(spark, str(tmp_path), "t.txt").collect()] == ["a pressure rise"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, None), (2, None, "b")], "k int, v double, s string")
    sinks.write_csv(df, str(tmp_path / "csv"), ["k", "v", "s"], one_file=True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).collect()) == ["1,0.500000,", "2,,b", "k,v,s"]
    with pytest.raises(ValueError):
        sinks.write_csv(df, str(tmp_path / "no"), ["k"], extra="error")
    shards = str(tmp_path / "shards")
    assert sinks.missing_shards(df.select("k"), shards, ["k"]).count() == 2
    sinks.write_shards(df.where("k = 1"), shards, ["k"])
    sinks.write_shards(df.where("k = 2"), shards, ["k"])
    sinks.write_shards(df.where("k = 1"), shards, ["k"])
    assert spark.read.parquet(shards).count() == 2 and sinks.missing_shards(df.select("k"), shards, ["k"]).count() == 0
    prompts = sinks.render("Say {{s}}!", df.withColumnRenamed("k", "custom_id"), ["s"])
    assert sorted(r.prompt for r in prompts.collect()) == ["Say !", "Say b!"]
    assert all(json.loads(r.value)["method"] == "POST" for r in sinks.request_lines(prompts, "m", "/u").collect())
    bad = sinks.placeholder_errors(spark.createDataFrame([("s", "{{a}} {{ b }}", ["b", "c"])], "step string, template string, declared array<string>")).first()
    assert (bad.undeclared, bad.unused) == (["a"], ["c"])
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, content string")
    there = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "name string, content string")
    assert {r.name: r.status for r in sinks.copy_status(files, there, ["name"]).collect()} == {"a": "unchanged", "b": "conflict", "c": "to_copy", "d": "only_in_target"}


def test_page_links(spark):
    html = "<html><title>T</title><a href='/x?pg=3'>Next <b>page</b></a><a>none</a></html>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    assert [tuple(r) for r in catalogue.page_links(pages, "id", "html").collect()] == [(1, "T", 0, "/x?pg=3", "Next page", 3)]
