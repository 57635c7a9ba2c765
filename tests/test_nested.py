import json

from causeway.operators import nested

ANSWER = {
    "incidents": [
        {"incident_id": 7, "other_related_sections": [{"section_title": "A"}, None, "B", {"section_title": None}]},
        None,
        {"incident_id": "x", "other_related_sections": {"Section_Title": "C"}},
        "bare",
    ]
}
HAZARD = {"hazard_consequence_node": {"name": "n"}, "explanation": {"excluded_alternatives": [{"label": "VCE"}, None, {"reason": "r"}]}}
INCIDENT_ROWS = {
    ("incident", 0, 1, "7"),
    ("section", 1, 1, "A"),
    ("section", 1, 3, "B"),
    ("section", 1, 4, ""),
    ("incident", 0, 3, "x"),
    ("section", 3, 1, "C"),
    ("incident", 0, 4, "bare"),
}
HAZARD_ROWS = {("alternative", 0, 1, "VCE"), ("alternative", 0, 3, "")}


def found(spark, payloads):
    df = spark.createDataFrame([(k, p, "x", 1) for k, p in enumerate(payloads)], "output_id long, payload string, label string, value int")
    out = {k: set() for k in range(len(payloads))}
    for r in nested.child_records(df).collect():
        assert (row := tuple(r)[1:]) not in out[r.output_id]
        out[r.output_id].add(row)
    return out


def test_wrappings_give_the_same_rows(spark):
    text = json.dumps(ANSWER)
    payloads = [
        text,
        "Here it is {so}:\n```json\n" + text + "\n```\nDone.",
        json.dumps(text),
        json.dumps({"meta": {"run": 1}, "identify_incident_output": ANSWER}),
        json.dumps({"result": [{"out": text}]}),
        "﻿" + text.replace("incidents", "Incidents").replace("incident_id", "incidentId").replace("other_related", "Other_Related"),
        json.dumps(HAZARD),
        json.dumps(HAZARD, indent=2),
    ]
    out = found(spark, payloads)
    assert all(out[k] == INCIDENT_ROWS for k in range(6))
    assert out[6] == out[7] == HAZARD_ROWS


def test_unreadable_payloads_give_nothing(spark):
    text = json.dumps(ANSWER)
    bad = [None, "", "  ", "no answer", text[:-2], text[: len(text) // 2], "null", "[]", "3", json.dumps({"incidents": None}), json.dumps({"explanation": None})]
    assert not any(found(spark, bad).values())


def test_copies_and_empty_tables(spark):
    df = spark.createDataFrame([(1, json.dumps(ANSWER))] * 3, "output_id long, payload string")
    assert nested.child_records(df).count() == len(INCIDENT_ROWS)
    assert nested.child_records(df.limit(0)).count() == 0


def test_tables_keep_parent_links(spark):
    df = spark.createDataFrame([(1, json.dumps(ANSWER))], "output_id long, payload string")
    nodes = nested.shred(df, "output_id", "payload", nested.ANSWER_PATHS)
    incidents = nested.record_table(nodes, "output_id", nested.INCIDENT, ["incident_id"]).collect()
    sections = nested.record_table(nodes, "output_id", nested.SECTION, ["section_title"]).collect()
    labels = {tuple(r.dewey): r.ordinal for r in incidents}
    assert sorted(labels.values()) == [1, 3, 4]
    assert sorted((labels[tuple(r.parent_dewey)], r.ordinal, r.section_title or r.own_text) for r in sections) == [(1, 1, "A"), (1, 3, "B"), (1, 4, None), (3, 1, "C")]


def test_long_payload_that_is_cut_off(spark):
    text = json.dumps({"incidents": [{"incident_id": str(k), "other_related_sections": [{"section_title": "{["}]} for k in range(20_000)]})
    out = found(spark, [text, text[:-1]])
    assert len(out[0]) == 40_000 and not out[1]
