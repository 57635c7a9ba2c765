"""Nested semi-structured records to related flat tables by Dewey labelling.

Every node of a parsed document gets a Dewey label, the path of ordinals from the root: the children of an object count
in written order, the elements of a list by position, nulls included. The label of a node's parent is the node's label
without its last ordinal, so parent-child links need no generated keys and no second pass. Nodes are grouped by schema
path (keys without ordinals, ``[]`` for a list step); each path of records becomes one table.

Parsing needs Python (answers wrapped in prose, held in strings, or cut off); it runs per Arrow batch inside
``mapInArrow`` and emits only the nodes on the wanted paths. Everything after it is DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "schema_path string, dewey array<int>, value string, is_record boolean"
_ARROW_NODES = [
    pa.field("schema_path", pa.string()),
    pa.field("dewey", pa.list_(pa.int32())),
    pa.field("value", pa.string()),
    pa.field("is_record", pa.bool_()),
]


def key_form(key: str) -> str:
    """A key without case, underscores, hyphens and blanks."""
    return "".join(c for c in key.lower() if c not in "_- \t\ufeff")


class _Number(str):
    """A number, as written."""


def _loads(text: str, hook=None):
    return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number, object_pairs_hook=hook)


def _values(text: str, hook=None) -> Iterator[object]:
    """The JSON values that can be read from ``text``: all of it, else its outermost closed objects and lists."""
    text = text.strip("\ufeff \t\r\n")
    if not text:
        return
    try:
        yield _loads(text, hook)
        return
    except (ValueError, RecursionError):
        pass
    spans: list[tuple[int, int]] = []
    stack: list[int] = []
    in_string = escaped = False
    for i, c in enumerate(text):
        if in_string:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                in_string = False
        elif c == '"':
            in_string = bool(stack)
        elif c in "{[":
            stack.append(i)
        elif c in "}]" and stack:
            start = stack.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, i + 1))
    for start, end in spans:
        try:
            yield _loads(text[start:end], hook)
        except (ValueError, RecursionError):
            continue


def _answers(text: str, roots: frozenset[str]) -> Iterator[dict]:
    """Objects with one of the root keys, shallowest first, through wrapping objects, lists and strings however deep.

    What is inside a value is shorter than the value, so the levels come to an end.
    """
    level = list(_values(text))
    while level:
        below: list[object] = []
        for value in level:
            if isinstance(value, dict):
                if any(key_form(k) in roots for k in value):
                    yield value
                else:
                    below += value.values()
            elif isinstance(value, list):
                below += value
            elif isinstance(value, str) and not isinstance(value, _Number) and "{" in value:
                below += (inner for inner in _values(value) if inner != value)
        level = below


def _text(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else None


class _Paths:
    """The wanted schema paths as a tree of key forms."""

    def __init__(self, paths: Iterable[str]):
        self.tree: dict = {}
        for path in paths:
            at = self.tree
            for step in path.split("."):
                name, many = step.removesuffix("[]"), step.endswith("[]")
                at = at.setdefault(key_form(name), {"": (name, many)})

    def walk(self, answer: dict) -> Iterator[tuple[str, list[int], str | None, bool]]:
        stack: list[tuple[object, dict, str, list[int]]] = [(answer, self.tree, "", [])]
        while stack:
            value, tree, path, label = stack.pop()
            if not isinstance(value, dict):
                continue
            seen: dict[str, int] = {}
            for n, (key, child) in enumerate(value.items(), 1):
                sub = tree.get(key_form(key))
                if sub is None or child is None and key_form(key) in seen:
                    continue
                if key_form(key) in seen and seen[key_form(key)]:
                    continue  # a second spelling of a key that already has a value
                seen[key_form(key)] = child is not None
                name, many = sub[""]
                at = f"{path}.{name}" if path else name
                if many:
                    for m, element in enumerate(child if isinstance(child, list) else [child], 1):
                        if element is not None:
                            yield at + "[]", [*label, n, m], _text(element), True
                            stack.append((element, sub, at + "[]", [*label, n, m]))
                else:
                    if isinstance(child, list) and len(child) == 1 and isinstance(child[0], dict):
                        child = child[0]
                    yield at, [*label, n], _text(child), False
                    stack.append((child, sub, at, [*label, n]))


def shred(df: DataFrame, id_col: str, payload_col: str, paths: list[str]) -> DataFrame:
    """Nodes of the documents in ``payload_col``: ``id_col``, schema_path, dewey, value, is_record.

    ``paths`` are dotted schema paths from the answer's root; ``name[]`` is a repeated record. The answer is the
    shallowest object that has the first key of a path. Keys match without case and underscores.

    A null, empty or unreadable payload gives no nodes; null elements give no node but keep their ordinal; a repeated
    child that is no list counts as a list of one. Values are texts, numbers as written; objects and lists have none.
    Repeated rows give repeated nodes. Only the two named columns are read, so further columns can't clash.
    """
    wanted = _Paths(paths)
    roots = frozenset(key_form(p.split(".")[0].removesuffix("[]")) for p in paths)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                found: set[str] = set()
                for answer in _answers(text, roots):
                    here = {key_form(x) for x in answer} & roots
                    if here & found:
                        continue
                    found |= here
                    for row in wanted.walk(answer):
                        ids.append(k)
                        rows.append(row)
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW_NODES)]
            of = batch.column(0).take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([of, *columns], schema=pa.schema([pa.field("_id", of.type), *_ARROW_NODES]))

    nodes = df.select(F.col(id_col).alias("_id"), F.col(payload_col).alias("_payload"))
    return nodes.mapInArrow(run, f"_id {id_type}, {NODE_SCHEMA}").withColumnRenamed("_id", id_col)


def duplicate_keys(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``id_col``, repeated: documents with an object that has a key twice, and how many keys are repeated in all.

    Text around the JSON doesn't matter; null and unreadable payloads have none. Repeated rows count once.
    """

    def count(payloads: pa.Array) -> pa.Array:
        out = []
        for text in payloads.to_pylist():
            repeated = 0

            def hook(pairs: list[tuple[str, object]]) -> dict:
                nonlocal repeated
                repeated += len(pairs) - len(dict(pairs))
                return dict(pairs)

            for _ in _values(text or "", hook):
                pass
            out.append(repeated)
        return pa.array(out, pa.int64())

    counted = df.select(id_col, F.arrow_udf(count, "long")(payload_col).alias("repeated"))
    return counted.groupBy(id_col).agg(F.max("repeated").alias("repeated")).where("repeated > 0")


def parent_label(label: Column, up: int = 1) -> Column:
    """The label of the ancestor ``up`` steps above."""
    return F.slice(label, F.lit(1), F.size(label) - F.lit(up))


def record_table(nodes: DataFrame, id_col: str, path: str, fields: list[str]) -> DataFrame:
    """One row for each record on ``path``: id, label, parent_label, ordinal, the record's own text and its fields.

    ``parent_dewey`` is the label of the nearest repeated record above, or the empty label. Exact copies of a document
    collapse, since a record's group is its id and label. One pre-aggregated shuffle, on the number of records.
    """
    own = nodes.where(F.col("schema_path") == path).select(
        id_col, "dewey", F.col("value").alias("own_text"), *(F.lit(None).cast("string").alias(f) for f in fields)
    )
    below = nodes.where(F.col("schema_path").isin([f"{path}.{f}" for f in fields])).select(
        id_col,
        parent_label(F.col("dewey")).alias("dewey"),
        F.lit(None).cast("string").alias("own_text"),
        *(F.when(F.col("schema_path") == f"{path}.{f}", F.col("value")).alias(f) for f in fields),
    )
    up = path.split("[]")
    above = 0 if len(up) <= 2 else len(up[-2].strip(".").split(".")) + 1  # the last record's keys and its ordinal
    parent = parent_label(F.col("dewey"), above) if above else F.expr("cast(array() as array<int>)")
    return (
        own.unionByName(below)
        .groupBy(id_col, "dewey")
        .agg(*(F.max(c).alias(c) for c in ["own_text", *fields]))
        .select(
            id_col,
            "dewey",
            parent.alias("parent_dewey"),
            F.element_at("dewey", -1).cast("long").alias("ordinal"),
            "own_text",
            *fields,
        )
    )


#: Schema paths of the model answers in step_output.
INCIDENT, SECTION, ALTERNATIVE = "incidents[]", "incidents[].other_related_sections[]", "explanation.excluded_alternatives[]"
ANSWER_PATHS = [
    f"{INCIDENT}.incident_id",
    f"{INCIDENT}.time_reference",
    f"{INCIDENT}.is_independent_incident",
    f"{SECTION}.section_title",
    f"{SECTION}.text",
    f"{ALTERNATIVE}.label",
    f"{ALTERNATIVE}.reason",
]


def child_records(steps: DataFrame) -> DataFrame:
    """The child records of model answers: output_id, kind, parent_no, child_no, item.

    Takes output_id and payload. See :func:`shred` for what is read from a payload. A record's item is its id, title or
    label as written, the record itself where it is a bare string, and empty where null or absent.
    """
    kinds = {INCIDENT: ("incident", "incident_id"), SECTION: ("section", "section_title"), ALTERNATIVE: ("alternative", "label")}
    nodes = shred(steps, "output_id", "payload", [f"{path}.{field}" for path, (_, field) in kinds.items()])
    path = F.col("schema_path")
    record = path.isin(list(kinds))
    kind = F.coalesce(*(F.when(path.startswith(p + ".") & ~path.endswith("[]") | (path == p), k) for p, (k, _) in reversed(kinds.items())))
    # a field belongs to the record whose label is its own, truncated
    return (
        nodes.where(record | path.isin([f"{p}.{f}" for p, (_, f) in kinds.items()]))
        .select(
            "output_id",
            kind.alias("kind"),
            F.when(record, F.col("dewey")).otherwise(parent_label(F.col("dewey"))).alias("dewey"),
            "value",
        )
        .groupBy("output_id", "kind", "dewey")
        .agg(F.max("value").alias("item"))
        .select(
            "output_id",
            "kind",
            F.when(F.col("kind") == "section", F.element_at("dewey", 2)).otherwise(0).cast("long").alias("parent_no"),
            F.element_at("dewey", -1).cast("long").alias("child_no"),
            F.coalesce("item", F.lit("")).alias("item"),
        )
    )
