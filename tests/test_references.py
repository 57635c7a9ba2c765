import random
from datetime import datetime, timedelta

from causeway.operators.references import graph_orphans, orphan_references

T0 = datetime(2024, 1, 30)
REFS = "scope long, key string, at timestamp_ntz, no long, word string"
PARENTS = "scope long, key string, since timestamp_ntz, until timestamp_ntz"


def expected(refs, parents):
    out = []
    for scope, key, at, no, _ in refs:
        if key is None:
            continue
        own = [p for p in parents if p[0] is not None and p[0] == scope and p[1] == key]
        before = [p for p in own if p[2] is not None and at is not None and p[2] <= at]
        if any(p[3] is None or p[3] > at for p in before):
            continue
        out.append((no, "missing" if not own else "deleted" if before else "late"))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda: T0 + timedelta(hours=rng.randint(0, 24 * 70))
    keys = ["En1", "En2", "C1", "Ev10", " x", "é"]
    for _ in range(3):
        parents = [(rng.randint(1, 4), rng.choice(keys), day() if rng.random() < 0.95 else None, day() if rng.random() < 0.4 else None) for _ in range(30)]
        parents += parents[:3]
        refs = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice([*keys, "zz", None]), day() if rng.random() < 0.95 else None, k, "w") for k in range(300)]
        out = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()
        assert sorted((r.no, r.reason) for r in out) == expected(refs, parents)


def test_one_hot_key_and_empty_tables(spark):
    parents = [(1, "En1", T0, T0 + timedelta(days=5)), (1, "En1", T0 + timedelta(days=9), None)]
    refs = [(1, "En1", T0 + timedelta(hours=12 * k), k, "w") for k in range(40)]
    out = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()
    assert sorted(r.no for r in out) == list(range(10, 18)) and {r.reason for r in out} == {"deleted"}
    assert orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame([], PARENTS)).count() == 40
    assert orphan_references(spark.createDataFrame([], REFS), spark.createDataFrame(parents, PARENTS)).count() == 0


def test_edges_blank_and_padded(spark):
    edges = spark.createDataFrame(
        [(1, 1, " En1 ", "", T0, 5), (2, 1, None, "  ", T0, 5), (3, 1, "en1", "En1", T0, 5), (3, 1, "en1", "En1", T0, 5)],
        "edge_row_id long, graph_id long, source string, target string, loaded_at timestamp_ntz, word int",
    )
    review = edges.limit(0).withColumnRenamed("edge_row_id", "review_row_id")
    nodes = spark.createDataFrame([(1, "En1", T0, None)], "graph_id long, node_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    assert [tuple(r) for r in graph_orphans(edges, review, nodes).collect()] == [("graph_edge", 3, "source", "missing", "2024-01")]
