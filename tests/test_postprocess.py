from pyspark.sql import functions as F

from causeway.functions import text
from causeway.operators import postprocess as P


def edges(spark, *lines):
    return spark.createDataFrame([(1, k, *line.split(" -> ")) for k, line in enumerate(lines)], "graph_id long, pos long, src string, dst string")


def hazards(spark, *names):
    return spark.createDataFrame([(1, n) for n in names], "graph_id long, hazard string")


def lines(df):
    return sorted(f"{r.src} -> {r.dst}" for r in df.collect())


def test_tagged_reverse(spark):
    assert lines(P.without_tagged_reverse(edges(spark, "A -> B <EO release>", "B <EO release> -> A"))) == ["A -> B <EO release>"]


def test_hazard_upstream_merges_numbers(spark):
    found = P.without_hazard_upstream(edges(spark, "A -> Leak", "Leak -> Explosion 1", "Explosion 2 -> A", "Explosion 2 -> B"), hazards(spark, "Explosion"))
    assert lines(found) == ["A -> Leak", "Explosion 2 -> B", "Leak -> Explosion 1"]


def test_tagged_links(spark):
    all_ends = P.tagged_links(edges(spark, "A -> c1 <Fire>", "A -> c2 <Fire>", "A -> d <Other>"), hazards(spark, "Fire"))
    assert lines(all_ends) == ["c1 <Fire> -> Fire", "c2 <Fire> -> Fire"]
    downstream = P.tagged_links(edges(spark, "c1 <Fire> -> c2 <Fire>", "c2 <Fire> -> X"), hazards(spark, "Fire"))
    assert lines(downstream) == ["c2 <Fire> -> Fire"]
    cyclic = P.tagged_links(edges(spark, "c1 <Fire> -> c2 <Fire>", "c2 <Fire> -> c1 <Fire>", "c2 <Fire> -> X"), hazards(spark, "Fire"))
    assert lines(cyclic) == ["c2 <Fire> -> Fire"]


def test_renumbering_counts_every_end(spark):
    assert lines(P.renumbered(edges(spark, "EO release 1 -> Toxicity dispersion 1"), hazards(spark, "EO release", "Toxicity dispersion"))) == ["EO release -> Toxicity dispersion"]
    twice = ["A -> Fire 1", "B -> Fire 1", "C -> D <Jet 2>"]
    assert lines(P.renumbered(edges(spark, *twice), hazards(spark, "Fire", "Jet"))) == ["A -> Fire 1", "B -> Fire 1", "C -> D <Jet>"]


def test_chain_and_empty(spark):
    clean, removed = P.clean_up(edges(spark, "A -> B", "B -> C", "A -> C", "C -> A"), hazards(spark, "C"))
    # shortcuts are judged on the whole graph; then the hazard's edge to its ancestor goes
    assert lines(clean) == ["A -> B", "B -> C"]
    assert sorted((r.stage, f"{r.src} -> {r.dst}") for r in removed.collect()) == [("hazard_upstream", "C -> A"), ("shortcut", "A -> C")]
    assert P.clean_up(edges(spark, "A -> B").limit(0), hazards(spark, "C"))[0].count() == 0


def test_arrow_text(spark):
    df = spark.createDataFrame([(1, "1. A → B\n(2) A -> B\n- B — > C\nno arrow\n -> D\nA ⇒ B <x>", 3), (2, None, 3), (3, "", 3)], "id long, body string, pos int")
    assert sorted(tuple(r)[1:] for r in text.arrow_edges(df.drop("pos"), "id", "body").collect()) == [(0, "A", "B"), (5, "A", "B <x>")]
    row = df.select(text.iso_date(F.lit("2/9/2020")), text.iso_date(F.lit("2020-13-09")), text.first_tag(F.lit("a <b> <c>")), text.hazard_base(F.lit(" Fire 12 ")), text.slug(F.lit("A -- b!"))).first()
    assert tuple(row) == ("2020-02-09", None, "b", "Fire", "a-b")
