import pytest

from causeway.llm.mapping import Mapper, Trie, map_values

TERMS = [(1, "VCE", "vapour cloud explosion; UVCE"), (2, "BLEVE", None), (3, "Dust explosion", "dust deflagration"), (4, "Confined explosion", "internal explosion"), (5, "Pool fire", "burning pool"), (6, "Jet fire", "torch fire"), (8, "Flash fire", "vapour flash; cloud fire"), (10, "Asphyxiation", "suffocation"), (19, "Vacuum collapse", "implosion")]


@pytest.fixture(scope="module")
def mapper():
    return Mapper([(i, [t, *(a or "").split(";")]) for i, t, a in TERMS])


@pytest.mark.parametrize(
    "value, term",
    [
        ("vce", 1), ("V.C.E.", 1), ("vce (unconfined)", 1), ("unconfined vapour cloud explosion", 1), ("explosion of a vapour cloud", 1), ("B.L.E.V.E. no. 3", 2),
        ("dsut explosion", 3), ("Dustexplosion", 3), ("secondary dust explosion", 3), ("dust cloud explosion", 3), ("confined explosoin hazard", 4),
        ("explosion inside vessel, confined", 4), ("fire, pool", 5), ("fire of a spill pool", 5), ("burning liquid pool", 5), ("type = jet_fire", 6), ("primary: Jet fires", 6),
        ("vapour cloud flash fire", 8), ("flash-fire without overpressure", 8), ("asphyxia", 10), ("nitrogen asphyxiation", 10), ("suffcation", 10), ("implosion", 19),
        ("explosion", 0), ("unknown", 0), ("-", 0), ("12", 0), ("structural collapse", 0), ("forest wildfire", 0), ("fall from height (minor)", 0), ("", 0),
    ],
)
def test_values(mapper, value, term):
    assert mapper.find(value) == term


def distance(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_agrees_with_brute_force():
    import random

    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    trie = Trie()
    for w in words:
        trie.add(w, w)
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 10)))
        assert sorted({(d, w) for d, _, w in trie.search(text)}) == sorted({(distance(text, w), w) for w in words if distance(text, w) <= trie.within(len(w))})


def test_tables(spark):
    rows = [(1, "Jet fire", "Material", 0), (2, "jetfire", " ", 0), (2, "jetfire", " ", 0), (3, None, "matrial", 0), (4, " ", "N/A", 0), (5, "ｊｅｔ fіre", "Jet fire", 0)]
    df = spark.createDataFrame(rows, "choice_id long, name string, label string, term_id int")
    terms = spark.createDataFrame([(6, "name", "Jet fire", "torch fire"), (102, "label", "Material", None), (6, "name", "Jet fire", "torch fire")], "term_id long, field_name string, term string, also_known string")
    expected = [(2, "name", 6), (3, "label", 102), (4, "label", 0), (5, "label", 0), (5, "name", 6)]
    assert sorted(tuple(r) for r in map_values(df, terms, "choice_id", ["name", "label"]).collect()) == expected
    assert map_values(df.limit(0), terms, "choice_id", ["name", "label"]).count() == 0
    assert {r.term_id for r in map_values(df, terms.limit(0), "choice_id", ["name", "label"]).collect()} == {0}


def test_every_entry_within_reach(spark):
    """A tie of two entries: both come out, the one meant first; parts of the list give the same."""
    import causeway.llm.mapping as M

    terms = spark.createDataFrame([(1, "name", "Pool fire", None), (2, "name", "Pool fires", None), (3, "name", "Jet fire", "torch fire")], "term_id long, field_name string, term string, also_known string")
    df = spark.createDataFrame([(1, "pool firex"), (2, "a jet fire and a pool fire"), (3, "fire"), (4, None)], "choice_id long, name string")
    rows = {(r.value, r.term_id): (r.distance, r.rank) for r in M.candidates(df, terms, "choice_id", ["name"]).collect()}
    assert {rows["pool firex", 1][1], rows["pool firex", 2][1]} == {1, 2}
    assert {t for v, t in rows if v == "a jet fire and a pool fire"} == {1, 2, 3} and not any(v == "fire" for v, _ in rows)
    old, M.LIST_ROWS = M.LIST_ROWS, 1
    try:
        parted = {(r.value, r.term_id): r.distance for r in M.candidates(df, terms, "choice_id", ["name"]).collect()}
    finally:
        M.LIST_ROWS = old
    assert parted.keys() == rows.keys()


def test_inside_and_beginnings_agree_with_brute_force():
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(30)]
    trie = Trie(lambda n: 1)
    for w in words:
        trie.add(w, w)
    for _ in range(60):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(9, 14)))
        parts = {text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)}
        assert {w for _, _, w in trie.inside(text)} == {w for w in words if len(w) <= len(text) + 2 and min(distance(p, w) for p in parts) <= 1}
        begun = {w for w in words if any(distance(text, w[:k]) <= 1 for k in range(7, len(w) + 1)) or text.startswith(w)}
        assert trie.begun(text) == begun
