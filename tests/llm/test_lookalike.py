import random
import unicodedata

import pyarrow as pa

from causeway.llm.lookalike import LOOKALIKES, SLICE, alike_pairs, fold


def one(text):
    return fold(pa.array([text])).to_pylist()[0]


def test_composition_agrees_with_the_standard():
    rng = random.Random(1)
    ranges = [range(32, 127), range(0xC0, 0x250), range(0x300, 0x340), range(0x1E00, 0x1F00), range(0xAC00, 0xAC40), range(0x1100, 0x1110), range(0x1161, 0x1170), range(0x11A8, 0x11B0)]
    letters = [chr(c) for r in ranges for c in r]
    letters = [c for c in letters if not unicodedata.decomposition(c).startswith("<") and c not in LOOKALIKES and "<" not in unicodedata.decomposition(unicodedata.decomposition(c)[:0] or c)]
    letters = [c for c in letters if all(not unicodedata.decomposition(x).startswith("<") for x in unicodedata.normalize("NFD", c))]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    assert fold(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_forms():
    assert one("ｊｅｔ　ﬁｒｅ") == one("jet ﬁre") == one("j​еt fire") == "jet fire"
    assert one("café") == "café" != one("cafe")
    assert one("A") != one("a") and one("x²") != one("x2")
    assert one("TK‑1") == one("TK－1") == "TK-1" and one("a\tb c") == "a b c"
    assert fold(pa.array([None, "", "​", "a"])).to_pylist() == [None, "", "", "a"]
    assert fold(pa.array([], pa.string())).to_pylist() == [] and fold(pa.array([None], pa.string())).to_pylist() == [None]
    assert fold(pa.array(["x", "ａ", "b", None])[1:3]).to_pylist() == ["a", "b"]


def test_long_texts_and_slices():
    texts = ["é" * (SLICE + 7), "", "é", None, "a" * 3] * 2
    assert fold(pa.array(texts)).to_pylist() == ["é" * (SLICE + 7), "", "é", None, "aaa"] * 2


def test_pairs(spark):
    rows = [
        (1, 1, "jet fire", "Label", "x"), (2, 1, "j​et fire", "Label", "x"), (3, 1, "ｊet fire", "Lаbel", "x"), (4, 2, "j​et fire", None, "x"),
        (5, 1, "Jet fire", None, "x"), (6, 1, None, None, "x"), (1, 1, "jet fire", "Label", "x"), (7, None, "jet fire", "", "x"), (8, 1, "", "", "x"), (9, 1, "​", "", "x"),
    ]
    df = spark.createDataFrame(rows, "node_row_id long, graph_id long, name string, label string, form string")
    expected = {(1, 2, "name"), (1, 3, "name"), (2, 3, "name"), (1, 3, "label"), (2, 3, "label"), (8, 9, "name")}
    found = [tuple(r) for r in alike_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert alike_pairs(df.limit(0)).count() == 0


def test_compatible_ideographs_beyond_two_planes():
    import unicodedata

    import pyarrow as pa

    from causeway.llm.lookalike import fold

    rare = [chr(cp) for cp in range(0x2F800, 0x2FA1E)]
    assert fold(pa.array(rare)).to_pylist() == [unicodedata.normalize("NFC", c) for c in rare]
