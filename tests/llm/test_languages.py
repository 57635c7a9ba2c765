import os

import pyarrow as pa
import pytest

from causeway.llm import languages as L

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def machine(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return L.train(L.labelled_sample(docs.where("doc_id % 3 <> 0"))), docs.where("doc_id % 3 = 0")


def test_held_out_accuracy(machine):
    trained, held = machine
    rows = [(r.text, r.lang) for r in held.where("text is not null").collect() if r.lang in L.LANGUAGES]
    found = L.segments_of(L.fold_lines(pa.array([t for t, _ in rows])), trained)
    named = [(s[0][1], lang) for s, (_, lang) in zip(found, rows, strict=True) if s]
    # about a tenth of the labels are wrong by design
    assert sum(a == b for a, b in named) / len(named) > 0.85
    assert {a for a, _ in named} == set(L.LANGUAGES)


def test_mixed_text_in_reading_order(machine):
    trained, _ = machine
    text = "The relief valve had been replaced without review. La pression relevée a atteint 8 bars sans que personne n'intervienne.\nПожарные охлаждали ёмкость ещё 13 часов. / The cloud drifted over the road (détonation) again."
    (found,) = L.segments_of(L.fold_lines(pa.array([text])), trained)
    assert [(s[0], s[1]) for s in found[1:]] == [(1, "en"), (2, "fr"), (3, "ru"), (4, "en")]
    assert found[0][1] == "en" and all(0 <= s[2] <= 1 for s in found)


def test_labels(spark):
    labels = ["en", "EN", "en-GB", "eng", " English ", "Deutsch", "ger", "français", "pt_BR", "русский", "und", "", None, "xx", "unknown", "enx"]
    df = spark.createDataFrame([(x,) for x in labels], "l string").select(L.named_language("l").alias("c"))
    assert [r.c for r in df.collect()] == ["en", "en", "en", "en", "en", "de", "de", "fr", "pt", "ru", None, None, None, None, None, None]


def test_cases(spark):
    rows = [(1, "en", ["en", "en"]), (2, None, ["fr", "fr"]), (3, "de", ["en", "en", "de"]), (4, "ru", [])]
    rows = [(i, named, [(k, lang, 0.9, 0, 5) for k, lang in enumerate(langs)]) for i, named, langs in rows]
    df = spark.createDataFrame(rows, f"doc_id long, named string, segments array<struct<{L.SEGMENTS}>>")
    assert sorted(tuple(r) for r in L.language_cases(df).collect()) == [(2, 0, "fr"), (3, 0, "en"), (3, 1, "en"), (3, 2, "de")]


def test_copies_are_one_text_of_the_sample(spark):
    """A text that holds most rows enters the sample once, with the label of most of its copies."""
    hot = "the relief valve had been replaced without any review of the change at all, said the report of the board"
    rows = [(k, hot, "en" if k % 10 else "de") for k in range(2000)] + [(5000 + k, f"{hot} {k}", "en") for k in range(50)]
    sample = L.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(sample) == 51 and {lang for _, lang in sample} == {"en"}


def test_planted_stretches(machine):
    """Texts of two held-out documents in a row: both stretches and the main language come out of at least 0.97."""
    trained, held = machine
    rows = [(r.text, r.lang) for r in held.where("length(text) between 150 and 1500").collect() if r.lang in L.LANGUAGES]
    found = L.segments_of(L.fold_lines(pa.array([t for t, _ in rows])), trained)
    plain = [(t, lang) for s, (t, lang) in zip(found, rows, strict=True) if len(s) == 2 and s[0][1] == lang]
    other = [next(p for p in plain[k:] + plain[:k] if p[1] != lang) for k, (_, lang) in enumerate(plain)]
    mixed = [f"{a.strip()}\n{b.strip()}\n{a.strip()}" for (a, _), (b, _) in zip(plain, other, strict=True)]
    made = L.segments_of(L.fold_lines(pa.array(mixed)), trained)
    expected = [[x, y, x] for (_, x), (_, y) in zip(plain, other, strict=True)]
    right = [[x[1] for x in s[1:]] == e for s, e in zip(made, expected, strict=True)]
    assert len(right) > 100 and sum(right) / len(right) >= 0.97


def test_odd_texts_and_empty_tables(spark):
    rows = [(1, "en", "word one. " * 30, 5), (2, None, None, 5), (3, "de", "", 5), (4, "", "12 34 ...", 5), (5, "fr", "x" * 300_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, letters int")
    assert {r.doc_id for r in L.language_segments(df).collect()} <= {1, 5}
    assert L.language_segments(df.limit(0)).count() == 0


def test_sentences():
    text = "1. A first one (about 5.4 bar). 2. Next!\n\n- 3 -\nLast"
    assert [text[a:b].strip() for a, b in L.sentences(text)] == ["1. A first one (about 5.4 bar).", "2. Next!", "- 3 -\nLast"]
