import os
import random

import pytest

from causeway.llm import tokens

JSON = os.path.join(os.path.dirname(tokens.VOCABULARY), "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_agree_with_the_library(spark, reference):
    rng = random.Random(2)
    pieces = ["the ", "valve", " aaaa", "'s", " 12", "é", "ж", "😀", "\n\n", "\t", "  ", "<|endoftext|>", "　", "abab", "\x00"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "x" * 3000, "ab" * 2000]
    df = spark.createDataFrame([(k, t, [0]) for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    found = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    assert found == {k: reference(t) if t else [] for k, t in enumerate(texts)}


def test_tables_and_other_batches(spark, reference):
    df = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    assert [r.ids for r in tokens.encode(df, "doc_id", "text").collect()] == [reference("same text")] * 2
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert tokens.merge_words(["aaaaa"])["aaaaa"] == tokens.merge_words(["b", "aaaaa", "aaa"])["aaaaa"] == reference("aaaaa")
