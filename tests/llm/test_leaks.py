import random

import numpy as np

from causeway.llm import leaks

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprstv" for b in "aeiou" for c in ("n", "r", "x", "lom", "tik")]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def build(rng):
    stock = "all times are local and all pressures are gauge pressures unless the table or the figure in question says otherwise".split()
    items = {k: [f"zq{k}{w}" if rng.random() < 0.25 else w for w in passage(rng, 80)] for k in range(1, 31)}
    for k in (1, 2, 3, 4):
        items[k] = items[k][:40] + stock + items[k][40:]
    docs, truth = {}, set()
    for d in range(300):
        words = passage(rng, rng.randint(0, 90))
        if d % 5 == 0:
            words += stock
        if d % 10 == 3:
            k = d // 10 % 30 + 1
            start = rng.randint(0, 15)
            cut = items[k][start : start + rng.randint(23, 25)]
            cut[11] = cut[11][:-1] + "q"
            words[:0] = cut
            truth.add((d, k))
        if d % 10 == 7:
            k = d // 10 % 30 + 1
            words[:0] = items[k][5:15]
        docs[d] = " ".join(words)
    return items, docs, truth


def test_against_planted_passages(spark):
    items, docs, truth = build(random.Random(3))
    layout = {d: t.replace(" ", " \n", 3).upper() if d % 2 else t.replace(" ", " ", 2) for d, t in docs.items()}
    rows = [(d, t, "x", 0) for d, t in layout.items()] + [(900, None, "x", 0), (901, "", "x", 0), (902, "12 ... --", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string, docs int")
    its = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(50, None), (51, "too short"), (1, " ".join(items[1]))], "item_id long, text string")
    assert sorted(tuple(r) for r in leaks.leaks(df, its).collect()) == sorted(truth)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def brute_force(items, docs, misses):
    """Every window of every item against every place of every document, so many misses allowed at any place."""
    found = set()
    for k, item in items.items():
        windows = [item[s : s + 20] for s in range(max(1, len(item) - 19))]
        for d, words in docs.items():
            places = [words[s : s + 20] for s in range(max(1, len(words) - 19))]
            if any(sum(a == b for a, b in zip(w, p, strict=False)) >= len(w) - misses for w in windows for p in places):
                found.add((d, k))
    return found


def test_nothing_is_lost_before_the_windows(spark):
    """Passages of exactly twenty words with one other word anywhere, against brute force."""
    rng = random.Random(11)
    items = {k: passage(rng, 40) for k in range(1, 13)}
    docs = {}
    for d in range(240):
        cut = items[d % 12 + 1][(s := rng.randint(0, 20)) : s + 20]
        for _ in range(d % 4 - 1):
            cut[rng.randint(0, 19)] = "zz" + rng.choice(WORDS)
        docs[d] = passage(rng, rng.randint(0, 40)) + cut + passage(rng, rng.randint(0, 9))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    its = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    expected, found = brute_force(items, docs, 1), {tuple(r) for r in leaks.leaks(df, its).collect()}
    assert len(expected) > 150 and expected <= found <= brute_force(items, docs, 3)


def test_widely_leaked_and_shared_items(spark):
    """An item in 2 % of the documents, two items of one text in one document, and a lone pair: eleven pairs."""
    rng = random.Random(5)
    items = {1: passage(rng, 60), 2: passage(rng, 60), 4: passage(rng, 60)}
    items[3] = items[2]
    docs = {d: passage(rng, 80) for d in range(400)}
    for d in range(8):
        docs[d * 40][10:10] = items[1][5:35]
    docs[7][20:20], docs[9][0:0] = items[2][:40], items[4][20:50]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    its = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert {tuple(r) for r in leaks.leaks(df, its).collect()} == {*((d * 40, 1) for d in range(8)), (7, 2), (7, 3), (9, 4)}


def test_contained():
    item, no, once = np.arange(100, 130), np.zeros(30, bool), np.ones(26)
    words = np.concatenate([np.arange(7), item[4:24], np.arange(9)])
    assert leaks.contained(item, no, once, words, 3, 0) and leaks.contained(item, no, once, words, 0, 3) and not leaks.contained(item, no, once, words, 0, 2)
    words[[13, 20]] = 1
    assert leaks.contained(item, no, once, words, 3, 8)
    # the same with the item's own words missing: what is left stands in many other texts
    assert not leaks.contained(item, no, np.where(np.isin(np.arange(26), (4, 11, 18, 19)), 90, 1), np.where(np.isin(words, item[[4, 5, 6, 7, 8, 11]]), words, 1), 3, 8)
    many = np.where(np.abs(np.arange(26) - 8) < 3, 1, 90)
    assert not leaks.contained(item, no, many, words, 3, 8)
    words[9] = 1
    assert not leaks.contained(item, no, once, words, 3, 8)
    assert not leaks.contained(item, np.arange(30) > 10, once, np.concatenate([np.arange(7), item]), 7, 8)
    assert not leaks.contained(item[:4], no[:4], once[:0], item[:4], 0, 8) and leaks.contained(item[:9], no[:9], once[:5], item[:9], 0, 8)
    assert not leaks.contained(item, no, once, words[:0], 3, 8)


def test_copies_and_equal_items_leak(spark):
    """A passage in a third of all documents, and one that several items share, are leaks; stock wording isn't."""
    rng = random.Random(7)
    items, docs, truth = build(rng)
    items[41], items[42] = items[11], items[12][20:] + passage(rng, 30)
    truth |= {(d, 41) for d, k in truth if k == 11}
    for d in range(1000, 1150):
        part = items[20][30:60] if d % 2 else items[20][10:70]
        docs[d] = " ".join(passage(rng, 5) + [w if rng.random() > 0.03 else "noise" for w in part] + passage(rng, 5))
        truth.add((d, 20))
    for d in range(1150, 1160):
        docs[d] = " ".join(passage(rng, 5) + items[12][40:70])
        truth |= {(d, 12), (d, 42)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    its = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {tuple(r) for r in leaks.leaks(df, its).collect()}
    assert found - {(d, 42) for d, k in truth if k == 12} == truth - {(d, 42) for d, k in truth if k == 12}
    assert {(d, 42) for d in range(1150, 1160)} <= found
