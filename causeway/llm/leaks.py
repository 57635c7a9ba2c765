"""Held-out passages in a corpus: a prefix-filtered join of word shingles in step, then exact containment of windows.

Both sides are brought to one form, lower case, and words. A document carries a passage of an item if it holds a window of
the item, ``WINDOW`` running words, but for ``MISSES`` of them, and at least ``OWN`` of the window's words are no stock wording.
With more misses than one the rest must hold one of the window's rarest shingles: the same kind of event told otherwise has
the phrases and lacks what is only this item's, while a touched-up copy lacks any words.

1. Every shingle of five words of the items is looked up in the corpus, which is read once; the hits are counted by shingle.
2. A shingle that stands in many items and in many documents (``STOCK_ITEMS``, ``STOCK_SHARE``) is common. Items of one text
   count as one here, and so do items that share the wording's surroundings, so a passage that several items have is a leak
   of all of them, however many documents carry it. Stock wording is a run of at least ``STOCK_WORDS`` words of an item
   within common shingles; shorter ones are phrases of which any text is made.
3. Stock words spoil at most one shingle each beyond the first four and misses at most five, so a window with one miss
   shares at least ``SHARED`` of its own shingles, and one of its rarest (the prefix: all but ``SHARED`` - 1 of them in order
   of rarity); a window with more shares ``SHARED_LESS``, and one that is about as rare as its rarest. Hits are grouped by
   document, item and band of their distance in position; bands that have neither are dropped, and no window that is there
   gets lost.
4. The words of an item and of the stretch of the document opposite are compared place by place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.lookalike import SLICE, fold
from causeway.session import broadcast_if_small, durable

#: Words of a shingle, and of the window that must be there; an item with fewer words is one window.
SHINGLE, WINDOW = 5, 20
#: Words of a window that may be missing or others, and how often the rarest shingle left of one with several misses may
#: stand in the corpus against the window's rarest.
MISSES, RAREST = 2, 1.2
#: Words of a window that are no stock wording, at least.
OWN = 13
#: Own shingles that a window keeps at least with one miss, and with ``MISSES``.
SHARED = WINDOW - SHINGLE + 1 - SHINGLE - max(WINDOW - OWN - SHINGLE + 1, 0)
SHARED_LESS = SHARED - (MISSES - 1) * SHINGLE
#: Wording of at least so many items and more than this share of the documents, so many words long, is stock wording.
STOCK_ITEMS, STOCK_SHARE, STOCK_WORDS = 3, 0.001, 10
#: Words to either side at which the surroundings of wording in an item are compared.
AROUND = 2 * WINDOW
#: Hits are taken together in bands of twice this width, each shared by half with the next.
BAND = 8

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id for each word of the texts, one text after another, and where each text starts."""
    known: dict[str, int] = {}
    ids: list[int] = []
    starts = [0]
    for text in fold(texts).to_pylist():
        for word in _WORD.findall(text.lower()) if text else ():
            number = known.get(word)
            if number is None:
                number = known[word] = xxhash.xxh3_64_intdigest(word)
            ids.append(number)
        starts.append(len(ids))
    return np.array(ids, np.uint64), np.array(starts, np.int64)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))


def _sliced(texts: pa.Array, work) -> pa.Array:
    """``work`` on slices of some ``SLICE`` characters each, so that long texts don't pile up."""
    sizes = np.cumsum([len(t) if t else 0 for t in texts.to_pylist()])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(sizes, np.arange(SLICE, sizes[-1] if len(sizes) else 0, SLICE)), [len(texts)]]))
    parts = [work(texts.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


def _words(texts: pa.Array) -> pa.Array:
    return _sliced(texts, lambda part: _lists(*_word_ids(part)))


def _shingles(texts: pa.Array) -> pa.Array:
    def work(part: pa.Array) -> pa.Array:
        ids, starts = _word_ids(part)
        mixed = np.zeros(max(len(ids) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE if len(mixed) else 0):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + ids[k : k + len(mixed)]
        counts = np.maximum(np.diff(starts) - SHINGLE + 1, 0)
        keep = np.repeat(starts[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return _lists(mixed[keep], np.concatenate([[0], np.cumsum(counts)]))

    return _sliced(texts, work)


def words_of(text: Column | str) -> Column:
    """Ids of the words of the text in lower case and one form; null and empty texts have none."""
    return F.arrow_udf(_words, "array<long>")(text)


def shingles_of(text: Column | str) -> Column:
    """Ids of the runs of five words of the text, by position."""
    return F.arrow_udf(_shingles, "array<long>")(text)


def contained(item: np.ndarray, stock: np.ndarray, many: np.ndarray, words: np.ndarray, shift: int, drift: int) -> bool:
    """Whether a window of the item is in the words, each at its place plus ``shift`` give or take ``drift``.

    ``stock`` tells the item's stock words, ``many`` how often each of its shingles stands in the corpus.
    """
    size = min(WINDOW, len(item))
    if size < SHINGLE:
        return False
    width = 2 * drift + 1
    there = np.full(len(item) + width - 1, np.iinfo(np.int64).min)
    first = shift - drift
    low, high = max(first, 0), min(first + len(there), len(words))
    if low >= high:
        return False
    there[low - first : high - first] = words[low:high]
    agree = (np.lib.stride_tricks.sliding_window_view(there, width) == item[:, None]).any(axis=1)
    of_window = [np.cumsum(np.concatenate([[0], x])) for x in (agree, ~stock)]
    agreed, own = (x[size:] - x[:-size] for x in of_window)
    fits = (agreed >= size - MISSES * size // WINDOW) & (own >= OWN * size // WINDOW)
    if not fits.any():
        return False
    whole = np.lib.stride_tricks.sliding_window_view(agree, SHINGLE).all(axis=1)
    left = np.where(whole, many, np.inf)
    least, least_left = (np.lib.stride_tricks.sliding_window_view(x, size - SHINGLE + 1).min(axis=1) for x in (many, left))
    return bool((fits & ((agreed >= size - 1) | (least_left <= RAREST * least))).any())


def _passages(items: pa.Array, stocks: pa.Array, many: pa.Array, words: pa.Array, bands: pa.Array) -> pa.Array:
    rows = zip(items, stocks, many, words, bands.to_pylist(), strict=True)
    found = (contained(*(x.values.to_numpy(zero_copy_only=False) for x in r[:4]), r[4] * BAND + BAND, BAND) for r in rows)
    return pa.array(list(found), pa.bool_())


def common_shingles(of_items: DataFrame, hits: DataFrame, documents: int) -> DataFrame:
    """token of the shingles that stand in many items and many documents. ``of_items`` has text_key, token, before, after.

    Of the items that hold a shingle those with the same shingle ``AROUND`` words before it, or after it, count once: they
    share more than wording.
    """
    one = of_items.select("text_key", "token", "before", "after").distinct()
    beside = [F.count_distinct(side) + F.count_distinct(F.when(F.col(side).isNull(), F.col("text_key"))) for side in ("before", "after")]
    shared = one.groupBy("token").agg(F.least(F.count_distinct("text_key"), *beside).alias("items")).where(F.col("items") >= STOCK_ITEMS).select("token")
    docs = hits.join(broadcast_if_small(durable(shared)), "token", "left_semi").select("token", "doc_id").distinct()
    return docs.groupBy("token").agg(F.count("*").alias("docs")).where(F.col("docs") > STOCK_SHARE * documents).select("token")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item_id of every document that carries a passage of an item, each pair once.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns aren't read. Null, empty and wordless texts
    carry nothing and leak nothing, an item of fewer than five words can't leak. Repeated items count once per id; items
    with the same or an overlapping text each leak. The items' side is broadcast only if it is small (see
    ``broadcast_if_small``), else joined by shuffle, where AQE splits hot shingles.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    items = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    items = durable(items.select("item_id", words_of("text").alias("item_words"), shingles_of("text").alias("tokens")))
    tokens = F.col("tokens")
    nulls = F.array_repeat(F.lit(None).cast("long"), AROUND)
    beside = F.arrays_zip(
        tokens.alias("token"), F.slice(F.concat(nulls, tokens), 1, F.size(tokens)).alias("before"), F.slice(F.concat(tokens, nulls), AROUND + 1, F.size(tokens)).alias("after")
    )
    of_items = items.select("item_id", F.xxhash64("item_words").alias("text_key"), F.posexplode(beside).alias("item_at", "s")).select("item_id", "text_key", "item_at", "s.*")
    of_items = durable(of_items)

    few = broadcast_if_small(durable(of_items.select("token").distinct()))
    hits = durable(docs.select("doc_id", F.posexplode(shingles_of("text")).alias("doc_at", "token")).join(few, "token").select("doc_id", "doc_at", "token"))
    common = durable(common_shingles(of_items, hits, docs.count()))
    many = durable(hits.groupBy("token").agg(F.count("*").alias("many")))

    # positions of stock wording: runs of common shingles, which cover four words more than they are
    at = of_items.join(common, "token", "left_semi").select("item_id", "item_at")
    run = F.col("item_at") - F.row_number().over(Window.partitionBy("item_id").orderBy("item_at"))
    runs = at.withColumn("run", run).groupBy("item_id", "run").agg(F.min("item_at").alias("first"), F.max("item_at").alias("last"))
    runs = durable(runs.where(F.col("last") - F.col("first") + SHINGLE >= STOCK_WORDS))
    stock = runs.select("item_id", F.explode(F.sequence("first", "last")).alias("item_at"))
    own = of_items.select("item_id", "item_at", "token").join(stock, ["item_id", "item_at"], "left_anti").join(many, "token", "left").na.fill(0, ["many"])
    own = durable(own)

    # of each window the prefix, its shingles by rarity but for the last SHARED - 1, and those about as rare as its rarest
    start = F.explode(F.sequence(F.greatest(F.col("item_at") - (WINDOW - SHINGLE), F.lit(0)), F.col("item_at")))
    window = Window.partitionBy("item_id", "start")
    nth = F.row_number().over(window.orderBy("many", "token", "item_at"))
    ranked = own.withColumn("start", start).withColumns({"nth": nth, "size": F.count("*").over(window), "least_many": F.min("many").over(window)})
    prefix = F.bool_or(F.col("nth") <= F.greatest(F.col("size") - (SHARED - 1), F.lit(1))).alias("led")
    marked = ranked.groupBy("item_id", "item_at", "token").agg(prefix, F.bool_or(F.col("many") <= RAREST * F.col("least_many")).alias("rarest"))
    # short items have fewer shingles, of which one miss spoils five
    left = F.greatest(F.size("tokens") - SHINGLE, F.lit(1))
    sizes = items.select("item_id", F.least(F.lit(SHARED), left).alias("least"), F.least(F.lit(SHARED_LESS), left).alias("least_less"))
    marked = durable(marked.join(broadcast_if_small(sizes), "item_id"))

    band = F.floor((F.col("doc_at") - F.col("item_at")) / BAND)
    stretches = (
        hits.join(broadcast_if_small(marked), "token")
        .withColumn("band", F.explode(F.array(band, band - 1)))
        .groupBy("doc_id", "item_id", "band")
        .agg(F.count("*").alias("shared"), *(F.bool_or(c).alias(c) for c in ("led", "rarest")), *(F.min(c).alias(c) for c in ("least", "least_less")))
        .where("shared >= least and led or shared >= least_less and rarest")
        .select("doc_id", "item_id", "band")
    )
    stretches = durable(stretches)

    of_stock = runs.groupBy("item_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    inside = lambda at: F.exists("runs", lambda r: (at >= r["first"]) & (at <= r["last"] + (SHINGLE - 1)))
    flags = F.transform("item_words", lambda _, at: F.coalesce(inside(at), F.lit(False)))
    counts = of_items.join(many, "token", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("item_at", F.coalesce("many", F.lit(0)).alias("many")))).alias("counts"))
    sides = items.join(counts, "item_id").join(of_stock, "item_id", "left")
    sides = durable(sides.select("item_id", "item_words", flags.alias("stock"), F.col("counts.many").alias("many")))
    asked = docs.join(stretches.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words_of("text").alias("words"))
    return (
        stretches.join(broadcast_if_small(sides), "item_id")
        .join(asked, "doc_id")
        .where(F.arrow_udf(_passages, "boolean")("item_words", "stock", "many", "words", "band"))
        .select("doc_id", "item_id")
        .distinct()
    )
