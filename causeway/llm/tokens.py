"""Token ids of a corpus by a public byte-pair vocabulary.

Texts are cut into words by the vocabulary's pattern. The words of the whole corpus are counted, and the distinct ones are
merged together by replay: an index from pairs of tokens to word positions is kept, and every merge of the vocabulary is
applied to all its positions at once, in rank order, touching only the neighbours. A merge's token can only take part in
merges of a later rank, so one pass over the ranks is complete. The ids of a word don't depend on other words, so the words
are replayed in hash ranges, one a task.

Documents then gather the ids of their words where they lie. The table of merged words that goes to all tasks holds the
``TABLE_WORDS`` most frequent; the words beyond, each in few texts, are replayed together by the task that meets them, so the
corpus isn't shuffled.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts texts into words for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of the table that every task gets, and the words beyond it that a task remembers before it forgets them.
TABLE_WORDS, WORDS_KEPT = 100_000, 200_000


@lru_cache
def load_ranks(vocabulary: bytes) -> tuple[dict[bytes, int], dict[int, bytes]]:
    """Token to id and id to token of lines of base64 token and id."""
    pairs = (line.split() for line in vocabulary.splitlines() if line.strip())
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return ranks, {rank: token for token, rank in ranks.items()}


def merge_words(words: Iterable[str], vocabulary: bytes | None = None) -> dict[str, list[int]]:
    """The ids of each word, by replay of all merges over all words; by the vocabulary's file where none is given."""
    ranks, tokens = load_ranks(Path(VOCABULARY).read_bytes() if vocabulary is None else vocabulary)
    words = list(dict.fromkeys(words))
    token: list[int] = []
    after: list[int] = []
    before: list[int] = []
    first: list[int] = []
    for word in words:
        raw = word.encode("utf-8")
        start = len(token)
        first.append(start)
        token += [ranks[raw[i : i + 1]] for i in range(len(raw))]
        after += [*range(start + 1, start + len(raw)), -1]
        before += [-1, *range(start, start + len(raw) - 1)]

    where: dict[int, list[int]] = defaultdict(list)
    known: dict[tuple[int, int], int] = {}
    queue: list[int] = []

    def note(at: int) -> None:
        pair = token[at], token[after[at]]
        merged = known.get(pair)
        if merged is None:
            merged = known[pair] = ranks.get(tokens[pair[0]] + tokens[pair[1]], -1)
        if merged >= 0:
            places = where[merged]
            if not places:
                heappush(queue, merged)
            places.append(at)

    for at in range(len(token)):
        if after[at] >= 0:
            note(at)
    heapify(queue)
    while queue:
        new = heappop(queue)
        spelled = tokens[new]
        for at in sorted(set(where.pop(new))):
            to = after[at]
            # an earlier merge may have taken either side; the spelling decides
            if token[at] < 0 or to < 0 or tokens[token[at]] + tokens[token[to]] != spelled:
                continue
            token[at], token[to] = new, -1
            after[at] = after[to]
            if after[to] >= 0:
                before[after[to]] = at
                note(at)
            if before[at] >= 0:
                note(before[at])
    out = {}
    for word, start in zip(words, first, strict=True):
        ids, at = [], start
        while at >= 0:
            ids.append(token[at])
            at = after[at]
        out[word] = ids
    return out


def corpus_words(texts: DataFrame) -> DataFrame:
    """word, n: the distinct words of the texts (one column) and how often they stand in them, counted by batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(PATTERN).findall
        for batch in batches:
            counted = Counter(chain.from_iterable(cut(text) for text in batch.column(0).to_pylist() if text))
            yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(words: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """word, ids: the words merged in hash ranges, each range by one replay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = merge_words(batch.column(0).to_pylist(), vocabulary.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.string()), pa.array(list(merged.values()), pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").repartition("word").mapInArrow(run, "word string, ids array<int>")


def encode(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ids, a list of int: one row for each row, of the text exactly as stored, without special tokens.

    Null and empty texts have the empty list; blank texts are encoded like any other. Other columns aren't read.
    ``path`` is a vocabulary file on the driver; it goes to the tasks with the job.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    sc = df.sparkSession.sparkContext
    vocabulary = sc.broadcast(Path(path).read_bytes())
    frequent = corpus_words(df.select(text_col)).orderBy(F.desc("n"), "word").limit(TABLE_WORDS)
    # bounded by TABLE_WORDS
    table = sc.broadcast({r.word: r.ids for r in word_table(frequent, vocabulary).toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(PATTERN).findall
        known = table.value
        of: dict[str, list[int]] = {}
        for batch in batches:
            texts = [cut(text) if text else [] for text in batch.column(1).to_pylist()]
            if len(of) > WORDS_KEPT:
                of.clear()
            of.update(merge_words({w for words in texts for w in words if w not in known and w not in of}, vocabulary.value))
            ids = [list(chain.from_iterable(known[w] if w in known else of[w] for w in words)) for words in texts]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
