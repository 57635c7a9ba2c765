"""Freely entered values to the entries of a reference list.

The list's terms and other wordings, each also with its words in other orders, are the paths of a trie without blanks. A
value in one form is searched in it by a Levenshtein automaton (insertions, deletions, substitutions and swaps of
neighbours), whose states are the rows of the distance table, for all paths within a distance that depends on their
length. Values that say more than a path (qualifiers, other word order, other forms of a word) are searched word by word
in a second trie of the list's words, and for paths anywhere within them in a third; a path is meant if all its words are
there, the longest such path wins. Words of a value that no entry has say nothing.

Each distinct value is searched once: the distinct values are pre-aggregated, spread over the cluster and joined back,
by broadcast only if they are few. The list is taken in parts of at most ``LIST_ROWS`` entries, each a trie in a task's
memory; the parts' findings are put together by join and group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.lookalike import fold
from causeway.session import broadcast_if_small, durable

# English words without a meaning of their own.
GLUE = {"of", "a", "an", "the", "in", "on", "from", "to", "and", "by"}
#: Entries of the reference list that a task holds at once.
LIST_ROWS = 50_000
#: Letters of a word's beginning, or of a path within a longer value, that are enough to mean it.
BEGINNING = 7
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_DOTTED = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}\p{N}]{1,2}\.+){2,}[\p{L}\p{N}]?")


def reach(length: int) -> int:
    """The distance within which a path of this length is found."""
    return 0 if length < 3 else 1 if length < 5 else 2 if length < 11 else 3


def word_reach(length: int) -> int:
    """The distance within which a single word of this length is found."""
    return 0 if length < 4 else 1 if length < 6 else 2


class Trie:
    """Strings with payloads, searched within a distance."""

    def __init__(self, within=reach):
        self.root: dict = {}
        self.within = within

    def add(self, text: str, payload: object) -> None:
        node = self.root
        for c in text:
            node = node.setdefault(c, {})
        node.setdefault("", (len(text), {}))[1][payload] = text

    def _walk(self, text: str, first: list[int], most: int) -> Iterator[tuple[dict, int, list[int]]]:
        """Nodes with their depth and row of distances, for start row ``first``, that can still lead within ``most``."""
        n = len(text)
        stack: list[tuple[dict, str, list[int], list[int] | None, int]] = [(self.root, "", first, None, 0)]
        while stack:
            node, last, row, above, depth = stack.pop()
            yield node, depth, row
            for c, below in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (text[j - 1] != c))
                    if above is not None and j > 1 and text[j - 1] == last and text[j - 2] == c:
                        d = min(d, above[j - 2] + 1)
                    new.append(d)
                if min(new) <= most or min(row) <= most - 1:
                    stack.append((below, c, new, row, depth + 1))

    def search(self, text: str) -> list[tuple[int, int, object]]:
        """(distance, length of the path, payload) of every path within its distance of the text."""
        n = len(text)
        most = max(self.within(n + k) for k in range(4))
        found: list[tuple[int, int, object]] = []
        for node, _, row in self._walk(text, list(range(n + 1)), most):
            end = node.get("")
            if end and row[n] <= self.within(end[0]):
                found += [(row[n], end[0], payload) for payload in end[1]]
        return found

    def inside(self, text: str) -> list[tuple[int, int, object]]:
        """(distance, length of the path, payload) of every path within its distance of some part of the text."""
        most = max(self.within(len(text) + k) for k in range(3))
        found: list[tuple[int, int, object]] = []
        for node, _, row in self._walk(text, [0] * (len(text) + 1), most):
            end = node.get("")
            if end and end[0] <= len(text) + 2 and min(row) <= self.within(end[0]):
                found += [(min(row), end[0], payload) for payload in end[1]]
        return found

    def begun(self, text: str) -> set[object]:
        """Payloads of the paths with a beginning of ``BEGINNING`` letters or more that differs from the text by one letter at most, or with which the text begins."""
        found: set[object] = set()
        for node, depth, row in self._walk(text, list(range(len(text) + 1)), 1):
            if depth >= BEGINNING and row[-1] <= 1:
                below = [node]
                while below:
                    at = below.pop()
                    found.update(at[""][1] if "" in at else ())
                    below += [x for c, x in at.items() if c]
        node = self.root
        for depth, c in enumerate(text, 1):
            node = node.get(c)
            if node is None:
                break
            if depth >= BEGINNING and "" in node:
                found.update(node[""][1])
        return found


def words_in(text: str) -> list[str]:
    """The words of a value in one form, lower case; letters with dots between them are one word, bare numbers none."""
    text = _DOTTED.sub(lambda m: m.group().replace(".", "") + " ", text)
    return [w for w in _WORD.findall(_CAMEL.sub(" ", text).lower()) if not w.isdecimal()]


def inner_reach(length: int) -> int:
    """The distance within which a path of this length is found inside a longer value; none for short ones."""
    return -1 if length < BEGINNING else 1 if length < 12 else 2


class Mapper:
    """The search structures of one reference list of (entry id, wordings)."""

    def __init__(self, entries: list[tuple[int, list[str]]]):
        self.whole, self.words, self.cores = Trie(reach), Trie(word_reach), Trie(inner_reach)
        self.paths: list[tuple[int, tuple[str, ...]]] = []
        self.with_word: dict[str, set[int]] = {}
        whole: set[str] = set()
        for entry, wordings in sorted(entries):
            for wording in wordings:
                words = words_in(wording)
                core = tuple(w for w in words if w not in GLUE) or tuple(words)
                if not core:
                    continue
                for word in core:
                    self.words.add(word, word)
                    self.with_word.setdefault(word, set()).add(len(self.paths))
                self.cores.add("".join(core), len(self.paths))
                self.paths.append((entry, core))
                orders = [tuple(words), *(permutations(core) if len(core) <= 3 else [core])]
                for order in orders:
                    self.whole.add("".join(order), entry)
                    whole.add("".join(order))
        self.lone = self.with_word.keys() - whole

    def find_all(self, value: str) -> list[tuple[int, bool, int, int]]:
        """(entry, whether by the whole value, score, distance) of every entry that a value in one form may mean.

        Of whole values the least score is best, a distance; of values word by word the greatest, the letters of the path
        that are there. Values that one entry is nearest to aren't searched word by word.
        """
        words = words_in(value)
        if not words:
            return []
        hits: dict[int, int] = {}
        for core in {"".join(words), "".join(w for w in words if w not in GLUE)} - self.lone - {""}:
            for ending in {core, core[:-1] if core.endswith("s") and len(core) > 3 else core}:
                for d, _, entry in self.whole.search(ending):
                    away = d + (ending != core)
                    hits[entry] = min(away, hits.get(entry, away))
        found = [(entry, True, d, d) for entry, d in hits.items()]
        least = min(hits.values(), default=0)
        if hits and (least == 0 or sum(d == least for d in hits.values()) == 1):
            return found
        return found + self._by_words(words)

    def _by_words(self, words: list[str]) -> list[tuple[int, bool, int, int]]:
        """The entries with a path all whose words are in the value, near enough, or that stands somewhere within it."""
        near: dict[str, int] = {}
        for unit in [*words, *(a + b for a, b in zip(words, words[1:], strict=False))]:
            matches = [(0, len(unit), unit)] if unit in self.with_word else self.words.search(unit)
            if unit.endswith("s") and not matches:
                matches = self.words.search(unit[:-1])
            if not matches and len(unit) >= BEGINNING:
                matches = [(1, len(w), w) for w in self.words.begun(unit) if len(w) >= BEGINNING]
            for d, _, word in matches:
                near[word] = min(d, near.get(word, 9))
        found: dict[int, tuple[int, int]] = {}

        def note(entry: int, size: int, away: int) -> None:
            found[entry] = max((size - 2 * away, -away), found.get(entry, (0, 0)))

        for k in set().union(*(self.with_word[w] for w in near)):
            entry, core = self.paths[k]
            if all(w in near for w in core):
                note(entry, sum(map(len, core)), sum(near[w] for w in core))
        best = max(found.values(), default=(0, 0))[0]
        for away, size, k in self.cores.inside("".join(words)):
            if size > best:
                note(self.paths[k][0], size, away)
        return [(entry, False, score, -away) for entry, (score, away) in found.items() if score > 0]

    def find(self, value: str) -> int:
        """The entry that a value in one form means, or 0."""
        return chosen(self.find_all(value))


def chosen(found: list[tuple[int, bool, int, int]]) -> int:
    """The entry meant: the one nearest to the whole value, else the longest path word by word, else 0; ties give the least id."""
    whole = sorted((score, entry) for entry, by_whole, score, _ in found if by_whole)
    if whole and (whole[0][0] == 0 or len(whole) == 1 or whole[0][0] < whole[1][0]):
        return whole[0][1]
    return -max(((score, -away, -entry) for entry, by_whole, score, away in found if not by_whole), default=(0, 0, 0))[2]


def searched(values: DataFrame, terms: DataFrame) -> DataFrame:
    """field_name, value, term_id, whole, score, distance: every entry that each value (field_name, value, distinct) may mean.

    One pass over the values for each ``LIST_ROWS`` entries of the list.
    """
    listed = terms.where("term is not null and term_id is not null").select("term_id", "field_name", "term", "also_known").distinct()
    parts = max(1, -(-listed.count() // LIST_ROWS))
    listed = durable(listed.withColumn("part", F.pmod(F.xxhash64("term_id"), F.lit(parts))))

    def search(rows: list) -> DataFrame:
        lists: dict[str, list[tuple[int, list[str]]]] = {}
        for r in rows:
            lists.setdefault(r.field_name, []).append((r.term_id, [r.term, *(r.also_known or "").split(";")]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mappers = {f: Mapper(entries) for f, entries in lists.items()}
            for batch in batches:
                forms = fold(batch.column(1)).to_pylist()
                found = [mappers[f].find_all(form) if f in mappers else [] for f, form in zip(batch.column(0).to_pylist(), forms, strict=True)]
                of = pa.array([i for i, hits in enumerate(found) for _ in hits], pa.int64())
                flat = [h for hits in found for h in hits]
                columns = [pa.array([h[k] for h in flat], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *columns], names=["field_name", "value", "term_id", "whole", "score", "distance"])

        return values.mapInArrow(run, "field_name string, value string, term_id long, whole boolean, score long, distance long")

    # a part holds about LIST_ROWS entries, whatever the list's length
    return reduce(DataFrame.unionByName, (search(listed.where(F.col("part") == k).collect()) for k in range(parts)))


def _cases(values: DataFrame, terms: DataFrame, id_col: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The values of the fields that are to be mapped, with their id, and the distinct ones spread over the cluster."""
    stacked = ", ".join(f"'{f}', `{f}`" for f in fields)
    long = values.select(id_col, F.expr(f"stack({len(fields)}, {stacked}) as (field_name, value)"))
    exact = terms.where("term is not null").select("field_name", F.col("term").alias("value")).distinct()
    written = long.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"(?U)^\s*$"))
    cases = written.join(broadcast_if_small(exact), ["field_name", "value"], "left_anti")
    tasks = values.sparkSession.sparkContext.defaultParallelism
    return cases, cases.select("field_name", "value").distinct().repartition(tasks, "field_name", "value")


def candidates(values: DataFrame, terms: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Every entry that a distinct value may mean: field_name, value, term_id, distance, rank, the entry meant first.

    The same cases as ``map_values``; a value that means none of the entries has no row.
    """
    _, distinct = _cases(values, terms, id_col, fields)
    found = durable(searched(distinct, terms))
    best = F.struct(F.col("whole").cast("int"), F.when(F.col("whole"), -F.col("score")).otherwise(F.col("score")), -F.col("distance"), -F.col("term_id"))
    one = found.groupBy("field_name", "value", "term_id").agg(F.max(best).alias("best"), F.min("distance").alias("distance"))
    meant = _meant(found).withColumnRenamed("term_id", "meant")
    order = Window.partitionBy("field_name", "value").orderBy((F.col("term_id") == F.col("meant")).desc_nulls_last(), F.desc("best"))
    ranked = one.join(meant, ["field_name", "value"], "left").withColumn("rank", F.row_number().over(order))
    return ranked.select("field_name", "value", "term_id", "distance", "rank")


def _meant(found: DataFrame) -> DataFrame:
    """field_name, value, term_id of the entry meant, as ``chosen`` has it, over all parts of the list."""
    whole, by_words = F.col("whole"), ~F.col("whole")
    one = found.groupBy("field_name", "value", "term_id").agg(F.min(F.when(whole, F.col("score"))).alias("away"), F.max(F.when(by_words, F.struct("score", -F.col("distance"), -F.col("term_id")))).alias("words"))
    both = one.groupBy("field_name", "value").agg(F.min(F.when(F.col("away").isNotNull(), F.struct("away", "term_id"))).alias("least"), F.sort_array(F.collect_list("away")).alias("all"), F.max_by("term_id", "words").alias("by_words"))
    sure = (F.col("least.away") == 0) | (F.size("all") == 1) | (F.get("all", F.lit(0)) < F.get("all", F.lit(1)))
    return both.select("field_name", "value", F.when(sure, F.col("least.term_id")).otherwise(F.col("by_words")).alias("term_id"))


def map_values(values: DataFrame, terms: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``id_col``, field_name, term_id for every value of the fields that isn't null, blank or a term letter for letter.

    ``terms`` has term_id, field_name, term, also_known (wordings parted by semicolons, or null). term_id is the entry that
    is meant, 0 if none. Values that could mean several entries alike get the least id of those they hold word by word, else
    0; ``candidates`` has all. Repeated rows count once. Without terms of a field every value of it gets 0.
    """
    cases, distinct = _cases(values, terms, id_col, fields)
    mapped = durable(_meant(searched(distinct, terms)).where("term_id is not null"))
    return cases.join(broadcast_if_small(mapped), ["field_name", "value"], "left").select(id_col, "field_name", F.coalesce("term_id", F.lit(0).cast("long")).alias("term_id")).distinct()
