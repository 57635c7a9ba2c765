"""Languages of documents and of their stretches by a string kernel.

The kernel of two sentences is the number of character n-grams they share (presence, lengths blended), normalised. A
bounded sample of labelled sentences gives Nystroem landmarks and the training rows of a one-versus-rest kernel ridge
regression. As the kernel is a dot product of n-gram presences, the trained machine folds into one weight for each
n-gram bucket and language, and a batch of sentences is scored by one product of its presences with that matrix.

Documents are scored where they lie, without a shuffle: a task splits a batch's texts into sentences, scores them all at
once and finds each document's best sequence of languages, where every change of language costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.lookalike import SLICE, fold

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru")
# Writings that name a language, besides its code with a region.
LANGUAGE_NAMES = {
    "en": ["eng", "english", "englisch", "anglais", "inglés", "ingles", "inglês", "engels", "английский"],
    "de": ["deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "alemão", "duits", "немецкий"],
    "fr": ["fra", "fre", "french", "français", "francais", "französisch", "francés", "frances", "francês", "frans", "французский"],
    "es": ["spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "espanhol", "spaans", "испанский"],
    "pt": ["por", "portuguese", "português", "portugues", "portugués", "portugiesisch", "portugais", "portugees", "португальский"],
    "nl": ["nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais", "neerlandés", "holandés", "holandês", "нидерландский"],
    "ru": ["rus", "russian", "русский", "russisch", "russe", "ruso", "russo"],
}
#: Bounds of the training sample: documents and sentences of each language, and landmarks among the sentences.
SAMPLE_DOCS, SAMPLE_SENTENCES, LANDMARKS = 300, 900, 80
GRAMS = (2, 3, 4)
BUCKETS = 1 << 18
RIDGE = 0.3
#: Rounds in which wrongly labelled rows are left out of the training, and the scales tried for the confidence.
CLEANINGS = 4
SCALES = (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0)
#: Letters of a sentence that count at most, letters below which it shows no language, and what a change costs.
FULL_LETTERS, LEAST_LETTERS, CHANGE = 60, 3, 0.25

_BREAK = regex.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|\s*[\r\n\x0b\x0c\x85  ]+\s*|\s+[/|•]\s+|\s+-\s+(?=\p{Lu}|\d)")
_LETTER = regex.compile(r"\p{L}")
_MARKUP = regex.compile(r"<[^<>\s][^<>]*>|&[#\w]+;|https?://\S+")


def named_language(label: Column | str) -> Column:
    """The code of the language that a label names, or null."""
    label = F.col(label) if isinstance(label, str) else label
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    code = F.regexp_extract(plain, r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    named = {lang: lang for lang in LANGUAGES} | {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names}
    known = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, code))


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences and lines of a text; what has no letter joins the sentence after it."""
    cuts, at = [], 0
    for found in _BREAK.finditer(text):
        if _LETTER.search(text, at, found.end()):
            cuts.append((at, found.end()))
            at = found.end()
    if at < len(text):
        if _LETTER.search(text, at):
            cuts.append((at, len(text)))
        elif cuts:
            cuts[-1] = (cuts[-1][0], len(text))
    return cuts


def presences(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct n-grams of each unit: the unit and the bucket; and the letters of each unit."""
    if not units:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = ["" if not u else _MARKUP.sub(" ", u).lower() for u in units]
    points = np.frombuffer((" " + " ".join(plain) + " ").encode("utf-32-le"), np.int32).astype(np.int64)
    unit = np.repeat(np.arange(len(units)), np.array([len(p) + 1 for p in plain], np.int64))
    unit = np.concatenate([unit, unit[-1:]])[: len(points)]
    letter = _is_letter()[points]
    letters = np.bincount(unit[letter], minlength=len(units))
    points = np.where(letter, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points, unit = points[keep], unit[keep]
    keys = []
    code = points.astype(np.uint64)
    rolled = code.copy()
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        if n in GRAMS and len(rolled):
            mixed = rolled ^ (rolled >> np.uint64(29))
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            bucket = (mixed >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
            inside = unit[: len(rolled)] == unit[n - 1 :]
            keys.append((unit[: len(rolled)][inside] * BUCKETS) + bucket[inside])
    found = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    found = found[np.concatenate([np.ones(min(len(found), 1), bool), found[1:] != found[:-1]])]
    return found // BUCKETS, found % BUCKETS, letters


_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[:0x20000] = [chr(c).isalpha() for c in range(0x20000)]
        _LETTERS.append(table)
    return _LETTERS[0]


class Machine:
    """Weights of the n-gram buckets for each language, and the scale that turns scores into confidence."""

    def __init__(self, weights: np.ndarray, scale: float):
        self.weights, self.scale = weights, scale

    def scores(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each unit for each language, and the letters of each unit."""
        unit, bucket, letters = presences(units)
        known = self.weights[bucket]
        sums = np.zeros((len(units), len(LANGUAGES)))
        if len(unit):
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            sums[unit[starts]] = np.add.reduceat(known, starts, axis=0)
        size = np.bincount(unit, minlength=len(units))
        return sums / np.sqrt(np.maximum(size, 1))[:, None], letters

    def confidence(self, scores: np.ndarray) -> np.ndarray:
        odds = np.exp(self.scale * (scores - scores.max(axis=-1, keepdims=True)))
        return odds / odds.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Machine:
    """Fit the machine to (text, language) rows; texts are cut into sentences, each with its text's language."""
    pick = np.random.default_rng(seed)
    texts = fold(pa.array([t for t, _ in rows], pa.string())).to_pylist()
    units: list[str] = []
    target: list[int] = []
    for k, lang in enumerate(LANGUAGES):
        own = [text[a:b] for text, (_, of) in zip(texts, rows, strict=True) if of == lang for a, b in sentences(text) if b - a >= 25]
        for i in pick.permutation(len(own))[:SAMPLE_SENTENCES]:
            units.append(own[i])
            target.append(k)
    weights = np.zeros((BUCKETS, len(LANGUAGES)))
    if not units:
        return Machine(weights, 1.0)
    y = np.array(target)
    marks = np.concatenate([np.flatnonzero(y == k)[:LANDMARKS] for k in range(len(LANGUAGES))])
    unit, bucket, _ = presences(units)
    size = np.sqrt(np.maximum(np.bincount(unit, minlength=len(units)), 1))
    # presences of the landmarks by bucket, then the kernel of every row with every landmark
    at = np.full(len(units), -1)
    at[marks] = np.arange(len(marks))
    of_mark = at[unit] >= 0
    known = np.unique(bucket[of_mark])
    column = np.full(BUCKETS, -1)
    column[known] = np.arange(len(known))
    present = np.zeros((len(known), len(marks)), np.float32)
    present[column[bucket[of_mark]], at[unit[of_mark]]] = 1
    present /= size[marks].astype(np.float32)
    shared = column[bucket] >= 0
    unit, bucket = unit[shared], column[bucket[shared]]
    kernel = np.zeros((len(units), len(marks)))
    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    for s, e in zip(starts, [*starts[1:], len(unit)], strict=True):
        kernel[unit[s]] = present[bucket[s:e]].sum(axis=0) / size[unit[s]]
    values, vectors = np.linalg.eigh(kernel[marks])
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6)))
    features = kernel @ root
    sign = np.where(y[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)

    def fit(use: np.ndarray) -> np.ndarray:
        own = features[use]
        return np.linalg.solve(own.T @ own + RIDGE * np.eye(own.shape[1]), own.T @ sign[use])

    # Labels may be wrong: rows that the other half's machine gives another language are left out, again and again.
    half = pick.random(len(units)) < 0.5
    clean = np.ones(len(units), bool)
    scores = np.zeros(sign.shape)
    for _ in range(CLEANINGS):
        scores[half] = features[half] @ fit(clean & ~half)
        scores[~half] = features[~half] @ fit(clean & half)
        clean = scores.argmax(axis=1) == y
    scale = min(SCALES, key=lambda s: _loss(scores[clean] * s, y[clean]))
    weights[known] = present @ (root @ fit(clean)).astype(np.float32)
    return Machine(weights.astype(np.float32), scale)


def _loss(scores: np.ndarray, y: np.ndarray) -> float:
    if not len(y):
        return 0.0
    top = scores.max(axis=1)
    return float(np.mean(top + np.log(np.exp(scores - top[:, None]).sum(axis=1)) - scores[np.arange(len(y)), y]))


def best_path(evidence: np.ndarray) -> np.ndarray:
    """The sequence of languages with the greatest evidence, less ``CHANGE`` for each change."""
    n, k = evidence.shape
    tops = evidence.argmax(axis=1)
    if (tops == tops[0]).all():
        return tops
    score = evidence[0].copy()
    back = np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(score.argmax())
        stay = score >= score[top] - CHANGE
        back[i] = np.where(stay, np.arange(k), top)
        score = np.where(stay, score, score[top] - CHANGE) + evidence[i]
    path = np.zeros(n, np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


SEGMENTS = "segment_no: bigint, lang: string, confidence: double, start: bigint, letters: bigint"
_SEGMENT_FIELDS = [
    pa.field("segment_no", pa.int64()),
    pa.field("lang", pa.string()),
    pa.field("confidence", pa.float64()),
    pa.field("start", pa.int64()),
    pa.field("letters", pa.int64()),
]


def segments_of(texts: list[str], machine: Machine) -> list[list[tuple]]:
    """For each text its segments: segment_no 0 for the text's main language, then each stretch in reading order.

    start is the stretch's first character in the text's one form; a text without words of a language has no segments.
    """
    out: list[list[tuple]] = []
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= SLICE:
            out += _segments_of(part, machine)
            part, size = [], 0
    return out + _segments_of(part, machine)


def _segments_of(texts: list[str], machine: Machine) -> list[list[tuple]]:
    spans = [sentences(t) for t in texts]
    scores, letters = machine.scores([t[a:b] for t, cut in zip(texts, spans, strict=True) for a, b in cut])
    out: list[list[tuple]] = []
    at = 0
    for cut in spans:
        own, size = scores[at : at + len(cut)], letters[at : at + len(cut)]
        at += len(cut)
        if not len(cut) or size.sum() < LEAST_LETTERS or not np.abs(own).any():
            out.append([])
            continue
        evidence = own * (np.minimum(size, FULL_LETTERS) / FULL_LETTERS)[:, None]
        path = best_path(evidence)
        begins = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        stretches = []
        for n, (s, e) in enumerate(zip(begins, [*begins[1:], len(path)], strict=True), 1):
            weight = np.maximum(size[s:e], 1)[:, None]
            sure = machine.confidence((own[s:e] * weight).sum(axis=0) / weight.sum())[path[s]]
            stretches.append((n, LANGUAGES[path[s]], float(sure), cut[s][0], int(size[s:e].sum())))
        amount: dict[str, int] = {}
        for _, lang, _, _, many in stretches:
            amount[lang] = amount.get(lang, 0) + many
        main = max(amount, key=lambda x: (amount[x], x))
        sure = sum(c * max(m, 1) for _, lang, c, _, m in stretches if lang == main) / sum(max(m, 1) for _, lang, _, _, m in stretches if lang == main)
        out.append([(0, main, sure, 0, int(size.sum())), *stretches])
    return out


def labelled_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """At most ``SAMPLE_DOCS`` (text, language) of each language whose label names it, drawn by a hash of the text."""
    labelled = docs.select("text", named_language("lang").alias("named")).where("named is not null and length(text) >= 80")
    # a group of copies is one text with the label that most of them have, however many rows it holds
    votes = labelled.groupBy(F.xxhash64("text").alias("key"), "named").agg(F.count("*").alias("n"))
    votes = votes.groupBy("key").agg(F.max_by("named", F.struct("n", "named")).alias("named"))
    counts = {r["named"]: r["n"] for r in votes.groupBy("named").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("named") == lang, F.lit(min(1.0, 1.5 * SAMPLE_DOCS / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000)) / 1e6
    order = Window.partitionBy("named").orderBy("draw", "key")
    drawn = votes.withColumn("draw", draw).where(F.col("draw") < share).withColumn("nth", F.row_number().over(order))
    drawn = drawn.where(F.col("nth") <= SAMPLE_DOCS).select("key", "named")
    # the keys are bounded by the sample's size
    texts = docs.select("text", F.xxhash64("text").alias("key")).join(F.broadcast(drawn), "key").groupBy("key", "named").agg(F.min("text").alias("text"))
    return sorted((r["text"], r["named"]) for r in texts.collect())


def scored_documents(docs: DataFrame) -> DataFrame:
    """doc_id, named (the language that the label names, or null) and segments, all those of the document in one list.

    One row for each text that isn't null, scored where it lies; the list is empty for texts without words. The machine is
    trained on a bounded sample of the labelled documents (``SAMPLE_DOCS`` of each language). Without any labelled
    document nothing can be learned, and all lists are empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs)))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = segments_of(fold_lines(batch.column(2)), shared.value)
            flat = [r for rows in found for r in rows]
            items = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], f.type) for i, f in enumerate(_SEGMENT_FIELDS)], fields=_SEGMENT_FIELDS)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "named", "segments"])

    labelled = docs.select("doc_id", named_language("lang").alias("named"), "text").where("text is not null")
    return labelled.mapInArrow(run, f"doc_id {id_type}, named string, segments array<struct<{SEGMENTS}>>")


def language_segments(docs: DataFrame) -> DataFrame:
    """doc_id, named, segment_no, lang, confidence, start, letters: the rows of ``scored_documents``.

    Segment 0 is the document's main language by letters; 1, 2, ... are its stretches in reading order. Null, empty and
    wordless texts give no rows.
    """
    return scored_documents(docs).select("doc_id", "named", F.inline("segments"))


def fold_lines(texts: pa.Array) -> list[str]:
    """The one form of each text with its line breaks kept."""
    kept = pa.array([None if t is None else regex.sub(r"[\r\n\x0b\x0c\x85  ]+", "", t) for t in texts.to_pylist()], pa.string())
    return [t.replace("", "\n") for t in fold(kept).to_pylist()]


def language_cases(scored: DataFrame) -> DataFrame:
    """doc_id, segment_no, lang of wrong or missing labels (segment 0) and of the stretches of mixed documents.

    Takes ``scored_documents``; whether a document is mixed stands in its own row, so the corpus is scored once.
    """
    wrong = (F.col("named").isNull() | (F.col("named") != F.col("s.lang"))) & (F.col("s.segment_no") == 0)
    mixed = (F.col("many") > 2) & (F.col("s.segment_no") > 0)
    rows = scored.select("doc_id", "named", F.size("segments").alias("many"), F.explode("segments").alias("s"))
    return rows.where(wrong | mixed).select("doc_id", "s.segment_no", "s.lang")
