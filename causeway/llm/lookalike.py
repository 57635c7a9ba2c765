"""One form for texts that look alike: code-point tables applied to whole Arrow batches.

A batch's texts become one numpy array of code points. A lookup table gives each code point its replacement, its deletion
or its expansion (a decomposition), expansions shift the offsets, marks are put in canonical order and composed pair by
pair, and the result is written back as one Arrow string array. No step calls a string method per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.session import durable

# Letters of other scripts that are drawn like Latin letters, each with the letter it is drawn like.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v",
    "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "Ү": "Y", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ρ": "p", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U",
    # Latin letters and signs of other uses
    "ɡ": "g", "ɑ": "a", "ı": "i", "ǀ": "l", "ʹ": "'", "ʼ": "'", "’": "'", "‘": "'", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
# Code points without a picture of their own, besides those of category Cf.
_UNSEEN = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]
#: Code points with pictures that decompose: two planes, and the supplement of compatible ideographs.
_TABLED = (range(0x20000), range(0x2F800, 0x2FA20))
#: Bytes that are worked on at once.
SLICE = 1 << 20
_COMPATIBLE = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")
_HANGUL_S, _HANGUL_L, _HANGUL_V, _HANGUL_T = 0xAC00, 0x1100, 0x1161, 0x11A7


def _expansion(cp: int, compatible: bool) -> list[int]:
    """The full decomposition of a code point, its letters then replaced by those they are drawn like."""
    ch = chr(cp)
    like = LOOKALIKES.get(ch)
    if like:
        return [ord(like)]
    parts = unicodedata.decomposition(ch).split()
    if not parts or parts[0].startswith("<") and (not compatible or parts[0] not in _COMPATIBLE or parts[1] == "0020"):
        return [cp]
    return [x for p in parts if not p.startswith("<") for x in _expansion(int(p, 16), compatible)]


@lru_cache
def _tables() -> tuple[np.ndarray, ...]:
    """For each code point: its replacement, -1 to delete, or -2-k for expansion k; then classes, expansions,
    their starts, composable pairs, their compositions, and whether a point may be the second of a pair."""
    table = np.arange(0x110000, dtype=np.int32)
    ccc = np.zeros(0x110000, dtype=np.uint8)
    expansions: list[list[int]] = []
    pairs: dict[int, int] = {}
    for cp in chain(*_TABLED):
        if 0xD800 <= cp < 0xE000 or _HANGUL_S <= cp < _HANGUL_S + 11172:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        ccc[cp] = unicodedata.combining(ch)
        if cp in _UNSEEN or kind == "Cf":
            table[cp] = -1
        elif kind in ("Zs", "Zl", "Zp") or kind == "Cc" and ch in "\t\n\r\x0b\x0c\x85":
            table[cp] = 0x20
        elif kind == "Cc":
            table[cp] = -1
        else:
            full = _expansion(cp, True)
            if len(full) == 1:
                table[cp] = full[0]
            else:
                table[cp] = -2 - len(expansions)
                expansions.append(full)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
    table[0xE0000:0xE1000] = -1
    starts = np.cumsum([0, *map(len, expansions)])
    keys = np.array(sorted(pairs), dtype=np.int64)
    second = np.zeros(0x110000, dtype=bool)
    second[keys & 0x1FFFFF] = True
    second[_HANGUL_V : _HANGUL_T + 28] = True
    return (
        table,
        ccc,
        np.array([x for e in expansions for x in e], dtype=np.int32),
        starts.astype(np.int64),
        keys,
        np.array([pairs[k] for k in keys.tolist()], dtype=np.int32),
        second,
    )


def _composed(first: np.ndarray, second: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The composition of each pair, or -1."""
    pair = first.astype(np.int64) << 21 | second
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    out = np.where(keys[at] == pair, values[at], -1)
    lead, vowel = first - _HANGUL_L, second - _HANGUL_V
    out = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21), _HANGUL_S + (lead * 21 + vowel) * 28, out)
    open_, tail = first - _HANGUL_S, second - _HANGUL_T
    return np.where((open_ >= 0) & (open_ < 11172) & (open_ % 28 == 0) & (tail > 0) & (tail < 28), first + tail, out)


def fold_points(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One form for code points; ``row`` tells each one's text. Both come back."""
    table, ccc, extra, starts, keys, values, second = _tables()
    to = table[points]
    which = np.where(to < -1, -2 - to, 0)
    lengths = np.where(to >= 0, 1, np.where(to == -1, 0, starts[which + 1] - starts[which]))
    row = np.repeat(row, lengths)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    to, which = np.repeat(to, lengths), np.repeat(which, lengths)
    points = np.where(to >= 0, to, extra[np.minimum(starts[which] + inner, len(extra) - 1)])

    marks = ccc[points] > 0
    if marks.any():
        begins = np.ones(len(points), bool)
        begins[1:] = ~marks[1:] | (row[1:] != row[:-1])
        order = np.lexsort((ccc[points], np.cumsum(begins)))
        points = points[order]
    # Each pass joins every starter with the next mark (or starter) that composes with it and isn't blocked by a mark of
    # its own class; marks before the one that a starter has already taken aren't tried again.
    place = np.arange(len(points))
    taken = np.full(len(points), -1)
    while len(points) > 1:
        here = np.flatnonzero(second[points[1:]] & (row[1:] == row[:-1])) + 1
        if not len(here):
            break
        order_of = ccc[points]
        lead = np.maximum.accumulate(np.where(order_of == 0, np.arange(len(points)), -1))[here - 1]
        near = lead == here - 1
        free = (lead >= 0) & (row[lead] == row[here]) & (near | (order_of[here] > order_of[here - 1]))
        here, lead = here[free], lead[free]
        here, lead = (x[place[here] > taken[lead]] for x in (here, lead))
        fused = _composed(points[lead], points[here], keys, values)
        here, lead, fused = here[fused >= 0], lead[fused >= 0], fused[fused >= 0]
        lead, once = np.unique(lead, return_index=True)
        here, fused = here[once], fused[once]
        apart = ~np.isin(lead, here)
        here, lead, fused = here[apart], lead[apart], fused[apart]
        if not len(here):
            break
        points[lead] = fused
        taken[lead] = place[here]
        keep = np.ones(len(points), bool)
        keep[here] = False
        points, row, place, taken = points[keep], row[keep], place[keep], taken[keep]
    return points, row


def _fold_slice(raw: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The one form of texts that lie one after another in UTF-8, and the length of each in bytes."""
    n = len(offsets) - 1
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.int32)
    heads = np.cumsum(np.concatenate([[0], (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80]))
    counts = np.diff(heads[offsets])
    points, row = fold_points(points, np.repeat(np.arange(n, dtype=np.int32), counts))
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    return points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.bincount(row, weights=width, minlength=n)


def fold(texts: pa.Array) -> pa.Array:
    """The one form of each text of an Arrow string array; nulls stay. Works through slices of some ``SLICE`` bytes."""
    n = len(texts)
    texts = texts.cast(pa.large_string())
    whole = pc.fill_null(texts, "")
    if n == 0:
        return texts.cast(pa.string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1]
    if offsets[-1] == offsets[0]:
        return texts.cast(pa.string())
    cuts = np.unique(np.concatenate([np.searchsorted(offsets, np.arange(offsets[0], offsets[-1], SLICE)), [n]]))
    data, lengths = [], []
    for start, end in zip(np.concatenate([[0], cuts]), cuts, strict=False):
        if start < end:
            raw = whole.buffers()[2][offsets[start] : offsets[end]].to_pybytes()
            text, width = _fold_slice(raw, offsets[start : end + 1] - offsets[start])
            data.append(text)
            lengths.append(width)
    ends = np.cumsum(np.concatenate([[0], *lengths])).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(b"".join(data)))
    return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.large_string())).cast(pa.string())


def one_form(text: Column | str) -> Column:
    """The text with look-alike characters, full width, marks, blanks and unseen characters brought to one form.

    Blanks of every kind become a space each; case, accents, spelling and the number of blanks stay. Null stays null, the
    empty text stays empty.
    """
    return F.arrow_udf(fold, "string")(text)


def node_texts(nodes: DataFrame) -> DataFrame:
    """Name and label of nodes in long form: graph_id, node_row_id, field_name, raw, form. Null texts give no row."""
    formed = nodes.select("graph_id", "node_row_id", "name", "label", one_form("name").alias("name_form"), one_form("label").alias("label_form"))
    pairs = F.expr("stack(2, 'name', name, name_form, 'label', label, label_form) as (field_name, raw, form)")
    return formed.select("graph_id", "node_row_id", pairs).where(F.col("raw").isNotNull())


def alike_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of rows of a graph whose text reads the same and differs in its characters: node_row_a < node_row_b, field_name.

    Groups of rows of one form are first reduced to the least and the greatest text, pre-aggregated; only groups where
    these differ go into the join. Repeated rows count once; rows without a graph have no partner.
    """
    texts = node_texts(nodes)
    key = ["graph_id", "field_name", "form"]
    mixed = texts.groupBy(*key).agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low < high").select(*key)
    rows = durable(texts.join(mixed, key, "left_semi").distinct())
    a = rows.select(*key, F.col("node_row_id").alias("node_row_a"), F.col("raw").alias("raw_a"))
    b = rows.select(*key, F.col("node_row_id").alias("node_row_b"), F.col("raw").alias("raw_b"))
    return a.join(b, key).where("node_row_a < node_row_b and raw_a <> raw_b").select("node_row_a", "node_row_b", "field_name").distinct()
