"""Text scalars as Column expressions: normal forms, tags, arrow lines, names, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.keys import _col

# Arrows, dash-like and invisible characters of arrow text, and blanks.
ARROWS = "→⇒➔➜⟶"
DASHES = "‐‑‒–—−"
INVISIBLE = "\u00a0\u200b\u200c\u200d\ufeff"
BLANKS = r"[\s\x{B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normalize(text: Column | str) -> Column:
    """Lower case, blanks of every kind single, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), BLANKS, " "))


def hazard_base(text: Column | str) -> Column:
    """A hazard name without its trailing number."""
    return F.trim(F.regexp_replace(F.trim(_col(text)), r"\s+\d+\s*$", ""))


def before_tag(text: Column | str) -> Column:
    """The text before its first ``<``."""
    return F.trim(F.substring_index(_col(text), "<", 1))


def first_tag(text: Column | str) -> Column:
    """The text of the first ``<tag>``, or null."""
    return F.nullif(F.trim(F.regexp_extract(_col(text), "<([^>]+)>", 1)), F.lit(""))


def arrow_line(line: Column | str) -> Column:
    """A line with plain blanks, dashes and ``->`` arrows, without a leading number or bullet."""
    plain = F.translate(_col(line), INVISIBLE + DASHES, " " * len(INVISIBLE) + "-" * len(DASHES))
    plain = F.regexp_replace(plain, f"[{ARROWS}]|-+>", "->")
    return F.trim(F.regexp_replace(plain, r"^\s*(?:\(?\d+[.)]\s*|[*•-]\s+)", ""))


def arrow_edges(df: DataFrame, id_col: str, text_col: str, dedupe: bool = True) -> DataFrame:
    """Edges ``A -> B`` of arrow text in line order: id, pos, src, dst.

    Lines without an arrow or with a blank end give nothing, null and empty texts give nothing. With ``dedupe`` the
    first of equal edges stays. Further columns aren't read.
    """
    lines = df.select(id_col, F.posexplode(F.split(text_col, r"\R")).alias("pos", "line")).withColumn("line", arrow_line("line"))
    pair = r"^(.*?)\s*->\s*(.*)$"
    edges = lines.select(id_col, "pos", F.trim(F.regexp_extract("line", pair, 1)).alias("src"), F.trim(F.regexp_extract("line", pair, 2)).alias("dst"))
    edges = edges.where("src <> '' and dst <> ''")
    if dedupe:
        edges = edges.groupBy(id_col, "src", "dst").agg(F.min("pos").alias("pos"))
    return edges.select(id_col, "pos", "src", "dst")


def safe_name(text: Column | str) -> Column:
    """A name for files: letters, digits and ``._-``, other runs as one ``_``, a hundred characters at most."""
    return F.left(F.regexp_replace(F.trim(_col(text)), r"[^A-Za-z0-9._-]+", "_"), F.lit(100))


def slug(text: Column | str) -> Column:
    """Lower-case words joined by hyphens."""
    return F.btrim(F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9]+", "-"), F.lit("-"))


def plain_dashes(text: Column | str) -> Column:
    """Every dash as an underscore."""
    return F.regexp_replace(_col(text), r"\p{Pd}", "_")


def iso_date(text: Column | str) -> Column:
    """``MM/DD/YYYY`` or an ISO date as an ISO date, or null."""
    text = F.trim(_col(text))
    us = F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 0)
    parsed = F.when(us != "", F.try_to_date(us, "M/d/yyyy")).otherwise(F.try_to_date(F.regexp_extract(text, r"^\d{4}-\d\d-\d\d$", 0), "yyyy-MM-dd"))
    return F.date_format(parsed, "yyyy-MM-dd")


def only_number(text: Column | str, pattern: str) -> Column:
    """The one distinct match of a pattern in a text, or null if there is none or more than one."""
    found = F.array_distinct(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)))
    return F.when(F.size(found) == 1, found[0])


def seed_of(text: Column | str) -> Column:
    """The first 64 bits of the sha256 of a text as a decimal string."""
    return F.conv(F.left(F.sha2(_col(text), 256), F.lit(16)), 16, 10)


def hazard_form(text: Column | str) -> Column:
    """A hazard's name in lower case without its number, written as ``number 3``, ``(3)``, `` 3``, ``-3`` or ``_3``."""
    form = normalize(text)
    for ending in (r"\s+number(?:\s*\d+)?$", r"\s*\(\s*\d+\s*\)\s*$", r"[\s\-_]*\d+$"):
        form = F.trim(F.regexp_replace(form, ending, ""))
    return form


def xml_text(text: Column | str) -> Column:
    """The text without the characters that XML doesn't allow."""
    return F.regexp_replace(_col(text), r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]", "")


# Names of nodes that say nothing and aren't shown.
HIDDEN = ["not specified", "not dispersed", "not dispered"]


def is_hidden(name: Column | str) -> Column:
    return normalize(name).isin(HIDDEN)
