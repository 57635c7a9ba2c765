"""Catalogue of reports: links, scores, types, dates and numbers; pages of HTML to links."""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of a report's title with their weight for the choice of the primary report.
WEIGHTS = {
    "final report": 30,
    "investigation report": 20,
    "case study": 15,
    "safety bulletin": 15,
    "safety study": 15,
    "spanish": -50,
    "español": -50,
    "appendix": -50,
    "annex": -50,
    "executive summary": -20,
    "presentation": -20,
    "transcript": -20,
}
# Types of reports, the first that stands in a title counts.
TYPES = [
    "case study",
    "safety bulletin",
    "safety study",
    "investigation report",
    "final report",
]


def report_score(title: Column) -> Column:
    """The weight of a report's title for the choice of the primary one: each weight counts once, whichever of its terms stands."""
    lower = F.lower(title)
    said = {w: F.lit(False) for w in WEIGHTS.values()}
    for term, w in WEIGHTS.items():
        said[w] = said[w] | lower.contains(term)
    return sum((F.when(any_of, w).otherwise(0) for w, any_of in said.items()), F.lit(0))


def report_links(catalogue: DataFrame) -> DataFrame:
    """entry_id, pos, title, url, score of each distinct link of an entry; bad JSON and null give none."""
    parsed = F.from_json("all_final_reports_json", "array<struct<title:string,url:string>>", {"mode": "PERMISSIVE"})
    rows = catalogue.select("entry_id", F.posexplode(parsed).alias("pos", "r")).select("entry_id", "pos", "r.title", "r.url")
    first = rows.where("url is not null").groupBy("entry_id", "url").agg(F.min(F.struct("pos", "title")).alias("f"))
    return first.select("entry_id", "f.pos", "f.title", "url", report_score(F.coalesce("f.title", F.lit(""))).alias("score"))


def primary_reports(links: DataFrame) -> DataFrame:
    """The link with the best score of each entry, of equals the shortest title, then the first."""
    best = F.max_by(F.struct("title", "url", "score"), F.struct("score", -F.length("title"), -F.col("pos")))
    return links.groupBy("entry_id").agg(best.alias("b"), F.count("*").alias("links")).select("entry_id", "b.title", "b.url", "b.score", "links")


def inferred_type(links: DataFrame) -> DataFrame:
    """The report type that titles and urls of an entry's links name, the first of the list, or the empty text."""
    text = F.translate(F.lower(F.concat_ws(" ", "title", "url")), "_-", "  ")
    named = links.withColumn("kind", F.coalesce(*(F.when(text.contains(t), F.lit(k)) for k, t in enumerate(TYPES)), F.lit(len(TYPES))))
    names = F.array(*(F.lit(t.title()) for t in TYPES), F.lit(""))
    return named.groupBy("entry_id").agg(F.min("kind").alias("kind")).select("entry_id", names[F.col("kind")].alias("report_type"))


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict[str, Any]] = []
        self.title, self._in = "", ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("a", "title", "h1"):
            self._in = tag
        if tag == "a":
            url = dict(attrs).get("href")
            self._in = "a" if url else ""
            if url:
                self.found.append({"url": url, "text": ""})

    def handle_endtag(self, tag: str) -> None:
        self._in = "" if tag == self._in else self._in

    def handle_data(self, data: str) -> None:
        if self._in == "a" and self.found:
            self.found[-1]["text"] += data
        elif self._in in ("title", "h1") and not self.title:
            self.title = data.strip()


def page_links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Title and links of HTML pages: id, title, pos, url, text, page_no (the ``pg`` parameter). Null pages give none."""

    def parse(html: pa.Array) -> pa.Array:
        out = []
        for text in html.to_pylist():
            parser = _Links()
            parser.feed(text or "")
            out.append({"title": parser.title, "links": [{"url": x["url"], "text": " ".join(x["text"].split())} for x in parser.found]})
        return pa.array(out, pa.struct([("title", pa.string()), ("links", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())])))]))

    parsed = pages.select(id_col, F.arrow_udf(parse, "title string, links array<struct<url:string,text:string>>")(html_col).alias("p"))
    rows = parsed.select(id_col, "p.title", F.posexplode("p.links").alias("pos", "l"))
    number = F.nullif(F.regexp_extract("l.url", r"[?&]pg=(\d+)", 1), F.lit("")).cast("int")
    return rows.select(id_col, "title", "pos", "l.url", "l.text", number.alias("page_no"))
