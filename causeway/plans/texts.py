"""Queries on texts, names and the catalogue, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import text
from causeway.functions.keys import to_number
from causeway.operators import catalogue, compare, nested
from causeway.plans.graphs import NODES_SQL, load
from causeway.sources.tables import table

_B = text.BLANKS


def text_distinct_normalized(spark, sf_dir):
    """Documents and distinct normal texts of each source."""
    rows = table(spark, sf_dir, "documents").select("source", F.md5(text.normalize("text")).alias("key"))
    counted = rows.groupBy("source", "key").agg(F.count("*").alias("n"))
    return counted.groupBy("source").agg(F.sum("n").alias("documents"), F.count("key").alias("distinct_texts"))


def text_first_occurrence(spark, sf_dir):
    """The first document of each normal text that several documents share, and how many do."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(text.normalize("text")).alias("key"))
    return rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("documents")).where("documents > 1")


def text_hash_keys(spark, sf_dir):
    """sha256, short sha1 and 64-bit seed of each document text."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.sha2("text", 256).alias("key"), F.left(F.sha1("text"), F.lit(10)).alias("short"), text.seed_of("text").alias("seed"))


def text_arrow_edges(spark, sf_dir):
    """Edges of each graph read back from its arrow text ``1. A → B``; the first of equal ones stays."""
    line = F.concat(F.lit("1. "), "source", F.lit(" → "), "target")
    written = load(spark, sf_dir).written.select("graph_id", F.struct("pos", line.alias("line")).alias("l"))
    texts = written.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list("l"))["line"], "\n").alias("text"))
    return text.arrow_edges(texts, "graph_id", "text")


def text_names(spark, sf_dir):
    """File names, slugs and plain dashes of the distinct node names."""
    names = load(spark, sf_dir).nodes.select("name").distinct()
    return names.select("name", text.safe_name("name").alias("file_name"), text.slug("name").alias("slug"), text.plain_dashes("name").alias("plain"))


def text_sentences(spark, sf_dir):
    """Distinct triple sentences, and the graphs that have them."""
    g = load(spark, sf_dir)
    return compare.triple_sentences(g.edges, g.nodes).groupBy("sentence").agg(F.count("*").alias("graphs"))


def text_snippets(spark, sf_dir):
    """Evidence of the first eight nodes of each graph that have any, shortened to 80 characters."""
    rows = load(spark, sf_dir, texts=True).nodes.where("trim(evidence) <> ''").select("graph_id", F.struct("node_id", F.left(F.trim("evidence"), F.lit(80)).alias("t")).alias("s"))
    listed = rows.groupBy("graph_id").agg(F.slice(F.array_sort(F.collect_list("s")), 1, 8).alias("s"))
    return listed.select("graph_id", F.array_join(F.transform("s", lambda s: F.concat(s.node_id, F.lit(": "), s.t)), "\n").alias("snippets"))


def text_incidents(spark, sf_dir):
    """The section texts of each incident joined to one text, in written order."""
    sections = ["incident_summary_section.text", "incident_description_section.text"]
    nodes = nested.shred(table(spark, sf_dir, "step_output"), "output_id", "payload", [f"incidents[].{s}" for s in sections])
    said = nodes.where(F.col("schema_path").endswith(".text") & (F.trim("value") != "")).distinct()
    # the incident is the label without the steps to section and text
    by_incident = said.select("output_id", nested.parent_label(F.col("dewey"), 2).alias("incident"), F.struct("dewey", "value").alias("s"))
    joined = by_incident.groupBy("output_id", "incident").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return joined.select("output_id", F.element_at("incident", -1).cast("long").alias("incident_no"), F.array_join("s.value", "\n\n").alias("text"))


def text_json_status(spark, sf_dir):
    """How payloads can be read: as JSON, as JSON within other text, as plain text, or not there; per step."""
    payload = F.btrim("payload", F.lit(" \t\r\n﻿"))
    block = F.regexp_extract(payload, r"(?s)[{].*[}]", 0)
    status = (
        F.when(F.col("payload").isNull() | (payload == ""), "absent")
        .when(F.try_parse_json(payload).isNotNull(), "json")
        .when((block != "") & F.try_parse_json(block).isNotNull(), "embedded")
        .otherwise("text")
    )
    rows = table(spark, sf_dir, "step_output").distinct()
    return rows.groupBy("step_name", status.alias("status")).agg(F.count("*").alias("outputs"))


def vocab_options(spark, sf_dir):
    """Terms and their other wordings, each option once per field, with the first term that has it."""
    rows = table(spark, sf_dir, "vocab_term").distinct()
    options = rows.select("field_name", "term_id", F.explode(F.split(F.concat_ws(";", "term", "also_known"), ";")).alias("option"))
    options = options.withColumn("option", F.trim("option")).where("option <> ''")
    return options.groupBy("field_name", F.lower("option").alias("option")).agg(F.min("term_id").alias("term_id"))


def catalogue_dates(spark, sf_dir):
    """Accident and release dates of each entry as ISO dates, and whether both releases agree."""
    rows = table(spark, sf_dir, "catalogue_entry").distinct()
    detail, listed = text.iso_date("final_report_release_date"), text.iso_date("catalogue_release_date")
    agree = F.when(detail.isNull() | listed.isNull(), "incomplete").when(detail == listed, "match").otherwise("mismatch")
    return rows.select("entry_id", text.iso_date("accident_date").alias("accident"), detail.alias("release"), agree.alias("consistency"))


def catalogue_links(spark, sf_dir):
    return catalogue.report_links(table(spark, sf_dir, "catalogue_entry"))


def catalogue_primary(spark, sf_dir):
    links = catalogue.report_links(table(spark, sf_dir, "catalogue_entry"))
    return catalogue.primary_reports(links).join(catalogue.inferred_type(links), "entry_id")


def catalogue_numbers(spark, sf_dir):
    """The one investigation number that an entry shows or hints at, or null."""
    rows = table(spark, sf_dir, "catalogue_entry").distinct()
    both = F.upper(F.concat_ws(" ", "investigation_number", "investigation_number_candidate"))
    return rows.select("entry_id", text.only_number(both, r"\d{4}-\d{2}-[A-Z]-[A-Z]{2}").alias("number"))


def catalogue_latest(spark, sf_dir):
    """The twenty entries released last, by date and title."""
    rows = table(spark, sf_dir, "catalogue_entry").select("entry_id", "official_title", text.iso_date("catalogue_release_date").alias("released")).distinct()
    return rows.where("released is not null").orderBy(F.desc("released"), F.desc("official_title"), "entry_id").limit(20)


def event_statistics(spark, sf_dir):
    """Events per type: count, sum and quartile of the value, and the numbers read from the properties."""
    rows = table(spark, sf_dir, "events").withColumn("k", to_number(F.get_json_object("props", "$.k")))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"), F.round(F.median("value"), 4).alias("median"), F.sum("k").cast("long").alias("k")
    )


_N = f"trim(regexp_replace(lower(text), '{_B}', ' ', 'g'))"
_ISO = "case when regexp_matches(trim({0}), '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') then strftime(try_strptime(trim({0}), '%m/%d/%Y'), '%Y-%m-%d') when regexp_matches(trim({0}), '^\\d{{4}}-\\d\\d-\\d\\d$') then strftime(try_strptime(trim({0}), '%Y-%m-%d'), '%Y-%m-%d') end"
_LINKS = """links as (
  select entry_id, min(pos) as pos, arg_min(title, pos) as title, url from (
    select entry_id, generate_subscripts(r, 1) - 1 as pos, unnest(r).title as title, unnest(r).url as url
    from (select distinct entry_id, from_json(all_final_reports_json, '[{"title":"VARCHAR","url":"VARCHAR"}]') as r from catalogue_entry)) where url is not null group by entry_id, url
), scored as (
  select *, (case when contains(lower(title), 'final report') then 30 else 0 end + case when contains(lower(title), 'investigation report') then 20 else 0 end
    + case when regexp_matches(lower(title), 'case study|safety bulletin|safety study') then 15 else 0 end + case when regexp_matches(lower(title), 'spanish|español|appendix|annex') then -50 else 0 end
    + case when regexp_matches(lower(title), 'executive summary|presentation|transcript') then -20 else 0 end) as score from links
)"""
QUERIES = {
    f.__name__: f
    for f in (
        text_distinct_normalized, text_first_occurrence, text_hash_keys, text_arrow_edges, text_names, text_sentences, text_snippets,
        text_incidents, text_json_status, vocab_options, catalogue_dates, catalogue_links, catalogue_primary, catalogue_numbers,
        catalogue_latest, event_statistics,
    )
}
SQL = {
    "text_distinct_normalized": f"select source, count(*) as documents, count(distinct md5({_N})) as distinct_texts from documents group by 1",
    "text_first_occurrence": f"select md5({_N}) as key, min(doc_id) as first_doc, count(*) as documents from documents where text is not null group by 1 having count(*) > 1",
    "text_hash_keys": "select doc_id, sha256(text) as key, left(sha1(text), 10) as short, ('0x' || left(sha256(text), 16))::ubigint::varchar as seed from documents where text is not null",
    "text_arrow_edges": f"""with {NODES_SQL}, numbered as (select graph_id, source as src, target as dst, (row_number() over (partition by graph_id order by pos, source, target) - 1)::int as pos from written)
select graph_id, min(pos) as pos, src, dst from numbered group by graph_id, src, dst""",
    "text_names": f"""with {NODES_SQL}, d as (select distinct name from nodes)
select name, left(regexp_replace(trim(name), '[^A-Za-z0-9._-]+', '_', 'g'), 100) as file_name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug,
  regexp_replace(name, '\\p{{Pd}}', '_', 'g') as plain from d""",
    "text_sentences": f"""with {NODES_SQL} select sentence, count(*) as graphs from (
select distinct graph_id, concat_ws(' ', source_name, case when relation = '' then 'related_to' else relation end, target_name) as sentence from named) group by 1""",
    "text_snippets": """with last as (
  select graph_id, node_id, evidence from graph_node where deleted_at is null and graph_id is not null and node_id is not null
  qualify row_number() over (partition by graph_id, node_id order by loaded_at desc, node_row_id desc) = 1
), few as (select graph_id, node_id, left(trim(evidence), 80) as t from last where trim(evidence) <> '' qualify row_number() over (partition by graph_id order by node_id) <= 8)
select graph_id, string_agg(node_id || ': ' || t, chr(10) order by node_id) as snippets from few group by 1""",
    "vocab_options": """select field_name, lower(trim(option)) as option, min(term_id) as term_id
from (select field_name, term_id, unnest(string_split(concat_ws(';', term, also_known), ';')) as option from vocab_term) where trim(option) <> '' group by 1, 2""",
    "catalogue_dates": f"""with d as (select distinct entry_id, {_ISO.format('accident_date')} as accident, {_ISO.format('final_report_release_date')} as release, {_ISO.format('catalogue_release_date')} as listed from catalogue_entry)
select entry_id, accident, release, case when release is null or listed is null then 'incomplete' when release = listed then 'match' else 'mismatch' end as consistency from d""",
    "catalogue_links": f"with {_LINKS} select entry_id, pos, title, url, score from scored",
    "catalogue_primary": f"""with {_LINKS}, best as (select *, count(*) over (partition by entry_id) as links from scored qualify row_number() over (partition by entry_id order by score desc, length(title), pos) = 1),
kinds as (select entry_id, min(case when contains(t, 'case study') then 0 when contains(t, 'safety bulletin') then 1 when contains(t, 'safety study') then 2 when contains(t, 'investigation report') then 3
  when contains(t, 'final report') then 4 else 5 end) as k from (select entry_id, translate(lower(title || ' ' || url), '_-', '  ') as t from links) group by 1)
select entry_id, title, url, score, links, ['Case Study', 'Safety Bulletin', 'Safety Study', 'Investigation Report', 'Final Report', ''][k + 1] as report_type from best join kinds using (entry_id)""",
    "catalogue_numbers": """with d as (select distinct entry_id, list_distinct(regexp_extract_all(upper(concat_ws(' ', investigation_number, investigation_number_candidate)), '\\d{4}-\\d{2}-[A-Z]-[A-Z]{2}')) as found from catalogue_entry)
select entry_id, case when len(found) = 1 then found[1] end as number from d""",
    "catalogue_latest": f"""select entry_id, official_title, released from (select distinct entry_id, official_title, {_ISO.format('catalogue_release_date')} as released from catalogue_entry)
where released is not null order by released desc, official_title desc, entry_id limit 20""",
    "event_statistics": """select event_type, count(*) as events, round(sum(value), 2) as total, round(median(value), 4) as median, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by 1""",
}
