"""Queries of the problems on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import entities, languages, leaks, lookalike, mapping, tokens
from causeway.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_values(table(spark, sf_dir, "hazard_choice"), table(spark, sf_dir, "vocab_term"), "choice_id", ["name", "label"])


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no entry, with their number of choices."""
    unmatched = p3_found(spark, sf_dir).where("term_id = 0")
    values = F.expr("stack(2, 'name', name, 'label', label) as (field_name, value)")
    choices = table(spark, sf_dir, "hazard_choice").select("choice_id", values).distinct()
    return unmatched.join(choices, ["choice_id", "field_name"]).groupBy("field_name", "value").agg(F.count("*").alias("choices"))


def p3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry within reach of each distinct value, with its distance and rank."""
    return mapping.candidates(table(spark, sf_dir, "hazard_choice"), table(spark, sf_dir, "vocab_term"), "choice_id", ["name", "label"])


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entities.catalogue_attributes(table(spark, sf_dir, "catalogue_entry"))
    return entities.match(entries, entities.notice_attributes(table(spark, sf_dir, "accident_notice")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir).select("entry_id", "notice_id")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with the rule that found them and its confidence."""
    return _p4(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, sf_dir, "graph_node"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.node_texts(table(spark, sf_dir, "graph_node")).select("node_row_id", "field_name", "form").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that carry it."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("docs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_cases(languages.scored_documents(table(spark, sf_dir, "documents")))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every stretch with its language and confidence."""
    return languages.language_segments(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched, "p3_candidates": p3_candidates, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p5_forms": p5_forms, "p6_ids": p6_ids, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_segments": p8_segments}
SQL: dict[str, str] = {}
