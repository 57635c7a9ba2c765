"""Panels of scores from CSV, with checks; results of batch jobs; exclusion lists; the latest of several results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.keys import case_key, to_number
from causeway.sources.schema import EXCLUSIONS


def read_panel(spark: SparkSession, path: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """A panel from CSV files with a header, all read as text: keys as text, metrics as numbers (null where blank or no number).

    A byte order mark is dropped. Missing columns and repeated keys raise ValueError.
    """
    raw = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    missing = [c for c in [*keys, *metrics] if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    panel = raw.select(*(F.trim(k).alias(k) for k in keys), *(to_number(m).alias(m) for m in metrics))
    if not panel.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{path} repeats keys of {keys}")
    return panel


def ok_rows(panel: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows whose status is ok and whose metrics are all numbers."""
    return panel.where(F.lower(F.trim("status")) == "ok").dropna(subset=metrics)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of two panels that must have each key once; ValueError if one repeats a key."""
    for side in (left, right):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"keys {keys} are repeated")
    return left.join(right, keys)


def latest_results(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest file of that name in each parent directory's children: parent, newest by directory name, newest by time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).drop("content")
    part = F.split("path", "/")
    keyed = files.select("path", "modificationTime", F.try_element_at(part, F.lit(-2)).alias("dir"), F.array_join(F.slice(part, F.lit(1), F.size(part) - 2), "/").alias("parent"))
    return keyed.groupBy("parent").agg(F.max_by("path", F.struct("dir", "path")).alias("by_name"), F.max_by("path", F.struct("modificationTime", "path")).alias("by_time"))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Excluded case keys of a JSON list or an object with excluded_cases: case_key. Repeated keys raise ValueError."""
    body = spark.read.text(path, wholetext=True)
    cases = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.from_json("value", EXCLUSIONS)["excluded_cases"])
    keys = body.select(F.explode(cases).alias("c")).select(F.split("c", "/").alias("c")).select(case_key(F.col("c")[0], F.col("c")[1]).alias("case_key"))
    if not keys.groupBy("case_key").count().where("count > 1").isEmpty():
        raise ValueError(f"{path} repeats cases")
    return keys


def held_out(rows: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (with case_key) that aren't excluded, and those that are."""
    return rows.join(exclusions, "case_key", "left_anti"), rows.join(exclusions, "case_key", "left_semi")


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a batch job's result: custom_id, status (ok, failed or bad), text, error. The text is the joined output."""
    line = "custom_id string, error string, response struct<status_code:int, body:struct<output_text:string, output:array<struct<content:array<struct<text:string>>>>>>"
    rows = spark.read.text(path).select(F.from_json("value", line).alias("r")).select("r.*")
    joined = F.array_join(F.flatten(F.transform("response.body.output", lambda o: F.transform(o.content, lambda c: c.text))), "")
    text = F.coalesce("response.body.output_text", F.nullif(joined, F.lit("")))
    status = F.when(F.col("custom_id").isNull(), "bad").when(F.col("error").isNotNull() | (F.col("response.status_code") != 200) | text.isNull(), "failed").otherwise("ok")
    return rows.select("custom_id", status.alias("status"), text.alias("text"), "error")


def read_texts(spark: SparkSession, root: str, name: str = "*.txt") -> DataFrame:
    """Whole text files below ``root``: file_name, text, with words that a line end hyphenates joined again."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    return files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"), F.regexp_replace("value", r"(\p{L})-\s*\n\s*(\p{Ll})", "$1$2").alias("text"))
