"""Sinks: CSV with fixed columns, shards that can be written again, audits, request lines, checked copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.graphs import graph_keys


def write_csv(df: DataFrame, path: str, columns: list[str], extra: str = "drop", one_file: bool = False) -> None:
    """Write ``columns`` as CSV; nulls are blank, doubles have six decimals.

    Columns beyond are dropped, or raise ValueError with ``extra="error"``. ``one_file`` is for reports of bounded size.
    """
    beyond = [c for c in df.columns if c not in columns]
    if extra == "error" and beyond:
        raise ValueError(f"unexpected columns {beyond}")
    shown = [F.format_string("%.6f", c).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c).cast("string").alias(c) for c in columns]
    blank = [F.coalesce(F.when(F.col(c).isNull(), "").otherwise(s), F.lit("")).alias(c) for c, s in zip(columns, shown, strict=True)]
    out = df.select(*blank)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_shards(df: DataFrame, path: str, by: list[str]) -> None:
    """Write parquet by key, replacing only the keys that ``df`` has; the commit is atomic for each key."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def missing_shards(wanted: DataFrame, path: str, by: list[str]) -> DataFrame:
    """The wanted keys that ``path`` doesn't have yet; all of them if nothing is there."""
    spark = wanted.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return wanted
    return wanted.join(spark.read.parquet(path).select(*by).distinct(), by, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def request_lines(prompts: DataFrame, model: str, url: str) -> DataFrame:
    """Lines of a batch request for (custom_id, prompt) rows: value."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("input"))
    return prompts.select(F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))).alias("value"))


def render(template: str, prompts: DataFrame, names: list[str]) -> DataFrame:
    """Fill ``{{name}}`` places of a template from columns; a null fills as the empty text. Adds prompt."""
    text = F.lit(template)
    for name in names:
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return prompts.withColumn("prompt", text)


def placeholder_errors(templates: DataFrame) -> DataFrame:
    """For (step, template, declared) rows: placeholders that aren't declared, and declared names without a place."""
    used = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}"), F.lit(1)))
    return templates.select("step", F.array_sort(F.array_except(used, "declared")).alias("undeclared"), F.array_sort(F.array_except("declared", used)).alias("unused"))


def copy_status(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Compare two sets of files (keys, content): keys and status to_copy, unchanged, conflict or only_in_target."""
    a = source.select(*keys, F.sha2("content", 256).alias("a"))
    b = target.select(*keys, F.sha2("content", 256).alias("b"))
    status = F.when(F.col("b").isNull(), "to_copy").when(F.col("a").isNull(), "only_in_target").when(F.col("a") == F.col("b"), "unchanged").otherwise("conflict")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def exclusion_audit(kept: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: how many cases were kept and excluded."""
    marked = kept.select(F.lit(True).alias("k")).unionAll(excluded.select(F.lit(False).alias("k")))
    return marked.agg(F.count_if("k").alias("kept"), F.count_if(~F.col("k")).alias("excluded"))


def graph_exchange(graph_node: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct node and edge records for a graph database: kind, id, source, target, properties (JSON)."""
    keyed = nodes.join(graph_keys(graph_node).select("graph_id", "report_id"), "graph_id")
    place = lambda c: F.concat_ws("/", F.col("graph_id").cast("string"), c)
    n = keyed.select(F.lit("node").alias("kind"), place("node_id").alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.to_json(F.struct("label", "name", "node_type", "report_id")).alias("properties"))
    e = edges.select(F.lit("edge").alias("kind"), place(F.concat_ws("|", "source", "target", "relation")).alias("id"), place("source").alias("source"), place("target").alias("target"), F.to_json(F.struct("relation")).alias("properties"))
    return n.unionByName(e).distinct()
