"""Keys and small scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def batch_key(batch: Column | str) -> Column:
    """A batch id in lower case without its ``_output_round_N`` ending."""
    return F.lower(F.regexp_replace(F.trim(_col(batch)), r"(?i)_output_round_\d+$", ""))


def case_key(batch: Column | str, case: Column | str) -> Column:
    """``batch/case`` of a report."""
    return F.concat_ws("/", batch_key(batch), F.lower(F.trim(_col(case))))


def number_at_end(text: Column | str) -> Column:
    """The number at the end of a text, or null."""
    return F.regexp_extract(_col(text), r"(\d+)$", 1).try_cast("int")


def to_number(text: Column | str) -> Column:
    """A text as a double; null where blank, no number, or not finite."""
    value = F.trim(_col(text)).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def numeric_first(text: Column | str) -> list[Column]:
    """Sort keys that put numbers first in numeric order, then other texts."""
    return [F.coalesce(_col(text).try_cast("bigint"), F.lit(1_000_000_000)), _col(text)]


def node_type(given: Column | str, node_id: Column | str) -> Column:
    """The canonical node type, else the type that the prefix of the node id tells, in the order H, En, C, Ev."""
    at = _col(node_id)
    told = F.when(at.startswith("H"), "hazardconsequence").when(at.startswith("En"), "entity").when(at.startswith("C"), "condition").when(at.startswith("Ev"), "event")
    clean = F.lower(F.trim(_col(given)))
    clean = F.when(clean == "intermediateevent", "event").otherwise(clean)
    return F.coalesce(F.nullif(clean, F.lit("")), told, F.lit("unknown_node_type"))


def severity_rank(severity: Column | str) -> Column:
    """high 0, medium 1, low 2, anything else 3."""
    clean = F.lower(F.trim(_col(severity)))
    return F.when(clean == "high", 0).when(clean == "medium", 1).when(clean == "low", 2).otherwise(3)


def difference_bucket(difference: Column | str) -> Column:
    """A signed difference as a bucket: <=-6, -5..-3, -2..-1, 0, 1..2, 3..5, >=6."""
    d = _col(difference)
    low = F.when(d <= -6, "<=-6").when(d <= -3, "-5..-3").when(d <= -1, "-2..-1").when(d == 0, "0")
    return low.when(d <= 2, "1..2").when(d <= 5, "3..5").when(d.isNotNull(), ">=6")
