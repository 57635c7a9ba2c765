"""Orphan references by dictionary-encoded keys and bitmaps.

A reference names a key within a scope at a time; a parent row of that key is live from its start up to its end.

1. The distinct keys of the parents get dense integer codes, ranked within hash ranges of the key.
2. References become bitmaps per scope, key range (a word of 64 codes) and period, with the first and last time of
   the references in each; words without references don't exist, which is the compression. The bits are gathered by
   ``bit_or``, so a hot key collapses before the shuffle.
3. A parent row sets its bit in the words of its scope over whose whole stretch of references it was live.
   Reference AND-NOT parent leaves the bits that need a closer look, all others are sound.
4. The surviving bits are decoded to keys and periods, and only their references are checked by time, with a running
   maximum of end times per key and day.

No step gathers a scope or a key in one row; the widest group is one key on one day, and it streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.session import broadcast_if_small, durable

#: Keys of a hash range within which they are ranked, about; each range is one window of distinct keys.
RANGE_KEYS = 100_000
_FAR = "timestamp_ntz'9999-12-31 23:59:59'"
_BLANKS = " \t\r\n\x0b\x0c\xa0"


def key_codes(parents: DataFrame, range_keys: int = RANGE_KEYS) -> DataFrame:
    """Dense integer codes of the distinct non-null keys: key, code. The same keys always get the same codes.

    There are as many hash ranges as hold about ``range_keys`` keys each.
    """
    keys = durable(parents.where(F.col("key").isNotNull()).select("key").distinct())
    ranges = max(1, -(-keys.count() // range_keys))
    part = Window.partitionBy("part").orderBy("key")
    ranked = keys.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(ranges)))
    return ranked.select("key", ((F.row_number().over(part) - 1) * ranges + F.col("part")).cast("long").alias("code"))


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a live parent, with the reason.

    ``references`` has scope, key, at (timestamp_ntz) and any other columns, which are kept (but for period and reason); ``parents`` has scope, key,
    since, until. A reference is sound if a parent row of its scope and key has since <= at and until null or > at.
    The result has the references' columns with period (yyyy-MM of at) and reason: ``missing`` without any parent row,
    ``deleted`` if one has since <= at, else ``late``.

    References with a null key are dropped; with a null scope they are missing; with a null time nothing was loaded yet,
    so they are missing or late, in a null period. Parent rows with a null start count as rows that never were live.
    Repeated parents change nothing, repeated references give repeated rows. Empty inputs give empty results.
    """
    others = [c for c in references.columns if c not in ("scope", "key", "at", "period", "reason")]
    own = F.struct(*others).alias("own") if others else F.lit(None).cast("string").alias("own")
    refs = references.where(F.col("key").isNotNull()).select("scope", "key", "at", F.date_format("at", "yyyy-MM").alias("period"), own)
    back = [F.col(f"own.`{c}`").alias(c) for c in others]
    codes = durable(key_codes(parents))
    small = broadcast_if_small(codes)

    def bit(code: str) -> dict:
        return {"word": F.shiftrightunsigned(F.col(code), 6), "bit": F.col(code).bitwiseAND(F.lit(63)).cast("int")}

    coded = refs.join(small, "key", "left").withColumns(bit("code"))
    known = coded.where(F.col("code").isNotNull() & F.col("scope").isNotNull() & F.col("at").isNotNull())
    rest = coded.where(F.col("code").isNull() | F.col("scope").isNull() | F.col("at").isNull())
    rows = parents.where(F.col("scope").isNotNull()).join(small, "key").withColumns(bit("code"))
    rows = rows.select("scope", "word", "bit", "since", "until")

    mask = F.expr("shiftleft(1L, bit)")
    words = known.groupBy("scope", "word", "period").agg(
        F.bit_or(mask).alias("bits"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    live = (F.col("since") <= F.col("first_at")) & (F.col("until").isNull() | (F.col("until") > F.col("last_at")))
    held = (
        words.join(rows, ["scope", "word"], "left")
        .groupBy("scope", "word", "period")
        .agg(F.first("bits").alias("bits"), F.bit_or(F.when(live, mask).otherwise(F.lit(0).cast("long"))).alias("held"))
    )
    suspects = (
        held.withColumn("left", F.expr("bits & ~held"))
        .where(F.col("left") != 0)
        .select(
            "scope", "word", "period", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftright(left, b) & 1L) = 1L)")).alias("bit")
        )
    )
    suspects = durable(suspects)

    key = ["scope", "word", "bit"]
    asked = known.join(suspects, [*key, "period"], "left_semi")
    versions = rows.join(suspects.select(*key).distinct(), key, "left_semi")
    ends = F.when(F.col("since").isNotNull(), F.coalesce("until", F.expr(_FAR)))
    empty = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in ["key", "period", "own"]]
    events = asked.select(
        *key, F.col("at").alias("time"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("ends"), "key", "period", "own"
    ).unionByName(versions.select(*key, F.col("since").alias("time"), F.lit(0).alias("kind"), ends.alias("ends"), *empty))
    events = events.withColumn("day", F.to_date("time"))

    by_key = Window.partitionBy(*key)
    before = by_key.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = events.groupBy(*key, "day").agg(F.max("ends").alias("ends"), F.min("kind").alias("kind"))
    days = days.select(*key, "day", F.max("ends").over(before).alias("carried"), F.min("kind").over(by_key).alias("any"))
    in_day = Window.partitionBy(*key, "day").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, 0)
    checked = events.withColumn("reached", F.max("ends").over(in_day)).where(F.col("kind") == 1)
    ends_by = F.greatest("reached", "carried")
    reason = F.when(ends_by.isNotNull(), "deleted").when(F.col("any") == 0, "late").otherwise("missing")
    timed = (
        checked.join(days, [*key, "day"])
        .where(ends_by.isNull() | (ends_by <= F.col("time")))
        .select("scope", "key", F.col("time").alias("at"), "period", *back, reason.alias("reason"))
    )

    there = rows.select(*key).distinct().withColumn("there", F.lit(True))
    undated = (
        rest.join(there, key, "left")
        .select("scope", "key", "at", "period", *back, F.when(F.col("there"), "late").otherwise("missing").alias("reason"))
    )
    return timed.unionByName(undated)


def edge_references(edges: DataFrame, name: str, row_id: str, at: str = "loaded_at") -> DataFrame:
    """Source and target of an edge table as references: scope, key, at, ref_table, ref_row_id, field_name.

    Outer blanks are dropped; null and blank ends are no references.
    """
    ends = edges.select(
        F.col("graph_id").alias("scope"),
        F.col(at).alias("at"),
        F.lit(name).alias("ref_table"),
        F.col(row_id).alias("ref_row_id"),
        F.expr("stack(2, 'source', source, 'target', target) as (field_name, raw)"),
    )
    return ends.withColumn("key", F.btrim("raw", F.lit(_BLANKS))).drop("raw").where(F.col("key") != "")


def graph_orphans(graph_edge: DataFrame, review_edge: DataFrame, graph_node: DataFrame) -> DataFrame:
    """Unsound ends of graph and review edges: ref_table, ref_row_id, field_name, reason, load_month. Copies count once."""
    refs = edge_references(graph_edge, "graph_edge", "edge_row_id").unionByName(
        edge_references(review_edge, "review_edge", "review_row_id")
    )
    parents = graph_node.select(
        F.col("graph_id").alias("scope"), F.col("node_id").alias("key"), F.col("loaded_at").alias("since"), F.col("deleted_at").alias("until")
    )
    found = orphan_references(refs, parents)
    return found.select("ref_table", "ref_row_id", "field_name", "reason", F.col("period").alias("load_month")).distinct()
