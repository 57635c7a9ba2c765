"""Session helpers: a test session, durable lineage cuts and checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast, and the bytes that a row takes beside its texts and lists.
BROADCAST_ROWS, BROADCAST_BYTES, ROW_BYTES = 100_000, 32 << 20, 64


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session of one machine with the settings that the tests and the bench use; its checkpoints go when it ends."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("causeway")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder that all executors share, the session's ``spark.checkpoint.dir``.

    A local master may do without the setting and gets a folder of its own; on a cluster a folder of one machine would be
    lost with it, so there the setting must be given.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def released(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, durable; then the plans and shuffle files behind it go.

    They stay until the driver happens to collect its garbage. For plans of several large steps, once a step; ``make``
    is a function so that no variable of the caller holds its plan.
    """
    out = durable(make())
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes, else leave the join to Catalyst and AQE.

    Call it with a checkpointed or otherwise cheap ``df``. Rows are counted up to the bound only; the bytes are the
    lengths of its strings, binaries and arrays (as JSON) with ``ROW_BYTES`` a row for all else.
    """
    grows = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    lengths = sum((F.coalesce(_length(df, c), F.lit(0)) for c in grows), F.lit(ROW_BYTES))
    size = df.limit(rows + 1).select(lengths.alias("n")).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    return F.broadcast(df) if size.rows <= rows and (size.bytes or 0) <= BROADCAST_BYTES else df


def _length(df: DataFrame, name: str) -> Column:
    plain = df.schema[name].dataType.typeName() in ("string", "binary")
    return F.octet_length(F.col(f"`{name}`") if plain else F.to_json(F.struct(F.col(f"`{name}`"))))
