"""Incremental recompute with Structured Streaming: transitions of users and late-tolerant counts of events.

The batch operators need nothing from here; new files of events are worked off by ``availableNow`` with a checkpoint, so
a run that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the parquet files that come into a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value per type and window; what comes later than ``late`` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def transitions(events: DataFrame) -> DataFrame:
    """user_id, source, target for each event of a user that follows another, across batches.

    The state of a user is the last event type; events of one batch are taken in order of time and id.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        kinds = [last, *rows["event_type"]]
        state.update((kinds[-1],))
        pairs = [(key[0], a, b) for a, b in zip(kinds, kinds[1:], strict=False) if a is not None]
        yield pd.DataFrame(pairs, columns=["user_id", "source", "target"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, source string, target string", "last string", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there and stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
