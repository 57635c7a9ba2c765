from datetime import datetime, timedelta

from causeway.streaming import incremental


def test_transitions_go_on_across_runs(spark, tmp_path):
    events, out, check = (str(tmp_path / x) for x in ("events", "out", "check"))
    row = lambda k, user, kind: (k, datetime(2024, 1, 1) + timedelta(minutes=k), user, kind, 1.0, "{}")
    for part in ([row(1, 1, "a"), row(2, 1, "b"), row(3, 2, "a")], [row(4, 1, "c")]):
        spark.createDataFrame(part, incremental.EVENTS).write.mode("append").parquet(events)
        incremental.run_available(incremental.transitions(incremental.read_events(spark, events)), out, check)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a", "b"), (1, "b", "c")]


def test_windowed_counts_close_behind_the_watermark(spark, tmp_path):
    events, out, check = (str(tmp_path / x) for x in ("events", "out", "check"))
    rows = [(k, datetime(2024, 1, 1) + timedelta(days=k), 1, "a", 1.0, "{}") for k in range(6)]
    spark.createDataFrame(rows, incremental.EVENTS).write.parquet(events)
    incremental.run_available(incremental.windowed_counts(incremental.read_events(spark, events)), out, check)
    assert {r.events for r in spark.read.parquet(out).collect()} == {1}
