"""Steps whose plans go before the next one."""

import weakref

from pyspark.sql import functions as F

from causeway.session import released


def test_a_released_step_keeps_its_rows_and_no_plan(spark):
    seen = []

    def make():
        df = spark.range(100).groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("n"))
        seen.append(weakref.ref(df))
        return df

    out = released(spark, make)
    assert {r.k: r.n for r in out.collect()} == {0: 34, 1: 33, 2: 33} and seen[0]() is None
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
