import hashlib
import random
import statistics

import pytest

from causeway.operators import panel
from causeway.sources import panels as source

P = "condition_name string, run_no int, report_id long, m double"


def test_t_test():
    assert panel.t_test_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert panel.t_test_p(0.0, 5) == pytest.approx(1.0)


def test_holm_ignores_missing_p(spark):
    rows = spark.createDataFrame([("a", 0.01, 1), ("b", 0.04, 1), ("c", 0.03, 1), ("d", None, 1), ("e", float("nan"), 1)], "t string, p double, family int")
    found = {r.t: r.p_holm for r in panel.holm(rows, "p", ["family"]).collect()}
    assert found["a"] == pytest.approx(0.03) and found["c"] == pytest.approx(0.06) and found["b"] == pytest.approx(0.06) and found["d"] is None and found["e"] is None


def test_complete_reports_and_rollup(spark):
    rows = [(c, r, 1, 0.5) for c in "ab" for r in (1, 2)] + [("a", 1, 2, 1.0), ("b", 1, 2, 0.0), ("b", 2, 2, 0.0)] + [(c, r, 3, 0.1) for c in "ab" for r in (1, 1)]
    df = spark.createDataFrame(rows, P)
    assert {r.report_id for r in panel.complete_reports(df, ["a", "b"], 2).collect()} == {1}
    assert [r.rows for r in panel.rollup(df, ["condition_name"], ["m"]).where("condition_name = 'all'").collect()] == [len(rows)]
    assert panel.rollup(df.limit(0), ["condition_name"], ["m"]).count() <= 1


def test_anova_recovers_a_shift(spark):
    rng = random.Random(4)
    rows = [(c, r, k, 0.5 + (0.1 if c == "b" else 0) + 0.02 * (k % 5) + rng.gauss(0, 0.01)) for c in "ab" for r in (1, 2, 3) for k in range(40)]
    out = {r.condition_name: r for r in panel.balanced_anova(spark.createDataFrame(rows, P), "m", ["a", "b"], 3).collect()}
    assert out["b"].adjusted_mean - out["a"].adjusted_mean == pytest.approx(0.1, abs=4 * out["a"].se_difference)
    assert 0.0003 < out["a"].se_difference < 0.003


def test_bootstrap_holds_the_estimate(spark):
    rng = random.Random(5)
    rows = [("a - b", k, rng.gauss(0.5, 1)) for k in range(200)]
    out = panel.bootstrap_dz(spark.createDataFrame(rows, "contrast string, report_id long, diff double")).first()
    assert out.resamples == 200 and 0.2 < out.low < 0.5 < out.high < 0.85


def test_bootstrap_draws_as_numbers_and_spread(spark):
    rng = random.Random(6)
    rows = [("a - b", k, rng.gauss(0.5, 1)) for k in range(30)]
    made = panel.bootstrap_dz(spark.createDataFrame(rows, "contrast string, report_id long, diff double").coalesce(1), 50)
    # one partition of few rows grows to many, so it goes to all tasks before
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(contrast" in plan.split("Generate explode")[-1]
    dz = []
    for resample in range(1, 51):
        u = [int(hashlib.md5(f"{c}|{k}|{resample}".encode()).hexdigest()[:8], 16) / 2**32 for c, k, _ in rows]
        drawn = [d for x, (_, _, d) in zip(u, rows, strict=True) for _ in range(sum(x >= c for c in panel.POISSON))]
        dz.append(statistics.mean(drawn) / statistics.stdev(drawn))
    low, high = (statistics.quantiles(dz, n=40, method="inclusive")[k] for k in (0, -1))
    out = made.first()
    assert (out.resamples, out.low, out.high) == (50, pytest.approx(low, abs=2e-5), pytest.approx(high, abs=2e-5))


def test_monotonicity(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("b", 1, 0.5), ("b", 2, 0.6), ("c", 1, 0.1)], "c string, s int, v double")
    assert {r.c: r.monotone for r in panel.monotonicity(rows, ["c"], "s", "v").collect()} == {"a": True, "b": False, "c": True}


def test_read_panel(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿run,report,score,status\n1,r1, 0.5 ,ok\n1,r2,,OK\n1,r3,x,failed\n")
    rows = source.read_panel(spark, str(tmp_path / "a.csv"), ["run", "report"], ["score"]).collect()
    assert [r.score for r in sorted(rows, key=lambda r: r.report)] == [0.5, None, None]
    with pytest.raises(ValueError):
        source.read_panel(spark, str(tmp_path / "a.csv"), ["run"], ["score"])
    with pytest.raises(ValueError):
        source.read_panel(spark, str(tmp_path / "a.csv"), ["case"], ["score"])
