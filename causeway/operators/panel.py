"""Repeated-measures panels: (condition_name, run_no, report_id) with metrics.

Aggregations are two-level and pre-aggregated; nothing gathers the rows of a condition in one task. Means of values with
six decimals are taken over whole millionths, so they don't depend on the order of summation.
"""

from __future__ import annotations

import math
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.assign import spread


def exact_mean(value: Column | str) -> Column:
    """The mean of values with six decimals."""
    col = F.col(value) if isinstance(value, str) else value
    return F.sum(F.round(col * 1e6).cast("long")).cast("double") / F.count(col) / F.lit(1e6)


def rollup(panel: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Counts and means for every prefix of the keys, ``all`` standing for the rest."""
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    cube = panel.select(*named, *metrics).rollup(*keys)
    out = cube.agg(F.count("*").alias("rows"), *(exact_mean(m).alias(f"mean_{m}") for m in metrics))
    return out.select(*(F.coalesce(k, F.lit("all")).alias(k) for k in keys), "rows", *(f"mean_{m}" for m in metrics))


def run_summary(panel: DataFrame, metric: str) -> DataFrame:
    """Per condition: the mean of the run means, their spread, and the spread in percent of the mean."""
    runs = panel.groupBy("condition_name", "run_no").agg(exact_mean(metric).alias("m"))
    out = runs.groupBy("condition_name").agg(F.count("*").alias("runs"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    cv = F.when(F.col("mean") != 0, 100 * F.col("sd") / F.col("mean"))
    return out.select("condition_name", "runs", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(cv, 4).alias("cv_percent"))


def report_means(panel: DataFrame, metric: str, conditions: list[str]) -> DataFrame:
    """A column for each condition with the report's mean over the runs."""
    return panel.groupBy("report_id").pivot("condition_name", conditions).agg(exact_mean(metric))


def complete_reports(panel: DataFrame, conditions: list[str], runs: int) -> DataFrame:
    """The rows of reports that have every cell (condition, run) exactly once, of these conditions."""
    own = panel.where(F.col("condition_name").isin(conditions))
    cells = own.groupBy("report_id").agg(F.count("*").alias("n"), F.countDistinct("condition_name", "run_no").alias("cells"))
    whole = cells.where((F.col("n") == len(conditions) * runs) & (F.col("cells") == len(conditions) * runs)).select("report_id")
    return own.join(whole, "report_id", "left_semi")


def differences(panel: DataFrame, metric: str, conditions: list[str]) -> DataFrame:
    """contrast, report_id, diff: the differences of the report means of each two conditions."""
    means = report_means(panel, metric, conditions)
    pairs = list(combinations(conditions, 2))
    rows = F.array(*(F.struct(F.lit(f"{a} - {b}").alias("contrast"), (F.col(a) - F.col(b)).alias("diff")) for a, b in pairs))
    return means.select("report_id", F.explode(rows).alias("x")).select("x.contrast", "report_id", "x.diff").where("diff is not null")


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def t_test_p(t: float, df: float) -> float:
    """The two-sided p-value of a t statistic."""
    return _beta_tail(df / (df + t * t), df / 2, 0.5)


def t_quantile(df: float, level: float = 0.95) -> float:
    """The t beyond which both tails together hold 1 - level, by bisection."""
    low, high = 0.0, 1.0
    while t_test_p(high, df) > 1 - level:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_test_p(mid, df) > 1 - level else (low, mid)
    return high


def t_interval(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and 95 % t-interval of a value within ``by``; of one value the interval is the value."""
    out = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_score"), F.stddev_samp(value).alias("sd_score"))

    def quantiles(n: pa.Array) -> pa.Array:
        return pa.array([t_quantile(k - 1) if k > 1 else 0.0 for k in n.to_pylist()], pa.float64())

    half = F.coalesce(F.arrow_udf(quantiles, "double")("n") * F.col("sd_score") / F.sqrt("n"), F.lit(0.0))
    ends = {"ci_low": F.round(F.col("mean_score") - half, 6), "ci_high": F.round(F.col("mean_score") + half, 6)}
    return out.withColumns(ends).select(*by, F.round("mean_score", 6).alias("mean_score"), "ci_low", "ci_high")


def _p_values(t: pa.Array, df: pa.Array) -> pa.Array:
    pairs = zip(t.to_pylist(), df.to_pylist(), strict=True)
    return pa.array([None if x is None or n is None or n < 1 else t_test_p(x, n) for x, n in pairs], pa.float64())


def contrasts(diffs: DataFrame) -> DataFrame:
    """Per contrast: reports, mean difference, its spread, Cohen's d_z (null without spread), t and its p-value."""
    out = diffs.groupBy("contrast").agg(F.count("*").alias("reports"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"))
    dz = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd"))
    out = out.withColumn("dz", dz).withColumn("t", F.col("dz") * F.sqrt(F.col("reports")))
    p = F.arrow_udf(_p_values, "double")(F.col("t"), (F.col("reports") - 1).cast("double"))
    return out.select("contrast", "reports", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("dz", 5).alias("dz"), F.round("t", 5).alias("t"), F.round(p, 6).alias("p"))


def holm(tests: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Add ``p_holm``, the step-down adjusted p-value, in the family ``by``; non-finite p-values don't count and get null.

    A family holds the tests of a study, tens of rows, and is one window.
    """
    finite = F.col(p).isNotNull() & ~F.isnan(p)
    family = Window.partitionBy(*by)
    order = family.orderBy(F.when(finite, F.col(p)).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    step = (F.count_if(finite).over(family) - F.row_number().over(family.orderBy(F.when(finite, F.col(p)).asc_nulls_last())) + 1) * F.col(p)
    stepped = tests.withColumn("_step", step)
    return stepped.withColumn("p_holm", F.when(finite, F.least(F.lit(1.0), F.max("_step").over(order)))).drop("_step")


def balanced_anova(panel: DataFrame, metric: str, conditions: list[str], runs: int) -> DataFrame:
    """The additive model report + condition + run on the complete reports, in closed form: one row for each condition.

    Gives the adjusted mean and its standard error, and the standard error of a difference of conditions.
    """
    rows = complete_reports(panel, conditions, runs).select("report_id", "condition_name", "run_no", F.col(metric).alias("y"))
    n_conditions = len(conditions)
    by_report = rows.groupBy("report_id").agg(F.avg("y").alias("report_mean"))
    by_condition = rows.groupBy("condition_name").agg(F.avg("y").alias("condition_mean"))
    by_run = rows.groupBy("run_no").agg(F.avg("y").alias("run_mean"))
    total = rows.agg(F.avg("y").alias("m"), F.count_distinct("report_id").alias("n"))
    # total is one row, conditions and runs are those of the study
    left = rows.join(by_report, "report_id").join(F.broadcast(by_condition), "condition_name").join(F.broadcast(by_run), "run_no").crossJoin(F.broadcast(total))
    rest = F.col("y") - F.col("report_mean") - F.col("condition_mean") - F.col("run_mean") + 2 * F.col("m")
    between = (F.col("report_mean") - F.col("m")) ** 2
    sums = left.agg(F.sum(rest * rest).alias("residual"), (F.sum(between) / (n_conditions * runs)).alias("between"), F.max("n").alias("n"))
    cells = n_conditions * runs
    free = F.col("n") * cells - F.col("n") - n_conditions - runs + 2
    sigma = F.when(free > 0, F.col("residual") / free)
    tau = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("between") * cells / (F.col("n") - 1) - F.col("sigma")) / cells))
    nan = F.lit(float("nan"))
    errors = sums.withColumn("sigma", sigma).withColumn("tau", tau).select(
        F.coalesce(F.round(F.sqrt(F.col("tau") / F.col("n") + F.col("sigma") / (F.col("n") * runs)), 6), nan).alias("se"),
        F.coalesce(F.round(F.sqrt(2 * F.col("sigma") / (F.col("n") * runs)), 6), nan).alias("se_difference"),
    )
    return by_condition.crossJoin(F.broadcast(errors)).select("condition_name", F.round("condition_mean", 6).alias("adjusted_mean"), "se", "se_difference")


#: The chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def bootstrap_dz(diffs: DataFrame, resamples: int = 200) -> DataFrame:
    """Percentile interval of d_z by a Poisson bootstrap: contrast, low, high.

    Each report gets a weight in each resample, drawn by a hash, so the resamples are sums that pre-aggregate anywhere.
    """
    # numbers are compared as the eight digits of their hashes; few rows are much work, so they are spread before they grow
    digits = F.md5(F.concat_ws("|", F.col("contrast"), F.col("report_id").cast("string"), F.col("resample").cast("string")))
    weight = sum((F.when(F.col("u") >= f"{math.ceil(c * 4294967296):08x}", 1).otherwise(0) for c in POISSON), F.lit(0))
    rows = diffs.select("contrast", "report_id", "diff")
    drawn = spread(rows, "contrast", "report_id").select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    drawn = drawn.withColumn("u", digits).withColumn("w", weight)
    sums = drawn.groupBy("contrast", "resample").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("diff")).alias("s"), F.sum(F.col("w") * F.col("diff") * F.col("diff")).alias("q"))
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    dz = sums.where("n > 1").withColumn("dz", F.when(var > 1e-15, mean / F.sqrt(var))).where("dz is not null")
    return dz.groupBy("contrast").agg(F.count("*").alias("resamples"), F.round(F.percentile("dz", F.lit(0.025)), 5).alias("low"), F.round(F.percentile("dz", F.lit(0.975)), 5).alias("high"))


def kernel_density(rows: DataFrame, by: str, value: str, grid: list[float], width: float) -> DataFrame:
    """Gaussian density of a value on a fixed grid: ``by``, x, density. Each row adds to the grid, pre-aggregated."""
    at = rows.select(by, F.col(value).alias("v"), F.explode(F.array(*map(F.lit, grid))).alias("x"))
    z = (F.col("x") - F.col("v")) / F.lit(width)
    kernel = F.exp(-0.5 * z * z) / F.lit(width * math.sqrt(2 * math.pi))
    return at.groupBy(by, "x").agg(F.round(F.avg(kernel), 6).alias("density"))


def monotonicity(means: DataFrame, by: list[str], order: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Whether a value never rises along ``order`` within ``by``, and where it rises most."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    rise = F.col(value) - before
    return means.withColumn("rise", rise).groupBy(*by).agg(F.coalesce(F.bool_and(F.col("rise") <= tolerance), F.lit(True)).alias("monotone"), F.round(F.max("rise"), 6).alias("greatest_rise"))
