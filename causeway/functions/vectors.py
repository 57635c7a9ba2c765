"""Vector expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.keys import _col

#: Positions of vectors that are summed as columns.
WIDE = 128


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector over its length; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, _col(a)).otherwise(F.transform(_col(a), lambda x: x / size))


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine of two vectors; 0 if one is null, empty or zero, or their lengths differ."""
    fit = (F.size(_col(a)) == F.size(_col(b))) & (F.size(_col(a)) > 0)
    sizes = norm(a) * norm(b)
    return F.coalesce(F.when(fit & (sizes > 0), dot(a, b) / sizes), F.lit(0.0))


def mean_vector(df: DataFrame, keys: list[str], vector: str, longest: int, weight: str | None = None) -> DataFrame:
    """The mean vector of each group, by ``weight`` if given: keys, ``vector``; no vector is longer than ``longest``.

    Positions are columns that are summed, pre-aggregated, up to ``WIDE``; longer vectors are summed as rows of cells.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    if not 0 < longest <= WIDE:
        cells = df.select(*keys, times.alias("times"), F.posexplode(vector).alias("at", "x"))
        cells = cells.groupBy(*keys, "at").agg(_mean(F.col("x"), F.col("times")).alias("x"))
        return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("c")).select(*keys, F.col("c.x").alias(vector))
    means = [_mean(F.get(F.col(vector), F.lit(k)), times).alias(f"_{k}") for k in range(longest)]
    out = df.where(F.size(vector) > 0).groupBy(*keys).agg(F.max(F.size(vector)).alias("_size"), *means)
    return out.select(*keys, F.slice(F.array(*(F.col(f"_{k}") for k in range(longest))).cast("array<double>"), F.lit(1), F.col("_size")).alias(vector))


def _mean(x: Column, times: Column) -> Column:
    return F.try_divide(F.sum(x * times), F.sum(F.when(x.isNotNull(), times)).cast("double"))
