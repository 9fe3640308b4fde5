"""Indicators over the list of a frame's values: windowed lists and higher-order functions, in the JVM throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.windows import Series


def _list(s: Series, x: Column, n: int, skip: bool) -> Column:
    """The frame's values, oldest first; NULL unless it holds n of them."""
    values = F.collect_list(x).over(s.over(x, n) if skip else s.slots(n))
    return F.when((x.isNotNull() if skip else F.lit(True)) & (F.size(values) == n), values)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _weighted(values: Column, weights: list[float]) -> Column:
    return _sum(F.zip_with(values, F.array(*map(F.lit, weights)), lambda x, w: x * w))


def wma(s: Series, x: Column, n: int) -> Column:
    """Weights 1 to n, the newest the heaviest."""
    return _weighted(_list(s, x, n, True), [float(i + 1) for i in range(n)]) / (n * (n + 1) / 2)


def hma(df: DataFrame, s: Series, x: str, n: int, out: str) -> DataFrame:
    """Hull average: WMA over sqrt(n) of twice the WMA over n / 2 less that over n."""
    inner = 2 * wma(s, F.col(x), max(1, n // 2)) - wma(s, F.col(x), n)
    steps = df.withColumn("_hull", inner)
    return steps.withColumn(out, wma(Series(s.keys, s.time), F.col("_hull"), max(1, int(math.sqrt(n))))).drop("_hull")


def alma(s: Series, x: Column, n: int, offset: float = 0.85, sigma: float = 6.0) -> Column:
    m, width = offset * (n - 1), n / sigma
    weights = [math.exp(-((i - m) ** 2) / (2 * width * width)) for i in range(n)]
    return _weighted(_list(s, x, n, False), weights) / sum(weights)


def cog(s: Series, x: Column, n: int) -> Column:
    values = _list(s, x, n, True)
    return -_weighted(values, [float(n - i) for i in range(n)]) / F.nullif(_sum(values), F.lit(0.0))


def deviation(s: Series, x: Column, n: int) -> Column:
    """Mean absolute deviation from the mean."""
    values = _list(s, x, n, True)
    return _sum(F.transform(values, lambda v: F.abs(v - _sum(values) / n))) / n


def cci(s: Series, x: Column, n: int) -> Column:
    """0 where nothing deviates."""
    values = _list(s, x, n, True)
    mean, wide = _sum(values) / n, deviation(s, x, n)
    return F.when(wide == 0, 0.0).otherwise((x - mean) / (0.015 * wide))


def rci(s: Series, x: Column, n: int) -> Column:
    """Spearman's rank correlation with time, times 100; ties share the mean rank."""
    values = _list(s, x, n, True)
    rank = lambda v: F.size(F.filter(values, lambda o: o < v)) + (F.size(F.filter(values, lambda o: o == v)) + 1) / 2.0
    squares = _sum(F.transform(values, lambda v, i: (rank(v) - (i + 1)) * (rank(v) - (i + 1))))
    return 100 * (1 - 6 * squares / (n * (n * n - 1))) if n > 1 else F.lit(None).cast("double")


def highest_bars(s: Series, x: Column, n: int) -> Column:
    """Offset (0 or less) to the greatest value, of several the oldest."""
    values = _list(s, x, n, True)
    return (F.array_position(values, F.array_max(values)) - n).cast("int")


def lowest_bars(s: Series, x: Column, n: int) -> Column:
    values = _list(s, x, n, True)
    return (F.array_position(values, F.array_min(values)) - n).cast("int")


def linreg(s: Series, x: Column, n: int, offset: int = 0) -> Column:
    """Least-squares line's value ``offset`` bars before the newest."""
    values = _list(s, x, n, False)
    mean_i, square = (n - 1) / 2, n * (n * n - 1) / 12
    mean = _sum(values) / n
    slope = _weighted(values, [i - mean_i for i in range(n)]) / square if n > 1 else F.lit(0.0)
    return mean + slope * (n - 1 - offset - mean_i)


def percent_rank(s: Series, x: Column, n: int) -> Column:
    """Percent of the n slots before that hold a value which doesn't exceed this one; NULL if none holds a value."""
    before = F.collect_list(x).over(s.slots().rowsBetween(-n, -1))
    share = 100.0 * F.size(F.filter(before, lambda v: v <= x + 1e-10)) / n
    return s.ripe(n + 1, F.when(x.isNotNull() & (F.size(before) > 0), share))


def percentile_nearest(s: Series, x: Column, n: int, percent: float) -> Column:
    k = min(n, max(1, math.ceil(percent / 100 * n)))
    return F.element_at(F.sort_array(_list(s, x, n, False)), k)


def percentile_linear(s: Series, x: Column, n: int, percent: float) -> Column:
    at = percent / 100 * (n - 1)
    low, values = int(at), F.sort_array(_list(s, x, n, False))
    a, b = F.element_at(values, low + 1), F.element_at(values, min(low + 2, n))
    return a + (b - a) * (at - low)
