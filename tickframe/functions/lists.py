"""Functions of arrays, as expressions; arrays are values, so what changes one returns another.

Indexes count from 0; those of ``get``, ``insert``, ``remove`` and ``set`` count from the end if negative.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def new(size: int, value: Column) -> Column:
    return F.array_repeat(value, size)


def of(*values: Column) -> Column:
    return F.array(*values)


def _at(a: Column, i: int) -> Column:
    return F.lit(i) if i >= 0 else F.size(a) + i


def size(a: Column) -> Column:
    return F.size(a)


def get(a: Column, i: int) -> Column:
    return F.get(a, _at(a, i))


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def set_at(a: Column, i: int, value: Column) -> Column:
    return F.transform(a, lambda x, k: F.when(k == _at(a, i), value).otherwise(x))


def push(a: Column, value: Column) -> Column:
    return F.array_append(a, value)


def unshift(a: Column, value: Column) -> Column:
    return F.array_prepend(a, value)


def pop(a: Column) -> Column:
    """Without the last value, which ``last`` tells."""
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def shift(a: Column) -> Column:
    """Without the first value, which ``first`` tells."""
    return F.slice(a, 2, F.size(a))


def insert(a: Column, i: int, value: Column) -> Column:
    at = _at(a, i)
    return F.concat(F.slice(a, 1, at), F.array(value), F.slice(a, at + 1, F.size(a)))


def remove(a: Column, i: int) -> Column:
    return F.filter(a, lambda _, k: k != _at(a, i))


def clear(a: Column) -> Column:
    return F.slice(a, 1, 0)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def copy(a: Column) -> Column:
    return a


def part(a: Column, begin: int, end: int) -> Column:
    """Values from ``begin`` up to, not with, ``end``."""
    return F.slice(a, begin + 1, max(0, end - begin))


def fill(a: Column, value: Column, begin: int = 0, end: int | None = None) -> Column:
    return F.transform(a, lambda x, k: F.when((k >= begin) & (k < (F.size(a) if end is None else end)), value).otherwise(x))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def includes(a: Column, value: Column) -> Column:
    return F.array_contains(a, value)


def index_of(a: Column, value: Column) -> Column:
    """Where a value first stands, -1 if nowhere."""
    return (F.coalesce(F.array_position(a, value), F.lit(0)) - 1).cast("int")


def last_index_of(a: Column, value: Column) -> Column:
    at = F.coalesce(F.array_position(F.reverse(a), value), F.lit(0))
    return F.when(at == 0, -1).otherwise(F.size(a) - at).cast("int")


def sort(a: Column, rising: bool = True) -> Column:
    return F.sort_array(a, rising)


def sort_indices(a: Column, rising: bool = True) -> Column:
    """Indexes in the order of their values; equal values stay in place."""
    keyed = F.transform(a, lambda x, k: F.struct((x if rising else -x).alias("x"), k.alias("k")))
    return F.transform(F.array_sort(keyed), lambda p: p["k"])


def binary_search(a: Column, value: Column) -> Column:
    """Where a value stands in a sorted array, -1 if nowhere."""
    return index_of(a, value)


def binary_search_leftmost(a: Column, value: Column) -> Column:
    """As above, but where it isn't, the last smaller value's place, -1 before all."""
    return F.when(F.array_contains(a, value), index_of(a, value)).otherwise(F.size(F.filter(a, lambda x: x < value)) - 1)


def binary_search_rightmost(a: Column, value: Column) -> Column:
    """The last of equal values, else the first greater value's place."""
    return F.when(F.array_contains(a, value), F.size(F.filter(a, lambda x: x <= value)) - 1).otherwise(F.size(F.filter(a, lambda x: x < value)))


def join(a: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), separator, "NaN")


# --- numbers in arrays: missing values don't count -------------------------------------------


def _there(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def total(a: Column) -> Column:
    return F.aggregate(_there(a), F.lit(0.0), lambda s, x: s + x)


def average(a: Column) -> Column:
    return F.try_divide(total(a), F.size(_there(a)).cast("double"))


def least(a: Column, nth: int = 0) -> Column:
    """The smallest, or the nth after it."""
    return F.get(F.sort_array(_there(a)), F.lit(nth))


def greatest(a: Column, nth: int = 0) -> Column:
    return F.get(F.sort_array(_there(a), False), F.lit(nth))


def value_range(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def variance(a: Column, biased: bool = True) -> Column:
    there, mean = _there(a), average(a)
    squares = F.aggregate(F.transform(there, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(squares, (F.size(there) - (0 if biased else 1)).cast("double"))


def deviation(a: Column, biased: bool = True) -> Column:
    return F.sqrt(variance(a, biased))


def standardised(a: Column) -> Column:
    """How many deviations each value lies from the mean; 1 each if nothing varies."""
    mean, wide = average(a), deviation(a)
    return F.transform(a, lambda x: F.when(wide == 0, 1.0).otherwise(F.try_divide(x - mean, wide)))


def covariance(a: Column, b: Column, biased: bool = True) -> Column:
    ma, mb = average(a), average(b)
    products = F.aggregate(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(products, (F.size(a) - (0 if biased else 1)).cast("double"))


def median(a: Column) -> Column:
    return percentile_linear(a, 50.0)


def mode(a: Column) -> Column:
    """The commonest value, of several the smallest."""
    there = _there(a)
    counted = F.transform(F.array_distinct(there), lambda x: F.struct((-F.size(F.filter(there, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.array_min(counted)["x"]


def percentile_nearest(a: Column, percent: float) -> Column:
    n = F.size(_there(a))
    return F.get(F.sort_array(_there(a)), F.least(F.greatest(F.ceil(percent / 100 * n).cast("int") - 1, F.lit(0)), n - 1))


def percentile_linear(a: Column, percent: float) -> Column:
    values = F.sort_array(_there(a))
    at = percent / 100 * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    x, y = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return x + (y - x) * (at - low)


def percent_rank(a: Column, i: int) -> Column:
    """Percent of the other values that don't exceed the one at ``i``."""
    value = get(a, i)
    return F.try_divide(100.0 * (F.size(F.filter(a, lambda x: x <= value)) - 1), (F.size(a) - 1).cast("double"))


def every(a: Column) -> Column:
    return F.forall(a, lambda x: F.coalesce(x.cast("boolean"), F.lit(False)))


def some(a: Column) -> Column:
    return F.exists(a, lambda x: F.coalesce(x.cast("boolean"), F.lit(False)))
