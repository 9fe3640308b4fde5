"""Numbers: arithmetic that knows missing values, casts, angles, deterministic random numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickframe.functions.scalars import half_away

#: Functions of one number that are Spark's own.
PLAIN = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceil": F.ceil, "cos": F.cos, "exp": F.exp, "floor": F.floor,
    "sign": F.signum, "sin": F.sin, "tan": F.tan, "todegrees": F.degrees, "toradians": F.radians,
}


def log(x: Column) -> Column:
    """Natural logarithm; NULL unless x is positive."""
    return F.when(x > 0, F.log(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def power(x: Column, y: Column | float) -> Column:
    """x to the y; NULL where that is no real number."""
    found = F.pow(x, y)
    return F.when(~F.isnan(found), found)


def rounded(x: Column, digits: int | None = None) -> Column:
    """To whole numbers, or decimals; halves go away from zero."""
    return half_away(x) if not digits else half_away(x * 10.0**digits) / 10.0**digits


def divide(a: Column, b: Column) -> Column:
    """A quotient is never whole-numbered; NULL by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def remainder(a: Column, b: Column) -> Column:
    """What is left of a truncated division, with the sign of ``a``; NULL by zero."""
    return F.try_mod(a.cast("double"), b.cast("double"))


def _known(columns: tuple[Column, ...], value: Column) -> Column:
    all_there = columns[0].isNotNull()
    for c in columns[1:]:
        all_there = all_there & c.isNotNull()
    return F.when(all_there, value)


def greatest(*columns: Column) -> Column:
    """The greatest; NULL if one is missing."""
    return _known(columns, F.greatest(*columns))


def least(*columns: Column) -> Column:
    return _known(columns, F.least(*columns))


def average(*columns: Column) -> Column:
    return sum(columns[1:], columns[0]) / len(columns)


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def to_int(x: Column) -> Column:
    """Cut towards zero; NULL stays, and what is no number is NULL."""
    return x.try_cast("double").try_cast("int")


def to_bool(x: Column) -> Column:
    """Whether a number isn't zero; a missing value is false."""
    return F.coalesce(x.try_cast("double") != 0, F.lit(False))


def to_text(x: Column) -> Column:
    return x.cast("string")


def fixnan(x: Column, over: WindowSpec) -> Column:
    """x, or the last value that was there, over a window of all rows so far."""
    return F.last(x, ignorenulls=True).over(over)


def random(low: float, high: float, seed: int, site: int, index: Column) -> Column:
    """A number from low to high that only seed, call site and row number decide."""

    @F.pandas_udf("double")
    def draw(bar: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            x = np.uint64(seed) ^ (np.uint64(site) + _GOLDEN) ^ ((bar.to_numpy(dtype=np.int64).astype(np.uint64) + np.uint64(1)) * _M1)
            x = x + _GOLDEN
            x = (x ^ (x >> np.uint64(30))) * _M1
            x = (x ^ (x >> np.uint64(27))) * _M2
            x ^= x >> np.uint64(31)
        return pd.Series(low + (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 * (high - low))

    return draw(index)


# Constants of the published SplitMix64 generator.
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Constants that scripts name.
CONSTANTS = {"pi": math.pi, "e": math.e, "phi": (1 + 5**0.5) / 2, "rphi": (5**0.5 - 1) / 2}
