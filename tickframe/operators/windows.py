"""Indicators that are functions of a row frame: built-in windows only, one sort of each symbol for all.

A missing value is NULL. Operators that skip missing values run over the rows that have one
(``Series.over``); those that give a missing value a slot run over all rows (``Series.slots``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """How rows make a series. ``dense`` promises that no source is NULL, which spares a sort."""

    keys: tuple[str, ...] = ("symbol",)
    time: str = "ts"
    dense: bool = False

    def slots(self, n: int | None = None) -> WindowSpec:
        w = Window.partitionBy(*self.keys).orderBy(self.time)
        return w if n is None else w.rowsBetween(1 - n, 0)

    def over(self, x: Column, n: int | None = None) -> WindowSpec:
        if self.dense:
            return self.slots(n)
        w = Window.partitionBy(*self.keys, x.isNotNull()).orderBy(self.time)
        return w if n is None else w.rowsBetween(1 - n, 0)

    def running(self) -> WindowSpec:
        return self.slots().rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.slots())

    def full(self, x: Column, n: int, value: Column) -> Column:
        """``value`` where x is present and the frame of n present values is full."""
        return F.when(x.isNotNull() & (F.count(x).over(self.over(x, n)) == n), value)

    def ripe(self, n: int, value: Column) -> Column:
        """``value`` once there are n rows."""
        return F.when(F.row_number().over(self.slots()) >= n, value)

    def held(self, x: Column) -> Column:
        """x, or the last value that was present."""
        return x if self.dense else F.last(x, ignorenulls=True).over(self.running())


def divided(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


# --- history and sources --------------------------------------------------------------------


def hl2() -> Column:
    return (F.col("high") + F.col("low")) / 2


def hlc3() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def ohlc4() -> Column:
    return (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4


def hlcc4() -> Column:
    return (F.col("high") + F.col("low") + 2 * F.col("close")) / 4


def source(name: str) -> Column:
    """One of a bar's own series by name: a column, or a mean of columns."""
    derived = {"hl2": hl2, "hlc3": hlc3, "ohlc4": ohlc4, "hlcc4": hlcc4}
    return derived[name]() if name in derived else F.col(name)


# --- moving averages ------------------------------------------------------------------------


def sma(s: Series, x: Column, n: int) -> Column:
    """Mean of the last n present values; a missing one holds the value before."""
    return s.held(s.full(x, n, F.avg(x).over(s.over(x, n))))


def rolling_sum(s: Series, x: Column, n: int) -> Column:
    return s.held(s.full(x, n, F.sum(x).over(s.over(x, n))))


def vwma(s: Series, x: Column, v: Column, n: int) -> Column:
    both = F.when(x.isNotNull() & v.isNotNull(), x * v)
    w = s.over(both, n)
    return s.full(both, n, divided(F.sum(both).over(w), F.sum(v).over(w)))


def swma(s: Series, x: Column) -> Column:
    return (s.lag(x, 3) + 2 * s.lag(x, 2) + 2 * s.lag(x, 1) + x) / 6


# --- oscillators ----------------------------------------------------------------------------


def change(s: Series, x: Column, n: int = 1) -> Column:
    return x - s.lag(x, n)


def momentum(s: Series, x: Column, n: int) -> Column:
    return F.when(x.isNotNull(), x - F.lag(x, n).over(s.over(x)))


def roc(s: Series, x: Column, n: int) -> Column:
    before = F.lag(x, n).over(s.over(x))
    return F.when(x.isNotNull(), 100 * divided(x - before, before))


def crossover(s: Series, a: Column, b: Column) -> Column:
    pa, pb = s.lag(a), s.lag(b)
    return F.coalesce((a > b) & ((pa <= pb) | (pa.isNull() & pb.isNotNull())), F.lit(False))


def crossunder(s: Series, a: Column, b: Column) -> Column:
    pa, pb = s.lag(a), s.lag(b)
    return F.coalesce((a < b) & ((pa >= pb) | (pa.isNull() & pb.isNotNull())), F.lit(False))


def cross(s: Series, a: Column, b: Column) -> Column:
    """The sign of a - b differs from the last sign that wasn't a tie."""
    sign = F.signum(a - b)
    earlier = F.last(F.when(sign != 0, sign), ignorenulls=True).over(s.slots().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce((sign != 0) & (sign != earlier), F.lit(False))


def stochastic(s: Series, x: Column, high: Column, low: Column, n: int) -> Column:
    top, bottom = highest(s, high, n), lowest(s, low, n)
    return 100 * divided(x - bottom, top - bottom)


def williams_r(s: Series, n: int) -> Column:
    top, bottom = highest(s, F.col("high"), n), lowest(s, F.col("low"), n)
    return -100 * divided(top - F.col("close"), top - bottom)


def rising(s: Series, x: Column, n: int) -> Column:
    """1.0 if x exceeds each of the n values before it, else 0.0; never missing."""
    before = s.slots().rowsBetween(-n, -1)
    return F.when((F.count(x).over(before) == n) & (x > F.max(x).over(before)), 1.0).otherwise(0.0)


def falling(s: Series, x: Column, n: int) -> Column:
    before = s.slots().rowsBetween(-n, -1)
    return F.when((F.count(x).over(before) == n) & (x < F.min(x).over(before)), 1.0).otherwise(0.0)


def mfi(s: Series, x: Column, v: Column, n: int) -> Column:
    """Money flow index: 100 where nothing flowed out; needs n + 1 bars."""
    before = s.lag(x)
    w = s.slots(n)
    up = F.sum(F.when(x > before, x * v).otherwise(0.0)).over(w)
    down = F.sum(F.when(x < before, x * v).otherwise(0.0)).over(w)
    return s.ripe(n + 1, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + divided(up, down))))


def cmo(s: Series, x: Column, n: int) -> Column:
    d, w = x - s.lag(x), s.slots(n)
    up, down = F.sum(F.greatest(d, F.lit(0.0))).over(w), F.sum(F.greatest(-d, F.lit(0.0))).over(w)
    return s.ripe(n + 1, 100 * divided(up - down, up + down))


# --- volatility and bands -------------------------------------------------------------------


def true_range(s: Series, handle_missing: bool = False) -> Column:
    """The first bar has none, or high - low if ``handle_missing``."""
    h, low, before = F.col("high"), F.col("low"), s.lag(F.col("close"))
    full = F.greatest(h - low, F.abs(h - before), F.abs(low - before))
    return F.when(before.isNotNull(), full).otherwise(h - low if handle_missing else F.lit(None).cast("double"))


def stdev(s: Series, x: Column, n: int, biased: bool = True) -> Column:
    return s.full(x, n, (F.stddev_pop if biased else F.stddev_samp)(x).over(s.over(x, n)))


def variance(s: Series, x: Column, n: int, biased: bool = True) -> Column:
    return s.full(x, n, (F.var_pop if biased else F.var_samp)(x).over(s.over(x, n)))


def bollinger(s: Series, x: Column, n: int, mult: float) -> Column:
    """struct(middle, upper, lower)."""
    mid, wide = sma(s, x, n), stdev(s, x, n) * mult
    return F.struct(mid.alias("middle"), (mid + wide).alias("upper"), (mid - wide).alias("lower"))


def bollinger_width(s: Series, x: Column, n: int, mult: float) -> Column:
    """Width of the bands in percent of the middle."""
    return 100 * divided(2 * mult * stdev(s, x, n), sma(s, x, n))


# --- extremes, volume, cumulative -----------------------------------------------------------


def highest(s: Series, x: Column, n: int) -> Column:
    return s.ripe(n, F.max(x).over(s.slots(n)))


def lowest(s: Series, x: Column, n: int) -> Column:
    return s.ripe(n, F.min(x).over(s.slots(n)))


def value_range(s: Series, x: Column, n: int) -> Column:
    return highest(s, x, n) - lowest(s, x, n)


def pivot_high(s: Series, x: Column, left: int, right: int) -> Column:
    """The value ``right`` bars ago if none to its left is above it and all to its right are below."""
    centre, n = s.lag(x, right), left + right + 1
    lefts, rights = s.slots().rowsBetween(-n + 1, -right - 1), s.slots(right)
    whole = F.count(x).over(s.slots(n)) == n
    return F.when(whole & (centre >= F.max(x).over(lefts)) & (centre > F.max(x).over(rights)), centre)


def pivot_low(s: Series, x: Column, left: int, right: int) -> Column:
    centre, n = s.lag(x, right), left + right + 1
    lefts, rights = s.slots().rowsBetween(-n + 1, -right - 1), s.slots(right)
    whole = F.count(x).over(s.slots(n)) == n
    return F.when(whole & (centre <= F.min(x).over(lefts)) & (centre < F.min(x).over(rights)), centre)


def median(s: Series, x: Column, n: int) -> Column:
    return s.full(x, n, F.percentile(x, 0.5).over(s.over(x, n)))


def mode(s: Series, x: Column, n: int) -> Column:
    """The most frequent value, of several the smallest."""
    return s.full(x, n, F.mode(x, True).over(s.over(x, n)))


def cumulative(s: Series, x: Column) -> Column:
    return F.coalesce(F.sum(x).over(s.running()), F.lit(0.0))


def all_time_max(s: Series, x: Column) -> Column:
    return F.max(x).over(s.running())


def all_time_min(s: Series, x: Column) -> Column:
    return F.min(x).over(s.running())


def obv(s: Series) -> Column:
    moved = F.signum(F.col("close") - s.lag(F.col("close"))) * F.col("volume")
    return cumulative(s, F.coalesce(moved, F.lit(0.0)))


def accumulation(s: Series) -> Column:
    h, low, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    return cumulative(s, F.coalesce(divided((c - low) - (h - c), h - low) * v, F.lit(0.0)))


def pvt(s: Series) -> Column:
    before = s.lag(F.col("close"))
    return cumulative(s, F.coalesce(divided(F.col("close") - before, before) * F.col("volume"), F.lit(0.0)))


def wad(s: Series) -> Column:
    c, before = F.col("close"), s.lag(F.col("close"))
    gain = F.when(c > before, c - F.least(F.col("low"), before)).when(c < before, c - F.greatest(F.col("high"), before)).otherwise(0.0)
    return cumulative(s, gain)


def wvad() -> Column:
    wide = F.col("high") - F.col("low")
    return F.coalesce(divided(F.col("close") - F.col("open"), wide) * F.col("volume"), F.lit(0.0))


def iii() -> Column:
    wide = F.col("high") - F.col("low")
    return F.coalesce(divided(2 * F.col("close") - F.col("high") - F.col("low"), wide) * F.col("volume"), F.lit(0.0))


def _session(s: Series) -> WindowSpec:
    day = F.date_trunc("day", F.col(s.time))
    return Window.partitionBy(*s.keys, day).orderBy(s.time).rowsBetween(Window.unboundedPreceding, 0)


def vwap(s: Series, x: Column, v: Column) -> Column:
    """Volume-weighted mean since the start of the UTC day."""
    w = _session(s)
    return divided(F.sum(x * v).over(w), F.sum(v).over(w))


def vwap_bands(s: Series, x: Column, v: Column, mult: float) -> Column:
    """struct(vwap, upper, lower) at ``mult`` weighted deviations."""
    w, mean = _session(s), vwap(s, x, v)
    wide = mult * F.sqrt(F.greatest(divided(F.sum(x * x * v).over(w), F.sum(v).over(w)) - mean * mean, F.lit(0.0)))
    return F.struct(mean.alias("vwap"), (mean + wide).alias("upper"), (mean - wide).alias("lower"))


# --- events, regression ---------------------------------------------------------------------


def bars_since(s: Series, condition: Column) -> Column:
    n = F.row_number().over(s.slots())
    return n - F.last(F.when(condition, n), ignorenulls=True).over(s.running())


def value_when(df: DataFrame, s: Series, condition: Column, x: Column, occurrence: int, out: str) -> DataFrame:
    """``df`` with x at the latest true condition but ``occurrence``.

    Each true row looks back ``occurrence`` true rows; the others take what the last true row has.
    """
    hit = F.coalesce(condition, F.lit(False))
    hits = Window.partitionBy(*s.keys, "_hit").orderBy(s.time)
    rows = df.withColumns({"_hit": hit, "_x": x})
    rows = rows.withColumn("_at", F.when(F.col("_hit"), F.struct(F.lag("_x", occurrence).over(hits).alias("v"))))
    return rows.withColumn(out, F.last("_at", ignorenulls=True).over(s.running())["v"]).drop("_hit", "_x", "_at")


def correlation(s: Series, x: Column, y: Column, n: int) -> Column:
    """Pearson over n slots; 0.0 where one of them doesn't vary; missing if a slot is."""
    w = s.slots(n)
    sx, sy = F.stddev_pop(x).over(w), F.stddev_pop(y).over(w)
    whole = (F.count(x).over(w) == n) & (F.count(y).over(w) == n)
    return F.when(whole, F.coalesce(F.try_divide(F.covar_pop(x, y).over(w), sx * sy), F.lit(0.0)))
