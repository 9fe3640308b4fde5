"""Timeframes: parsing, aggregation of bars, as-of merges of higher ones, synthesis of lower ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.operators import recurrences
from tickframe.plans.periods import calendar_period, tf_ratio, tf_seconds

#: Timeframes that a feed can be told to have.
DETECTABLE = {"1": 60, "3": 180, "5": 300, "15": 900, "30": 1800, "60": 3600, "120": 7200, "240": 14_400, "D": 86_400, "W": 604_800}


def bucket(tf: str, ts: str = "ts") -> Column:
    """The start of the bucket that holds ``ts``: UTC days, Monday weeks, calendar months, or multiples of the epoch."""
    period = calendar_period(tf)
    if period:
        return F.date_trunc(period, F.col(ts)).cast("timestamp_ntz")
    size = tf_seconds(tf)
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(size))).cast("timestamp_ntz")


def tf_change(tf: str, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> Column:
    """Whether a bar begins another bucket than the bar before; not so for the first."""
    own = bucket(tf, ts)
    return F.coalesce(own != F.lag(own).over(Window.partitionBy(*keys).orderBy(ts)), F.lit(False))


def detect(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", first: int = 100) -> DataFrame:
    """(keys, tf): the nearest timeframe to the median of each series' first positive steps."""
    w = Window.partitionBy(*keys).orderBy(ts)
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    steps = bars.select(*keys, ts, (seconds - F.lag(seconds).over(w)).alias("step")).where("step > 0")
    steps = steps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    middle = F.percentile("step", 0.5)
    options = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for n, s in DETECTABLE.items()])
    nearest = F.array_min(F.transform(options, lambda o: F.struct(F.abs(o["s"] - F.col("m")), o["s"], o["n"])))
    return steps.groupBy(*keys).agg(middle.alias("m")).select(*keys, nearest["n"].alias("tf"))


def resample(bars: DataFrame, tf: str, keys: tuple[str, ...] = ("symbol",), complete: int | None = None, first_traded: bool = False) -> DataFrame:
    """Bars of a higher timeframe, labelled by their first bar; ``complete`` drops a last bucket of fewer bars.

    ``first_traded`` takes the open of the first bar with volume, if one has, and rounds volumes to six digits,
    as derived feeds have them.
    """
    opened, volume = F.min_by("open", "ts"), F.sum("volume")
    if first_traded:
        volume = F.round(volume, 6)
        opened = F.coalesce(F.min_by("open", F.when(F.col("volume") > 0, F.col("ts"))), opened)
    grouped = bars.groupBy(*keys, bucket(tf).alias("bucket")).agg(
        F.min("ts").alias("ts"), opened.alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), volume.alias("volume"), F.count("*").alias("bars")
    )
    if complete:
        last = F.lead("bucket").over(Window.partitionBy(*keys).orderBy("bucket")).isNull()
        grouped = grouped.withColumn("_last", last).where(~F.col("_last") | (F.col("bars") >= complete)).drop("_last")
    return grouped


def converted(rows: DataFrame, curve: DataFrame, amounts: tuple[str, ...], ts: str = "ts", before: float = 1.0) -> DataFrame:
    """``rows`` with ``amounts`` in another currency: times the rate of ``curve`` (ts, rate) in force at each row's time.

    Before the first point ``before`` holds, after the last its rate. The curve is dealt out by days, on
    each of which it begins with the rate in force at midnight, so rows are matched a day at a time
    and no task gets more than a day's.
    """
    last = rows.agg(F.max(ts)).first()[0]
    if last is None:
        return rows
    after = F.lead("ts").over(Window.orderBy("ts"))  # the curve has a row a day or so
    known = curve.select("ts", "rate").withColumn("_to", F.coalesce(after, F.greatest(F.lit(last).cast("timestamp_ntz"), F.col("ts")) + F.expr("interval 1 day")))
    days = F.filter(F.sequence(F.date_add(F.col("ts").cast("date"), 0), F.col("_to").cast("date")), lambda d: (d > F.col("ts").cast("date")) & (d.cast("timestamp_ntz") < F.col("_to")))
    openings = known.select(F.explode(days).alias("_day"), "rate").select("_day", F.col("_day").cast("timestamp_ntz").alias(ts), F.col("rate").alias("_rate"))
    points = openings.unionAll(known.select(F.col("ts").cast("date"), "ts", "rate"))
    found = asof(rows.withColumn("_day", F.col(ts).cast("date")), points, ("_day",), ts, ("_rate",))
    return found.withColumns({a: F.col(a) * F.coalesce("_rate", F.lit(before)) for a in amounts}).drop("_day", "_rate")


def asof(left: DataFrame, right: DataFrame, keys: tuple[str, ...], ts: str = "ts", values: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with the values of the latest row of ``right`` at or before each row's time.

    Both sides are stacked and filled forward, so there is one shuffle and no range join.
    """
    filled = [F.struct(*values).alias("_v")]
    stacked = left.select(*keys, ts, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(*filled).schema["_v"].dataType).alias("_v"), F.lit(1).alias("_o"))
    stacked = stacked.unionAll(right.select(*keys, ts, F.lit(None).cast(stacked.schema["_l"].dataType), *filled, F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(ts, "_o").rowsBetween(Window.unboundedPreceding, 0)
    stacked = stacked.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_l is not null")
    return stacked.select("_l.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def completions(bars: DataFrame, tf: str, step: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, bucket, ts, open, high, low, close, volume, bars): each bucket with the time of the bar that completes it.

    That is its own last bar, if the bucket is whole (all bars of a fixed timeframe; of a calendar
    one, a bar after which the next would lie beyond it), and the first bar of the next bucket
    otherwise. The last bucket has no time unless it is whole.
    """
    size = tf_seconds(step)
    by = Window.partitionBy(*keys).orderBy("bucket")
    grouped = resample(bars, tf, keys).withColumnRenamed("ts", "first")
    grouped = grouped.join(bars.groupBy(*keys, bucket(tf).alias("bucket")).agg(F.max("ts").alias("last")), [*keys, "bucket"])
    if calendar_period(tf):
        beyond = F.col("last").cast("timestamp") + F.expr(f"interval {size} seconds")
        whole = (bucket(tf, "beyond") != F.col("bucket")) & (F.col("bars") > 1)
        grouped = grouped.withColumn("beyond", beyond.cast("timestamp_ntz"))
    else:
        whole = (F.col("bars") == tf_seconds(tf) // size) & (F.col("bars") > 1)
    done = F.when(whole, F.col("last")).otherwise(F.lead("first").over(by))
    return grouped.select(*keys, "bucket", done.alias("ts"), "open", "high", "low", "close", "volume", "bars")


def security(
    bars: DataFrame,
    tf: str,
    step: str,
    values: dict[str, Column],
    keys: tuple[str, ...] = ("symbol",),
    lookahead: bool = False,
    gaps: bool = False,
    projected: bool = False,
    heikin_ashi: bool = False,
) -> DataFrame:
    """``bars`` of timeframe ``step`` with expressions over bars of the higher ``tf``.

    Off: a bucket's value comes with the bar that completes it (see ``completions``) and holds until
    the next; with ``gaps`` nothing is carried forward. With ``lookahead`` each bar has the value of
    what its bucket holds so far, and the bucket before where that only now completes. ``projected``,
    a choice for the past, gives each bar the whole bucket's value. ``heikin_ashi`` evaluates over smoothed candles.
    """
    ratio = tf_ratio(step, tf)
    if ratio == -2 or ratio > 0 and tf_seconds(tf) % tf_seconds(step):
        raise ValueError(f"bars of {step} can't make bars of {tf}")
    if heikin_ashi and lookahead:
        raise ValueError("smoothed candles have no running value")
    if lookahead:
        return _running(bars, tf, step, values, keys)
    if projected:
        high = resample(bars, tf, keys)
    else:
        high = completions(bars, tf, step, keys)
    if heikin_ashi:
        high = smoothed(high, keys)
    if projected:
        high = high.select(*keys, "bucket", *[v.alias(n) for n, v in values.items()])
        return bars.withColumn("bucket", bucket(tf)).join(high, [*keys, "bucket"], "left").drop("bucket")
    done = high.where("ts is not null").select(*keys, "ts", *[v.alias(n) for n, v in values.items()])
    if gaps:
        return bars.join(done, [*keys, "ts"], "left")
    return asof(bars, done, keys, "ts", tuple(values))


def _running(bars: DataFrame, tf: str, step: str, values: dict[str, Column], keys: tuple[str, ...]) -> DataFrame:
    """The running bar of each bucket; a first bar that completes the bucket before it shows that one instead."""
    so_far = Window.partitionBy(*keys, "_bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = bars.withColumn("_bucket", bucket(tf))
    parts = {
        "open": F.first("open").over(so_far),
        "high": F.max("high").over(so_far),
        "low": F.min("low").over(so_far),
        "close": F.col("close"),
        "volume": F.sum("volume").over(so_far),
    }
    own = own.select(*[c for c in own.columns], F.struct(*[v.alias(n) for n, v in parts.items()]).alias("_run"))
    late = completions(bars, tf, step, keys).where("ts is not null").select(*keys, "ts", F.col("bucket").alias("_done"), F.struct(*parts).alias("_whole"))
    own = own.join(late, [*keys, "ts"], "left")
    shown = F.when(F.col("_done") < F.col("_bucket"), F.col("_whole")).otherwise(F.col("_run")).alias("_bar")
    own = own.select(F.struct(*bars.columns).alias("_row"), shown)
    seen = own.select("_row", "_bar.*").select("_row", *[v.alias(n) for n, v in values.items()])
    return seen.select("_row.*", *values)


def smoothed(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "bucket") -> DataFrame:
    """Heikin-Ashi candles in place of open, high, low and close."""
    spec = recurrences.heikin_ashi("_ha")
    found = recurrences.recur(bars, [spec], keys, order)
    return found.withColumns({c: F.col(f"_ha_{c}") for c in ("open", "high", "low", "close")}).drop(*spec.outputs)


def published(done: DataFrame, tf: str, script: str) -> DataFrame:
    """Of the completions of a finer ``tf`` those whose end is an end of the ``script`` timeframe too."""
    end = F.unix_seconds(F.col("bucket").cast("timestamp")) + tf_seconds(tf)
    return done.where(F.pmod(end, F.lit(tf_seconds(script))) == 0)


def check_security(source: str, script: str, tf: str, lower: bool = False, lookahead: bool = False, gaps: bool = False) -> str:
    """How bars of ``tf`` can be had by a script of timeframe ``script`` on a feed of ``source``: 'same', 'higher', 'real' or 'synthetic'.

    Raises ValueError where they can't: a timeframe that can't be read, one that is no multiple, lower
    bars that are no whole part, or lookahead or gaps over synthetic ones.
    """
    sizes = [tf_seconds(x) for x in (source, script, tf)]
    if 0 in sizes:
        raise ValueError("a timeframe can't be read")
    feed, own, asked = sizes
    if asked < 0 or asked > own > 0 or (asked == own and not lower):
        if asked > 0 and asked % feed:
            raise ValueError(f"bars of {source} can't make bars of {tf}")
        return "same" if asked == feed else "higher"
    if asked >= feed:
        if asked % feed or own % asked:
            raise ValueError(f"bars of {tf} are no whole part of {script}")
        return "real" if lower else "higher"
    if lower_ratio(source, tf) is None:
        raise ValueError(f"bars of {source} can't be cut into bars of {tf}")
    if lookahead or gaps:
        raise ValueError("synthetic lower bars know no lookahead and no gaps")
    return "synthetic"


def lower_ratio(source: str, tf: str) -> int | None:
    """How many bars of ``tf`` one of ``source`` is cut into: both of whole minutes or seconds, one a multiple of the other."""
    fixed = lambda x: x.isdigit() or x[:-1].isdigit() and x[-1] == "S"
    if not fixed(source) or not fixed(tf):
        return None
    a, b = tf_seconds(source), tf_seconds(tf)
    return a // b if 0 < b < a and a % b == 0 else None


def expected_bars(bars: DataFrame, tf: str, step: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, bars): how many bars of ``tf`` are emitted; a last bucket that isn't whole is not."""
    return completions(bars, tf, step, keys).groupBy(*keys).agg(F.count("ts").alias("bars"))


def lower_bars(children: DataFrame, tf: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, bucket, children): the real lower bars of each bar, in order."""
    bar = F.struct("ts", "open", "high", "low", "close", "volume")
    return children.groupBy(*keys, bucket(tf).alias("bucket")).agg(F.array_sort(F.collect_list(bar)).alias("children"))


def _legs() -> tuple[list[Column], list[Column]]:
    """The four corners of a bar's path and the lengths of its three legs; the high comes first if it is nearer to the open."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    up = F.abs(h - o) < F.abs(o - low)
    corners = [o, F.when(up, h).otherwise(low), F.when(up, low).otherwise(h), c]
    return corners, [F.abs(b - a) for a, b in zip(corners, corners[1:])]


def path(t: Column) -> Column:
    """Price at share ``t`` of the way open, first extreme, other extreme, close."""
    (o, a, b, c), legs = _legs()
    total = legs[0] + legs[1] + legs[2]
    at = t * total
    part = lambda x, y, run, leg: F.when(leg == 0, y).otherwise(x + (y - x) * run / leg)
    walk = F.when(at <= legs[0], part(o, a, at, legs[0])).when(at <= legs[0] + legs[1], part(a, b, at - legs[0], legs[1])).otherwise(part(b, c, at - legs[0] - legs[1], legs[2]))
    return F.when(total == 0, o).otherwise(walk)


#: Shares of the path that are one place, if they differ by less.
SAME_PLACE = 1e-12
#: Where on the path samples lie, of u from 0 to 1 in even steps.
SPREADS = {
    "uniform": lambda u: u,
    "cosine": lambda u: 0.5 * (1 - F.cos(u * math.pi)),
    "triangle": lambda u: F.when(u <= 0.5, 0.5 * F.sqrt(2 * u)).otherwise(1 - 0.5 * F.sqrt(2 * (1 - u))),
    "front": lambda u: u * u,
    "back": lambda u: 1 - (1 - u) * (1 - u),
}


def shares(n: Column, spread: str = "endpoints") -> Column:
    """Array of ``n`` shares of the path (2 at least), by one of SPREADS or 'endpoints'.

    Endpoints has the corners, then even steps between open and close; with fewer samples than corners, even steps alone.
    """
    n = F.greatest(n, F.lit(2))
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / (n - 1))
    if spread != "endpoints":
        return F.transform(even, SPREADS[spread])
    _, legs = _legs()
    total = legs[0] + legs[1] + legs[2]
    turns = F.array(F.lit(0.0), F.coalesce(F.try_divide(legs[0], total), F.lit(0.0)), F.coalesce(F.try_divide(legs[0] + legs[1], total), F.lit(0.0)), F.lit(1.0))
    corners = F.aggregate(turns, F.array().cast("array<double>"), lambda kept, x: F.when((F.size(kept) > 0) & (F.abs(x - F.element_at(kept, -1)) < SAME_PLACE), kept).otherwise(F.concat(kept, F.array(x))))
    left = n - F.size(corners)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(left, F.lit(1))), lambda i: i / (left + 1))
    fresh = F.concat(corners, F.filter(steps, lambda t: ~F.exists(corners, lambda c: F.abs(c - t) < SAME_PLACE)))
    more = F.filter(F.transform(F.sequence(F.size(fresh), F.greatest(n - 1, F.size(fresh))), lambda k: F.when(k < n, k / (n + 1))), lambda t: t.isNotNull())
    mixed = F.slice(F.array_sort(F.concat(fresh, more)), 1, n)
    return F.when((total == 0) | (n < F.size(corners)), even).when(n == F.size(corners), corners).otherwise(mixed)


def sampled(bars: DataFrame, n: int | Column, spread: str = "uniform") -> DataFrame:
    """``n`` prices along each bar's path, exploded: (…, step, price); the first is the open, the last the close."""
    number = F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(2))
    rows = bars.select("*", number.alias("_n"), shares(number, spread).alias("_shares")).select("*", F.posexplode("_shares").alias("step", "_t"))
    price = F.when(F.col("step") == 0, F.col("open")).when(F.col("step") == F.col("_n") - 1, F.col("close")).otherwise(path(F.col("_t")))
    return rows.withColumn("price", price).drop("_t", "_n", "_shares")


def sample_count(base: int, least: int, most: int, mean: Column) -> Column:
    """Samples of a bar by its volume: ``base`` times its share of the mean (a quarter to four times), within bounds."""
    share = F.least(F.greatest(F.col("volume") / mean, F.lit(0.25)), F.lit(4.0))
    scaled = F.when((mean > 0) & (F.col("volume") > 0), F.round(base * share).cast("int")).otherwise(base)
    return F.least(F.greatest(scaled, F.lit(least)), F.lit(most))


def sampled_by_volume(bars: DataFrame, base: int, least: int, most: int, spread: str = "endpoints", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """As ``sampled``, with more samples for bars of more volume than their series' mean."""
    counted = bars.withColumn("_mean", F.avg("volume").over(Window.partitionBy(*keys)))
    counted = counted.withColumn("_count", sample_count(base, least, most, F.col("_mean"))).drop("_mean")
    return sampled(counted, F.col("_count"), spread).drop("_count")


def synthesised(bars: DataFrame, ratio: int, seconds: int) -> DataFrame:
    """``ratio`` lower bars along each bar's path, whose corners they meet if they are enough; volume is dealt evenly."""
    prices = bars.withColumn("_p", F.transform(shares(F.lit(ratio + 1)), path))
    parts = prices.select("*", F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("part"))
    a = F.when(F.col("part") == 0, F.col("open")).otherwise(F.element_at("_p", F.col("part") + 1))
    b = F.when(F.col("part") == ratio - 1, F.col("close")).otherwise(F.element_at("_p", F.col("part") + 2))
    share = F.col("volume") / ratio
    moved = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("part") * (seconds // ratio)).cast("timestamp_ntz")
    volume = F.when(F.col("part") == ratio - 1, F.col("volume") - share * (ratio - 1)).otherwise(share)
    keys = [c for c in bars.columns if c not in ("ts", "open", "high", "low", "close", "volume")]
    return parts.select(*keys, "part", moved.alias("ts"), a.alias("open"), F.greatest(a, b).alias("high"), F.least(a, b).alias("low"), b.alias("close"), volume.alias("volume"))


def filled(bars: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``bars`` with a bar of no volume, at the close before, wherever one is missing between two."""
    w = Window.partitionBy(*keys).orderBy("ts")
    step = F.unix_seconds(F.col("ts").cast("timestamp"))
    known = bars.withColumn("_next", F.lead(step).over(w)).withColumn("_ts", step)
    times = F.sequence(F.col("_ts"), F.greatest(F.coalesce("_next", F.col("_ts") + seconds) - seconds, F.col("_ts")), F.lit(seconds))
    rows = known.select(*keys, "ts", "open", "high", "low", "close", "volume", F.posexplode(times).alias("_k", "_t"))
    quiet = F.col("_k") > 0
    price = lambda c: F.when(quiet, F.col("close")).otherwise(F.col(c)).alias(c)
    return rows.select(*keys, F.timestamp_seconds("_t").cast("timestamp_ntz").alias("ts"), price("open"), price("high"), price("low"), F.col("close"), F.when(quiet, 0.0).otherwise(F.col("volume")).alias("volume"))
