"""Bars, ticks and currency curves: where they come from and what they must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
PRICES = ("open", "high", "low", "close", "volume")


def clean(bars: DataFrame) -> DataFrame:
    """NaN becomes NULL, the one missing value that every operator knows."""
    return bars.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in PRICES})


def read_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of one symbol from CSV with the header timestamp,open,high,low,close,volume; timestamp is Unix ms."""
    rows = spark.read.schema("timestamp long, open double, high double, low double, close double, volume double").csv(path, header=True)
    ts = F.timestamp_millis("timestamp").cast("timestamp_ntz")
    return clean(rows.select(F.lit(symbol).alias("symbol"), ts.alias("ts"), *PRICES))


def from_ticks(ticks: DataFrame, minutes: int, symbol: str = "symbol", ts: str = "ts", price: str = "price", quantity: F.Column | None = None) -> DataFrame:
    """Bars of ``minutes`` from ticks, in one partial aggregation; volume sums ``quantity`` (one a tick by default)."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    bucket = F.timestamp_seconds(seconds - seconds % (60 * minutes)).cast("timestamp_ntz")
    return ticks.groupBy(F.col(symbol).alias("symbol"), bucket.alias("ts")).agg(
        F.min_by(price, ts).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, ts).alias("close"),
        (F.count("*") if quantity is None else F.sum(quantity)).cast("double").alias("volume"),
    )


def event_bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """The driver's events as ticks: the event type is the symbol, the value the price."""
    return from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value"), minutes, "event_type", "ts", "value")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices, in order of their keys."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    return orders.groupBy(F.lit("orders").alias("symbol"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def valid_ticks(ticks: DataFrame, price: str = "price", quantity: str = "quantity") -> DataFrame:
    """Ticks with a positive finite price and a finite quantity that isn't negative."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return ticks.where((F.col(price) > 0) & finite(price) & (F.col(quantity) >= 0) & finite(quantity))


def fx_daily(closes: DataFrame, day: str = "day", rate: str = "rate") -> DataFrame:
    """(ts, rate): the close of a day holds from the next midnight; a day that repeats, or a rate that isn't positive, raises an error."""
    ts = F.date_add(F.col(day).cast("date"), 1).cast("timestamp_ntz")
    return fx_points(closes.select(ts.alias("ts"), F.col(rate).cast("double").alias("rate")))


def fx_points(points: DataFrame, ts: str = "ts", rate: str = "rate") -> DataFrame:
    """(ts, rate) in the order of time; a time that repeats, or a rate that isn't positive and finite, raises an error."""
    found = points.groupBy(F.col(ts).alias("ts")).agg(F.first(rate).alias("rate"), F.count("*").alias("_n"))
    bad = (F.col("_n") > 1) | F.col("ts").isNull() | F.col("rate").isNull() | F.isnan("rate") | (F.col("rate") <= 0) | (F.col("rate") == float("inf"))
    return found.select("ts", F.when(bad, F.raise_error(F.lit("times must not repeat and rates must be positive"))).otherwise(F.col("rate")).cast("double").alias("rate"))


def read_fx(spark: SparkSession, path: str) -> DataFrame:
    """(ts, rate) from JSON: one object of days and closes, or an object with lists timestamps_ms and rates, or points of t and rate."""
    whole = spark.read.text(path, wholetext=True).select("value")
    listed = F.from_json("value", "timestamps_ms array<long>, rates array<double>, points array<struct<t: long, rate: double>>")
    rows = whole.select(listed.alias("j"), F.from_json("value", "map<string, double>").alias("m"))
    lists = rows.select(F.explode(F.arrays_zip("j.timestamps_ms", "j.rates")).alias("p")).select(F.timestamp_millis("p.timestamps_ms").cast("timestamp_ntz").alias("ts"), F.col("p.rates").alias("rate"))
    points = rows.select(F.explode("j.points").alias("p")).select(F.timestamp_millis("p.t").cast("timestamp_ntz").alias("ts"), F.col("p.rate").alias("rate"))
    days = rows.where("j.timestamps_ms is null and j.points is null").select(F.explode("m").alias("day", "rate")).select(F.date_add(F.col("day").cast("date"), 1).cast("timestamp_ntz").alias("ts"), "rate")
    return fx_points(lists.unionAll(points).unionAll(days))


def account_rates(curve: DataFrame, most: int = 100_000) -> tuple[tuple[object, float], ...]:
    """A curve as what an account holds; more than ``most`` points raise an error."""
    rows = curve.orderBy("ts").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a curve has at most {most} points")
    return tuple((r["ts"], r["rate"]) for r in rows)
