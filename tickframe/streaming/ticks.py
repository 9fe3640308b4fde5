"""Live ticks: tumbling bars with a watermark, and a stateful bar builder that fills quiet gaps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.sessions import holds


def bars(ticks: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """Tumbling bars of a tick stream (symbol, ts timestamp, price, quantity); emitted once the watermark passes."""
    window = F.window("ts", f"{seconds} seconds")
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", window)
    found = grouped.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("quantity").alias("volume"))
    return found.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


OUTPUT = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, rejected int"
STATE = "start long, open double, high double, low double, close double, volume double, clock long, sequence long, rejected int, seen boolean"
NAMES = ["symbol", "ts", "open", "high", "low", "close", "volume", "rejected"]


@dataclass
class Builder:
    """The forming bar of one series. Bars are closed by later ticks, by the clock, or at the end.

    Ticks must not go back in time, and numbered ones (``sequence`` other than 0) must rise; others are
    rejected and counted in the next bar. A quiet interval within the session gives a bar of no volume
    at the last close; intervals outside of it give none.
    """

    start: int | None = None
    open: float = 0.0
    high: float = 0.0
    low: float = 0.0
    close: float = 0.0
    volume: float = 0.0
    clock: int = 0
    sequence: int = 0
    rejected: int = 0
    seen: bool = False

    def push(self, t: int, price: float, quantity: float, seconds: int, session: str = "", zone: str = "UTC", sequence: int = 0) -> Iterator[tuple]:
        """Take a tick at second ``t``; the bars that it closes."""
        fine = math.isfinite(price) and price > 0 and math.isfinite(quantity) and quantity >= 0
        if not fine or t < self.clock or 0 < sequence <= self.sequence:
            self.rejected += 1
            return
        yield from self.advance(t, seconds, session, zone)
        self.sequence = max(self.sequence, sequence)
        own = t - t % seconds
        if self.start != own or not self.seen:
            self.start, self.open, self.high, self.low, self.volume, self.seen = own, price, price, price, 0.0, True
        self.high, self.low, self.close, self.volume = max(self.high, price), min(self.low, price), price, self.volume + quantity

    def advance(self, t: int, seconds: int, session: str = "", zone: str = "UTC") -> Iterator[tuple]:
        """Move the clock to ``t``; the bars that end by then. What begins then waits for its first tick."""
        self.clock = max(self.clock, t)
        while self.start is not None and self.start + seconds <= t:
            yield self._row()
            self.start += seconds
            self.open = self.high = self.low = self.close
            self.volume, self.rejected, self.seen = 0.0, 0, False
            if self.start + seconds <= t and not holds(session, self.start, zone):
                self.start = self._next_open(t, seconds, session, zone)

    def _next_open(self, t: int, seconds: int, session: str, zone: str) -> int:
        """The next interval in the session, that of ``t`` at the latest."""
        last, at = t - t % seconds, self.start
        while at < last and not holds(session, at, zone):
            at += seconds
        return at

    def end(self, partial: bool) -> Iterator[tuple]:
        """The bar that is still forming, if it is wanted."""
        if partial and self.start is not None:
            yield self._row()

    def _row(self) -> tuple:
        return pd.Timestamp(self.start, unit="s"), self.open, self.high, self.low, self.close, self.volume, self.rejected


def _seconds(rows: pd.DataFrame) -> list[int]:
    return (rows["ts"].astype("datetime64[us]").astype("int64") // 1_000_000).tolist()


def _taken(builder: Builder, rows: pd.DataFrame, seconds: int, session: str, zone: str) -> list[tuple]:
    rows = rows.sort_values("ts", kind="stable")
    numbers = rows["sequence"].tolist() if "sequence" in rows else [0] * len(rows)
    found: list[tuple] = []
    for t, price, quantity, number in zip(_seconds(rows), rows["price"].tolist(), rows["quantity"].tolist(), numbers):
        found += builder.push(t, price, quantity, seconds, session, zone, int(number or 0))
    return found


def _frame(symbol: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(symbol, *r) for r in rows], columns=NAMES)


def continuous(ticks: DataFrame, seconds: int, session: str = "", zone: str = "UTC", late: str | None = None, warm: DataFrame | None = None) -> DataFrame:
    """Bars in order without gaps within the session, of a stream (symbol, ts, price, quantity[, sequence]).

    The forming bar lives in the state. A later tick ends it; with ``late`` (a delay) the watermark
    does too, so that the bar of a series that falls quiet closes. ``warm`` are bars of the past,
    whose last close is where each series begins; they are read when the query is made, a row for each series.
    """
    kept = {}
    if warm is not None:
        last = warm.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
        kept = {r["symbol"]: (int(pd.Timestamp(r["ts"]).timestamp()), r["close"]) for r in last.collect()}

    def begun(symbol: str) -> Builder:
        if symbol not in kept:
            return Builder()
        at, close = kept[symbol]
        return Builder(at + seconds, close, close, close, close, 0.0, at + seconds)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        builder = Builder(*state.get) if state.exists else begun(key[0])
        if state.hasTimedOut:
            rows = list(builder.advance(state.getCurrentWatermarkMs() // 1000, seconds, session, zone))
        else:
            rows = [r for part in parts for r in _taken(builder, part, seconds, session, zone)]
        if builder.start is not None:
            state.update(astuple(builder))
            if late is not None:
                state.setTimeoutTimestamp(max((builder.start + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield _frame(key[0], rows)

    if late is not None:
        ticks = ticks.withWatermark("ts", late)
    return ticks.groupBy("symbol").applyInPandasWithState(run, OUTPUT, STATE, "append", "EventTimeTimeout" if late is not None else "NoTimeout")


assert [f.name for f in fields(Builder)] == [c.split()[0] for c in STATE.split(", ")]


def finished(ticks: DataFrame, seconds: int, session: str = "", zone: str = "UTC", partial: bool = False) -> DataFrame:
    """The same bars of ticks that are all there, with the last, ``partial`` one if it is wanted."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        builder = Builder()
        found = _taken(builder, rows, seconds, session, zone)
        return _frame(rows["symbol"].iloc[0], [*found, *builder.end(partial)])

    return ticks.groupBy("symbol").applyInPandas(run, OUTPUT)


def live(bars_stream: DataFrame, strategy: Callable, account, write: Callable[[DataFrame, int], None], keys: tuple[str, ...] = ("symbol",), folder: str = "") -> object:  # noqa: ANN001
    """A query that appends each batch of bars to the table ``folder`` and hands the trades of all bars so far to ``write``.

    The snapshot of warm-up and live bars together; the stream goes on.
    """
    from tickframe import broker

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{folder}/batch={number}")  # a batch that is run again replaces itself
        seen = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        write(broker.backtest(seen.drop("batch"), strategy, account, keys=keys), number)

    return bars_stream.writeStream.foreachBatch(batch).start()
