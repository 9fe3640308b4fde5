"""What a run leaves: trade lists, reports, traces and the digests that tell one run from another."""

from __future__ import annotations

import base64
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.plans import metrics


def trades_report(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Two rows a trade, exit then entry, with excursions (the adverse one negative) and cumulative profit."""
    total: Column = F.sum("pnl").over(Window.partitionBy(*keys).orderBy("trade").rowsBetween(Window.unboundedPreceding, 0))
    side = F.when(F.col("is_long"), "long").otherwise("short")
    legs = F.array(
        F.struct(F.lit(0).alias("leg"), F.concat(F.lit("Exit "), side).alias("type"), F.col("exit_ts").alias("ts"), F.col("exit_price").alias("price")),
        F.struct(F.lit(1).alias("leg"), F.concat(F.lit("Entry "), side).alias("type"), F.col("entry_ts").alias("ts"), F.col("entry_price").alias("price")),
    )
    rows = trades.withColumns({"cumulative_pnl": total, "favorable": F.col("max_run_up"), "adverse": -F.col("max_drawdown") + 0.0}).select("*", F.explode(legs).alias("_l"))
    return rows.select(*keys, "trade", "_l.*", "qty", "pnl", "pnl_pct", "favorable", "adverse", "cumulative_pnl")


def trade_csv(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The trade list as text columns, to be written as CSV; ``rank`` puts the newest trade first in each series."""
    rows = trades_report(trades, keys)
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trade"), "leg"))
    return rows.select(
        *keys,
        newest.alias("rank"),
        F.col("trade").cast("string").alias("Trade #"),
        F.col("type").alias("Type"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("Date and time"),
        fixed("price", 6).alias("Price"),
        F.regexp_replace(F.regexp_replace(fixed("qty", 6), "0+$", ""), "\\.$", "").alias("Qty"),
        fixed("pnl", 6).alias("Net PnL"),
        fixed("pnl_pct", 4).alias("Net PnL %"),
        fixed("favorable", 6).alias("Favorable excursion USD"),
        fixed("adverse", 6).alias("Adverse excursion USD"),
        fixed("cumulative_pnl", 6).alias("Cumulative PnL"),
    )


def write_trade_csv(trades: DataFrame, path: str, keys: tuple[str, ...] = ("symbol",)) -> None:
    """One folder a series, each with a header and its trades, the newest first."""
    rows = trade_csv(trades, keys)
    rows.repartition(*keys).sortWithinPartitions(*keys, "rank").drop("rank").write.partitionBy(*keys).option("header", True).csv(path)


def summary(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, total_trades, wins, losses, win_rate_pct, net_pnl, avg_trade, best_trade, worst_trade, max_drawdown) of closed trades.

    The drawdown is that of the profits closed so far, zero or negative.
    """
    by = Window.partitionBy(*keys).orderBy("trade").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("_sum", F.sum("pnl").over(by))
    rows = rows.withColumn("_fall", F.col("_sum") - F.greatest(F.max("_sum").over(by), F.lit(0.0)))
    n, wins = F.count("*"), F.count_if(F.col("pnl") > 0)
    return rows.groupBy(*keys).agg(
        n.alias("total_trades"),
        wins.alias("wins"),
        F.count_if(F.col("pnl") < 0).alias("losses"),
        F.round(wins / n * 100, 4).alias("win_rate_pct"),
        F.sum("pnl").alias("net_pnl"),
        F.avg("pnl").alias("avg_trade"),
        F.max("pnl").alias("best_trade"),
        F.min("pnl").alias("worst_trade"),
        F.min("_fall").alias("max_drawdown"),
    )


def _plain(df: DataFrame, keys: tuple[str, ...]) -> Column:
    """All columns but the keys as a struct, NaN as NULL."""
    return F.struct(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


def report(trades: DataFrame, curve: DataFrame | None, capital: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, summary, trades, metrics[, equity, equity_curve]): one nested row for each series with trades.

    A series' trades and points are one row, as a report of it is one document.
    """
    listed = lambda df, order, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), _plain(df, keys).alias("x")))).alias("_l")).select(*keys, F.transform("_l", lambda p: p["x"]).alias(name))
    one = lambda df, name: df.select(*keys, _plain(df, keys).alias(name))
    stats = metrics.trade_stats(trades, capital, keys)
    sides = stats.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("side", _plain(stats, (*keys, "side")))))).alias("metrics"))
    found = one(summary(trades, keys), "summary").join(listed(trades, "trade", "trades"), list(keys)).join(sides, list(keys))
    if curve is not None:
        found = found.join(one(metrics.equity_stats(curve, capital, keys, open_profit="open_profit", position="position"), "equity"), list(keys), "left")
        points = curve.select(*keys, F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"), "equity", "open_profit")
        found = found.join(listed(points, "time_ms", "equity_curve"), list(keys), "left")
    return found


def report_json(trades: DataFrame, curve: DataFrame | None, capital: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, report): the report of each series as JSON; what is missing is null."""
    found = report(trades, curve, capital, keys)
    return found.select(*keys, F.to_json(F.struct(*[c for c in found.columns if c not in keys]), {"ignoreNullFields": "false"}).alias("report"))


# --- traces, diagnostics, digests -----------------------------------------------------------


def trace(df: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """(keys, ts, bar_index, name, value): named values of each bar in long form."""
    index = F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()])
    rows = df.select(*keys, ts, index.alias("bar_index"), pairs.alias("_p"))
    return rows.select(*keys, ts, "bar_index", F.explode("_p").alias("_x")).select(*keys, ts, "bar_index", "_x.*")


def security_diagnostics(bars: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, feeds, complete, partial): bars fed to a higher timeframe, those that completed a bucket, and the rest."""
    fed = bars.groupBy(*keys).agg(F.count("*").alias("feeds"))
    complete = done.groupBy(*keys).agg(F.count("ts").alias("complete"))
    return fed.join(complete, list(keys), "left").select(*keys, "feeds", F.coalesce("complete", F.lit(0)).alias("complete"), (F.col("feeds") - F.coalesce("complete", F.lit(0))).alias("partial"))


def feed_digest(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, bars, digest): SHA-256 over the digests of each series' bars, which no order changes."""
    line = F.concat_ws(",", F.unix_millis(F.col("ts").cast("timestamp")), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    rows = bars.select(*keys, F.sha2(line, 256).alias("_d"))
    # Sums of parts of digests are combined before anything is moved, whatever the length of the series.
    part = lambda k: F.conv(F.substring("_d", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("bars"), *[F.sum(part(k)).alias(f"_{k}") for k in range(5)])
    return sums.select(*keys, "bars", F.sha2(F.concat_ws("|", "bars", *[f"_{k}" for k in range(5)]), 256).alias("digest"))


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; numbers that JSON doesn't have raise an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(provenance: dict) -> dict:
    """Token (base64 of the canonical JSON), SHA-256 digest of the same bytes, and what went into them."""
    for v in provenance.values():
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("a fingerprint holds finite numbers only")
    raw = canonical(provenance).encode()
    return {"token": base64.b64encode(raw).decode(), "digest": "sha256:" + hashlib.sha256(raw).hexdigest(), "provenance": provenance}
