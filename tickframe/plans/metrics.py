"""Statistics of trades and equity curves, by aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions import sessions


def trade_stats(trades: DataFrame, capital: float, keys: tuple[str, ...] = ("symbol",), order: str = "trade") -> DataFrame:
    """One row for each series and side ('all', 'long', 'short'): counts, sums, averages, extremes and streaks.

    ``trades`` has keys, is_long, pnl, pnl_pct, commission, entry_bar, exit_bar and an order. Averages
    over nothing are NULL. Even trades break streaks.
    """
    sides = F.explode(F.array(F.lit("all"), F.when(F.col("is_long"), "long").otherwise("short")))
    rows = trades.withColumn("side", sides).withColumn("sign", F.signum("pnl").cast("int")).withColumn("bars", F.col("exit_bar") - F.col("entry_bar") + 1)
    by = Window.partitionBy(*keys, "side").orderBy(order)
    island = F.row_number().over(by) - F.row_number().over(Window.partitionBy(*keys, "side", "sign").orderBy(order))
    rows = rows.withColumn("island", island)
    run = F.row_number().over(Window.partitionBy(*keys, "side", "sign", "island").orderBy(order))
    rows = rows.withColumn("run", run)
    won, lost = F.col("sign") > 0, F.col("sign") < 0
    when = lambda c, x: F.when(c, F.col(x))
    out = rows.groupBy(*keys, "side").agg(
        F.count("*").alias("num_trades"),
        F.count_if(won).alias("num_wins"),
        F.count_if(lost).alias("num_losses"),
        F.count_if(F.col("sign") == 0).alias("num_even"),
        F.sum("pnl").alias("net_profit"),
        F.coalesce(F.sum(when(won, "pnl")), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(-F.sum(when(lost, "pnl")), F.lit(0.0)).alias("gross_loss"),
        F.sum("commission").alias("commission_paid"),
        F.avg("pnl_pct").alias("avg_trade_pct"),
        F.avg(when(won, "pnl")).alias("avg_win"),
        F.avg(when(won, "pnl_pct")).alias("avg_win_pct"),
        (-F.avg(when(lost, "pnl"))).alias("avg_loss"),
        (-F.avg(when(lost, "pnl_pct"))).alias("avg_loss_pct"),
        F.max(when(won, "pnl")).alias("largest_win"),
        F.greatest(F.max(when(won, "pnl_pct")), F.when(F.count_if(won) > 0, 0.0)).alias("largest_win_pct"),
        (-F.min(when(lost, "pnl"))).alias("largest_loss"),
        F.greatest(-F.min(when(lost, "pnl_pct")), F.when(F.count_if(lost) > 0, 0.0)).alias("largest_loss_pct"),
        F.avg("bars").alias("avg_bars_in_trade"),
        F.avg(when(won, "bars")).alias("avg_bars_in_wins"),
        F.avg(when(lost, "bars")).alias("avg_bars_in_losses"),
        F.coalesce(F.max(when(won, "run")), F.lit(0)).alias("max_consecutive_wins"),
        F.coalesce(F.max(when(lost, "run")), F.lit(0)).alias("max_consecutive_losses"),
    )
    share = lambda a, b: F.when(b != 0, a / b)
    c = F.col
    return out.withColumns(
        {
            **{f"{x}_pct": c(x) / capital * 100 if capital > 0 else F.lit(None).cast("double") for x in ("net_profit", "gross_profit", "gross_loss")},
            "percent_profitable": c("num_wins") / c("num_trades") * 100,
            "profit_factor": share(c("gross_profit"), c("gross_loss")),
            "avg_trade": c("net_profit") / c("num_trades"),
            "ratio_avg_win_avg_loss": share(c("avg_win"), c("avg_loss")),
            "expectancy": c("num_wins") / c("num_trades") * F.coalesce("avg_win", F.lit(0.0)) - c("num_losses") / c("num_trades") * F.coalesce("avg_loss", F.lit(0.0)),
        }
    )


YEAR_MS = 365.25 * 86_400 * 1000


def _millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def equity_stats(
    curve: DataFrame,
    capital: float,
    keys: tuple[str, ...] = ("symbol",),
    ts: str = "ts",
    equity: str = "equity",
    open_profit: str | None = None,
    position: str | None = None,
    bars: DataFrame | None = None,
    zone: str = "UTC",
) -> DataFrame:
    """One row for each series: drawdown, run-up, growth, ratios.

    Peaks begin with the curve's first point; a run-up is counted from the lowest point since the last
    peak. Percents are those of the point where the extreme was first reached. ``open_profit`` and
    ``position`` name columns of the curve; without them, profit is what the curve gained and
    the time in the market unknown. ``bars`` gives what holding from first open to last close would have made.
    """
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("_peak", F.max(equity).over(w))
    since = Window.partitionBy(*keys, "_peak").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_trough", F.min(equity).over(since))
    e, peak, trough = F.col(equity), F.col("_peak"), F.col("_trough")
    first = lambda x: F.struct(x, -_millis(ts))  # noqa: E731  # of equal extremes the first
    profit = e - (F.col(open_profit) if open_profit else 0.0) - capital
    found = rows.groupBy(*keys).agg(
        F.max(peak - e).alias("max_drawdown"),
        F.max_by(F.when(peak > 0, (peak - e) / peak * 100), first(peak - e)).alias("max_drawdown_pct"),
        F.max(e - trough).alias("max_run_up"),
        F.max_by(F.when(trough > 0, (e - trough) / trough * 100), first(e - trough)).alias("max_run_up_pct"),
        F.max_by(equity, ts).alias("final_equity"),
        F.count("*").alias("points"),
        (F.max_by(open_profit, ts) if open_profit else F.lit(0.0)).alias("open_profit"),
        F.max_by(profit, ts).alias("net_profit"),
        (F.count_if(F.col(position) != 0) / F.count("*") * 100 if position else F.lit(None).cast("double")).alias("time_in_market_pct"),
        ((F.max(_millis(ts)) - F.min(_millis(ts))) / YEAR_MS).alias("_years"),
    )
    c = F.col
    growth = F.when((c("_years") > 0) & (F.lit(capital) > 0) & (c("final_equity") > 0), (F.pow(c("final_equity") / capital, 1 / F.nullif("_years", F.lit(0.0))) - 1) * 100)
    found = found.withColumn("cagr", growth).withColumns(
        {
            "recovery_factor": F.when(c("max_drawdown") > 0, c("net_profit") / F.nullif("max_drawdown", F.lit(0.0))),
            "calmar": F.when(c("max_drawdown_pct") > 0, c("cagr") / F.nullif("max_drawdown_pct", F.lit(0.0))),
        }
    )
    found = found.drop("_years").join(sharpe(curve, keys, ts, equity, zone=zone), list(keys), "left").join(sharpe_by_bar(curve, keys, ts, equity), list(keys), "left")
    if bars is not None:
        held = bars.groupBy(*keys).agg((F.max_by("close", "ts") / F.nullif(F.min_by("open", "ts"), F.lit(0.0)) - 1).alias("_held"))
        found = found.join(held, list(keys), "left").withColumns({"buy_hold_return": c("_held") * capital, "buy_hold_return_pct": c("_held") * 100}).drop("_held")
    return found


def _ratios(returns: DataFrame, keys: tuple[str, ...], free: Column, root: Column, suffix: str = "") -> DataFrame:
    """(keys, sharpe, sortino) of returns r, by the sample deviation and the deviation below the risk-free return."""
    rows = returns.where("r is not null").withColumns({"_x": F.col("r") - free, "_root": root})
    mean, spread = F.avg("_x"), F.stddev_samp("r")
    below = F.sqrt(F.avg(F.pow(F.least("_x", F.lit(0.0)), 2)))
    ratio = lambda wide: F.when((F.count("*") > 1) & (wide > 0), mean / wide * F.first("_root"))
    return rows.groupBy(*keys).agg(ratio(spread).alias(f"sharpe{suffix}"), ratio(below).alias(f"sortino{suffix}"))


def _return(equity: str, by: Window) -> Column:
    before = F.lag(equity).over(by)
    return F.when(before > 0, F.col(equity) / F.nullif(before, F.lit(0.0)) - 1)


def sharpe(curve: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", equity: str = "equity", period: str = "MONTH", free: float = 0.02, a_year: float = 12, zone: str = "UTC") -> DataFrame:
    """(keys, sharpe, sortino) of the returns between the last points of each period, by the zone's calendar."""
    last = curve.groupBy(*keys, F.date_trunc(period, sessions.local(F.col(ts), zone)).alias("period")).agg(F.max_by(equity, ts).alias("equity"))
    returns = last.withColumn("r", _return("equity", Window.partitionBy(*keys).orderBy("period")))
    return _ratios(returns, keys, F.lit(free / a_year), F.lit(a_year**0.5))


def sharpe_by_bar(curve: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", equity: str = "equity", free: float = 0.02) -> DataFrame:
    """(keys, sharpe_bar, sortino_bar) of the returns from point to point, by the points a year that there are; three points at least."""
    spans = curve.groupBy(*keys).agg(((F.max(_millis(ts)) - F.min(_millis(ts))) / YEAR_MS).alias("_years"), F.count("*").alias("_n"))
    returns = curve.withColumn("r", _return(equity, Window.partitionBy(*keys).orderBy(ts))).join(spans.where("_n >= 3 and _years > 0"), list(keys))
    a_year = (F.col("_n") - 1) / F.col("_years")
    return _ratios(returns, keys, free / a_year, F.sqrt(a_year), "_bar")


def trade_percentiles(trades: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, p50, p90, p99) of a column, between the nearest values."""
    return trades.groupBy(*keys).agg(*[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in shares])


# --- comparing two runs ---------------------------------------------------------------------


def consolidated(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trades with the parts of one entry put together: sums, the last exit time, the exit price by quantity."""
    return trades.groupBy(*keys, "entry_ts", "entry_price", "is_long").agg(
        F.min("trade").alias("trade"),
        F.max("exit_ts").alias("exit_ts"),
        (F.sum(F.col("exit_price") * F.col("qty")) / F.sum("qty")).alias("exit_price"),
        *[F.sum(x).alias(x) for x in ("qty", "pnl", "commission", "max_run_up", "max_drawdown")],
        F.count("*").alias("parts"),
    )


def aligned(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("symbol",), seconds: int = 3600, price: float = 3.0) -> DataFrame:
    """(keys, trade, other): trades of two runs that are each other's nearest, of one direction, within time and price.

    Times are dealt into windows, so that the range join is an equality join on window and direction
    with a filter; each trade of the left looks into the windows beside its own.
    """
    span = F.floor(F.unix_seconds(F.col("entry_ts").cast("timestamp")) / seconds)
    a = left.select(*keys, "is_long", F.col("trade"), F.col("entry_ts").alias("_ta"), F.col("entry_price").alias("_pa"), F.explode(F.array(span - 1, span, span + 1)).alias("_w"))
    b = right.select(*keys, "is_long", F.col("trade").alias("other"), F.col("entry_ts").alias("_tb"), F.col("entry_price").alias("_pb"), span.alias("_w"))
    apart = F.abs(F.unix_seconds(F.col("_ta").cast("timestamp")) - F.unix_seconds(F.col("_tb").cast("timestamp")))
    pairs = a.join(b, [*keys, "is_long", "_w"]).where((apart <= seconds) & (F.abs(F.col("_pa") - F.col("_pb")) <= price)).withColumn("_d", apart)
    mine = F.row_number().over(Window.partitionBy(*keys, "trade").orderBy("_d", "other"))
    theirs = F.row_number().over(Window.partitionBy(*keys, "other").orderBy("_d", "trade"))
    return pairs.withColumns({"_m": mine, "_t": theirs}).where("_m = 1 and _t = 1").select(*keys, "trade", "other")


def compared(left: DataFrame, right: DataFrame, column: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """One row: how an indicator of two runs differs, row by row of equal keys."""
    rows = left.select(*keys, F.col(column).alias("_a")).join(right.select(*keys, F.col(column).alias("_b")), list(keys))
    a, b = F.col("_a"), F.col("_b")
    apart = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.agg(
        F.count("*").alias("bars"),
        F.count_if(a.isNotNull() & b.isNotNull()).alias("both"),
        F.count_if(a.isNotNull() & b.isNull()).alias("left_only"),
        F.count_if(a.isNull() & b.isNotNull()).alias("right_only"),
        F.count_if(a.isNull() & b.isNull()).alias("neither"),
        zero(F.max(F.abs(a - b))).alias("max_abs"),
        *[zero(F.percentile(apart, p)).alias(f"p{round(100 * p)}_rel") for p in (0.5, 0.9, 0.99)],
        zero(F.max(apart)).alias("max_rel"),
    )
