"""Backtests as grouped maps: one task a series, or a series and a block of parameter sets."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.broker.kernel import Account, Broker

TRADES = "trade int, entry_id string, is_long boolean, entry_ts timestamp_ntz, entry_bar int, entry_price double, exit_ts timestamp_ntz, exit_bar int, exit_price double, qty double, pnl double, pnl_pct double, commission double, max_run_up double, max_drawdown double, exit_id string, entry_comment string, exit_comment string"
EQUITY = "ts timestamp_ntz, bar int, equity double, open_profit double, position double"
OPEN = "trade int, entry_id string, is_long boolean, entry_ts timestamp_ntz, entry_bar int, entry_price double, qty double, profit double, profit_pct double, commission double, max_run_up double, max_drawdown double, max_run_up_pct double, max_drawdown_pct double, comment string"
STATE = "ts timestamp_ntz, bar int, " + ", ".join(
    f"{name} {kind}"
    for kind, names in (
        ("double", "equity initial_capital net_profit net_profit_pct open_profit open_profit_pct gross_profit gross_profit_pct gross_loss gross_loss_pct"),
        ("int", "closed_trades open_trades win_trades loss_trades even_trades"),
        ("double", "avg_trade avg_trade_pct avg_winning_trade avg_winning_trade_pct avg_losing_trade avg_losing_trade_pct position_size position_avg_price"),
        ("string", "position_entry_name"),
        ("double", "capital_held max_drawdown max_run_up max_contracts_held_all max_contracts_held_long max_contracts_held_short margin_liquidation_price"),
    )
    for name in names.split()
)
WHAT = {"trades": TRADES, "equity": EQUITY, "open": OPEN, "state": STATE}

#: A strategy gets the broker, a bar as a dict of its columns, and its memory, in which ``params`` are its parameters.
Strategy = Callable[[Broker, dict, dict], None]


def walk(children: list) -> tuple[list[float], frozenset[int]]:
    """The path through lower bars one after another, and the legs on which the price leaps from one to the next."""
    path: list[float] = []
    jumps = set()
    for child in children:
        o, h, low, c = (child[x] for x in ("open", "high", "low", "close"))
        if path:
            jumps.add(len(path) - 1)
        path += [o, h, low, c] if abs(h - o) < abs(o - low) else [o, low, h, c]
    return path, frozenset(jumps)


def _bars(rows: pd.DataFrame) -> list[dict]:
    rows = rows.sort_values("ts", kind="stable")
    names = list(rows.columns)
    return [dict(zip(names, values)) for values in zip(*rows.to_dict("list").values())]


def _simulate(bars: list[dict], strategy: Strategy, account: Account, params: dict, start: object, points: Callable[[Broker, dict], tuple] | None = None) -> tuple[Broker, list[tuple]]:
    """Bars with ``children`` (lower bars) or ``path`` (prices) are walked along these; else along their corners."""
    broker, found = Broker(account), []
    memory: dict = {"params": params}
    for number, bar in enumerate(bars):
        # What is ordered now fills on the next bar.
        active = start is None or bars[min(number + 1, len(bars) - 1)]["ts"] >= start
        path, jumps = None, frozenset()
        if bar.get("children") is not None and len(bar["children"]):
            path, jumps = walk(bar["children"])
        elif bar.get("path") is not None and len(bar["path"]) > 1:
            path = [float(x) for x in bar["path"]]
        again = None
        if account.on_fills and active:

            def again(bar=bar):  # noqa: ANN001, ANN202
                """After a fill the strategy runs on the price of the moment, and its memory is put back."""
                kept = copy.deepcopy(memory)
                strategy(broker, bar | {"close": broker.close_price}, memory)
                memory.clear()
                memory.update(kept)

        broker.advance(bar["ts"], bar["open"], bar["high"], bar["low"], bar["close"], path, jumps, again)
        if active:
            strategy(broker, bar, memory)
        broker.settle(bar["high"], bar["low"])
        if points is not None:
            found.append(points(broker, bar))
    return broker, found


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {dict(df.dtypes)[n]}" for n in names)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def backtest(
    bars: DataFrame,
    strategy: Strategy,
    account: Account | None = None,
    params: dict | None = None,
    keys: tuple[str, ...] = ("symbol",),
    equity: bool = False,
    start: object = None,
    what: str | None = None,
) -> DataFrame:
    """Of each series its closed ``trades``, its ``equity`` or whole ``state`` at each bar, or its ``open`` trades at the end.

    ``bars`` may carry indicator columns, which the strategy finds in its bar; ``children`` (array of
    lower bars) or ``path`` (array of prices) refine the way along a bar. With ``start`` the strategy runs from the bar
    before that time on. One shuffle by the keys; rows of a series are ordered within its task.
    """
    account, params, names = account or Account(), params or {}, list(keys)
    what = what or ("equity" if equity else "trades")
    columns = _names(WHAT[what])

    def equity_point(own: Broker, bar: dict) -> tuple:
        return bar["ts"], own.bar, own.equity(), own.open_profit(bar["close"]), own.position

    def state_point(own: Broker, bar: dict) -> tuple:
        now = own.state() | {"ts": bar["ts"], "bar": own.bar}
        return tuple(now[c] for c in columns)

    points = {"equity": equity_point, "state": state_point}.get(what)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        broker, curve = _simulate(_bars(rows), strategy, account, params, start, points)
        found = curve if points else broker.trades if what == "trades" else broker.open_trades()
        found = pd.DataFrame(found, columns=columns)
        for k in reversed(names):
            found.insert(0, k, rows[k].iloc[0])
        return found

    return bars.groupBy(*names).applyInPandas(run, f"{_kinds(bars, names)}, {WHAT[what]}")


def run(
    bars: DataFrame,
    strategy: Strategy,
    input_tf: str,
    script_tf: str,
    account: Account | None = None,
    params: dict | None = None,
    keys: tuple[str, ...] = ("symbol",),
    magnifier: bool = False,
    samples: int = 4,
    spread: str = "endpoints",
    indicators: Callable[[DataFrame], DataFrame] | None = None,
    what: str = "trades",
    start: object = None,
) -> DataFrame:
    """A backtest on bars of ``script_tf`` made of a feed of ``input_tf``, which must not be coarser.

    ``magnifier`` walks the feed's bars inside each script bar; where both timeframes are one, ``samples``
    prices along the bar's path by ``spread``. ``indicators`` adds columns to the script's bars. A
    last bucket that is not whole is left out.
    """
    from tickframe.plans import timeframes  # plans use this module for their queries

    ratio = timeframes.tf_ratio(input_tf, script_tf)
    if ratio == -2:
        raise ValueError(f"bars of {input_tf} can't make bars of {script_tf}")
    if ratio == 1 and input_tf == script_tf:
        script = bars
        if magnifier:
            script = script.withColumn("path", F.transform(timeframes.shares(F.lit(samples), spread), timeframes.path))
    else:
        done = timeframes.completions(bars, script_tf, input_tf, keys).where("ts is not null").select(*keys, "bucket")
        script = timeframes.resample(bars, script_tf, keys).join(done, [*keys, "bucket"], "left_semi")
        if magnifier:
            script = script.join(timeframes.lower_bars(bars, script_tf, keys), [*keys, "bucket"])
        script = script.drop("bucket", "bars")
    if indicators is not None:
        script = indicators(script)
    return backtest(script, strategy, account, params, keys, what=what, start=start)


def sweep(bars: DataFrame, strategy: Strategy, grid: list[dict], account: Account | None = None, keys: tuple[str, ...] = ("symbol",), block: int = 32) -> DataFrame:
    """(keys, param_id, trades, net_profit, max_drawdown) of every parameter set; ``account.<field>`` names set the account.

    A task gets a series and a block of sets, so the bars are moved once for each block, not for each
    set, and few series with many sets still run side by side.
    """
    account, names = account or Account(), list(keys)
    blocks = -(-len(grid) // block)
    dealt = bars.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))

    def own_sets(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["_block"].iloc[0]) * block
        series, out = _bars(rows), []
        for number, params in enumerate(grid[first : first + block], first):
            own = replace(account, **{k.partition(".")[2]: v for k, v in params.items() if k.startswith("account.")})
            broker, points = _simulate(series, strategy, own, params, None, lambda b, _: (b.equity(),))
            values = np.array([p[0] for p in points], dtype=float)
            fall = float((np.maximum.accumulate(values) - values).max()) if len(values) else 0.0
            out.append([*(rows[k].iloc[0] for k in names), number, len(broker.trades), sum(t["pnl"] for t in broker.trades), fall])
        return pd.DataFrame(out, columns=[*names, "param_id", "trades", "net_profit", "max_drawdown"])

    return dealt.groupBy(*names, "_block").applyInPandas(own_sets, f"{_kinds(bars, names)}, param_id int, trades int, net_profit double, max_drawdown double")
