"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe import broker, sources
from tickframe.functions import scalars, sessions
from tickframe.operators import arrays as a
from tickframe.operators import recurrences as r
from tickframe.operators import windows as w
from tickframe.plans import metrics, reports, timeframes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

S = w.Series(dense=True)


class Columns:
    """Columns by name, made when they are asked for: there may be no session yet."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


X = Columns()

BARS_SQL = """bars AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER q AS rn, lag(close) OVER q AS pc, lag(high) OVER q AS ph, lag(low) OVER q AS pl, lag(volume) OVER q AS pv,
 (high + low + close) / 3 AS tp FROM bars WINDOW q AS (PARTITION BY symbol ORDER BY ts)),
d AS (SELECT *, CASE WHEN pc IS NULL THEN NULL ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, close - pc AS dc FROM b)"""


def over(n: int | None = None, after: int = 0, by: str = "symbol") -> str:
    """A window clause: n rows to the current one (or ``after`` rows before it), or all so far."""
    frame = f"ROWS BETWEEN {n - 1 + after if n else 'UNBOUNDED'} PRECEDING AND {f'{after} PRECEDING' if after else 'CURRENT ROW'}"
    return f"OVER (PARTITION BY {by} ORDER BY ts {frame})"


def lst(n: int) -> str:
    """The last n closes, oldest first, once there are n."""
    return f"(CASE WHEN rn >= {n} THEN list(close) {over(n)} END)"


def rounded(digits: int = 6, **columns: Column) -> list[Column]:
    return [F.round(c, digits).alias(n) for n, c in columns.items()]


def window(name: str, value: Callable[[], Column], sql: str, flag: bool = False, digits: int = 6) -> None:
    """Register an indicator over hourly bars: (symbol, ts, value)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = sources.event_bars(spark, sf_dir)
        return bars.select("symbol", "ts", value().alias("value") if flag else F.round(value().cast("double"), digits).alias("value"))

    QUERIES[name] = run
    SQL[name] = f"WITH {BARS_SQL}, v AS (SELECT symbol, ts, {sql} AS value FROM d) SELECT symbol, ts, {'value' if flag else f'round(CAST(value AS DOUBLE), {digits}) AS value'} FROM v"


def full(n: int, sql: str) -> str:
    return f"CASE WHEN rn >= {n} THEN {sql} END"


# --- windows --------------------------------------------------------------------------------

window("hist_lag3", lambda: S.lag(X.close, 3), f"lag(close, 3) {over().replace('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW', '')}")
window("src_hl2", lambda: w.hl2(), "(high + low) / 2")
window("src_hlc3", lambda: w.hlc3(), "(high + low + close) / 3")
window("src_ohlc4", lambda: w.ohlc4(), "(open + high + low + close) / 4")
window("src_hlcc4", lambda: w.hlcc4(), "(high + low + 2 * close) / 4")
window("ta_sma", lambda: w.sma(S, X.close, 14), full(14, f"avg(close) {over(14)}"))
window("ta_sum", lambda: w.rolling_sum(S, X.close, 10), full(10, f"sum(close) {over(10)}"))
window("ta_vwma", lambda: w.vwma(S, X.close, X.volume, 10), full(10, f"sum(close * volume) {over(10)} / sum(volume) {over(10)}"), digits=9)
LAG = "(PARTITION BY symbol ORDER BY ts)"
window("ta_swma", lambda: w.swma(S, X.close), f"(lag(close, 3) OVER {LAG} + 2 * lag(close, 2) OVER {LAG} + 2 * lag(close, 1) OVER {LAG} + close) / 6")
window("ta_change", lambda: w.change(S, X.close, 3), f"close - lag(close, 3) OVER {LAG}")
window("ta_mom", lambda: w.momentum(S, X.close, 10), f"close - lag(close, 10) OVER {LAG}")
window("ta_roc", lambda: w.roc(S, X.close, 9), f"100 * (close - lag(close, 9) OVER {LAG}) / lag(close, 9) OVER {LAG}")
window("ta_stoch", lambda: w.stochastic(S, X.close, X.high, X.low, 14), full(14, f"100 * (close - min(low) {over(14)}) / nullif(max(high) {over(14)} - min(low) {over(14)}, 0)"))
window("ta_wpr", lambda: w.williams_r(S, 14), full(14, f"-100 * (max(high) {over(14)} - close) / nullif(max(high) {over(14)} - min(low) {over(14)}, 0)"))
window("ta_rising", lambda: w.rising(S, X.close, 2), f"CASE WHEN rn > 2 AND close > max(close) {over(2, 1)} THEN 1.0 ELSE 0.0 END")
window("ta_falling", lambda: w.falling(S, X.close, 2), f"CASE WHEN rn > 2 AND close < min(close) {over(2, 1)} THEN 1.0 ELSE 0.0 END")
FLOW = f"sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) {over(14)}", f"sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) {over(14)}"
window("ta_cmo", lambda: w.cmo(S, X.close, 9), full(10, f"100 * (sum(greatest(dc, 0)) {over(9)} - sum(greatest(-dc, 0)) {over(9)}) / nullif(sum(greatest(dc, 0)) {over(9)} + sum(greatest(-dc, 0)) {over(9)}, 0)"))
window("ta_tr", lambda: w.true_range(S), "tr")
window("ta_tr_handled", lambda: w.true_range(S, True), "coalesce(tr, high - low)")
window("ta_stdev", lambda: w.stdev(S, X.close, 20), full(20, f"stddev_pop(close) {over(20)}"))
window("ta_stdev_sample", lambda: w.stdev(S, X.close, 20, False), full(20, f"stddev_samp(close) {over(20)}"))
window("ta_variance", lambda: w.variance(S, X.close, 20), full(20, f"var_pop(close) {over(20)}"))
window("ta_bbw", lambda: w.bollinger_width(S, X.close, 20, 2.0), full(20, f"100 * 4 * stddev_pop(close) {over(20)} / avg(close) {over(20)}"))
window("ta_highest", lambda: w.highest(S, X.close, 10), full(10, f"max(close) {over(10)}"))
window("ta_lowest", lambda: w.lowest(S, X.close, 10), full(10, f"min(close) {over(10)}"))
window("ta_range", lambda: w.value_range(S, X.close, 10), full(10, f"max(close) {over(10)} - min(close) {over(10)}"))
window("ta_pivothigh", lambda: w.pivot_high(S, X.high, 3, 2), f"CASE WHEN rn >= 6 AND lag(high, 2) OVER {LAG} >= max(high) {over(3, 3)} AND lag(high, 2) OVER {LAG} > max(high) {over(2)} THEN lag(high, 2) OVER {LAG} END")
window("ta_pivotlow", lambda: w.pivot_low(S, X.low, 3, 2), f"CASE WHEN rn >= 6 AND lag(low, 2) OVER {LAG} <= min(low) {over(3, 3)} AND lag(low, 2) OVER {LAG} < min(low) {over(2)} THEN lag(low, 2) OVER {LAG} END")
window("ta_median", lambda: w.median(S, X.close, 9), full(9, f"quantile_cont(close, 0.5) {over(9)}"))
window("ta_mode", lambda: w.mode(S, X.volume, 12), "NULL")
SQL["ta_mode"] = f"""WITH {BARS_SQL}, v AS (SELECT symbol, ts, rn, list(volume) {over(12)} AS xs FROM d),
u AS (SELECT symbol, ts, rn, unnest(xs) AS x FROM v), c AS (SELECT symbol, ts, rn, x, count(*) AS n FROM u GROUP BY ALL),
k AS (SELECT symbol, ts, rn, x, row_number() OVER (PARTITION BY symbol, ts ORDER BY n DESC, x) AS place FROM c)
SELECT symbol, ts, CASE WHEN rn >= 12 THEN round(x, 6) END AS value FROM k WHERE place = 1"""
window("ta_cum", lambda: w.cumulative(S, X.volume), f"sum(volume) {over()}")
window("ta_alltimemax", lambda: w.all_time_max(S, X.close), f"max(close) {over()}")
window("ta_alltimemin", lambda: w.all_time_min(S, X.close), f"min(close) {over()}")
window("ta_obv", lambda: w.obv(S), f"sum(coalesce(sign(dc) * volume, 0)) {over()}")
window("ta_accdist", lambda: w.accumulation(S), f"sum(coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0)) {over()}")
window("ta_pvt", lambda: w.pvt(S), f"sum(coalesce(dc / pc * volume, 0)) {over()}", digits=4)
window("ta_wad", lambda: w.wad(S), f"sum(CASE WHEN dc > 0 THEN close - least(low, pc) WHEN dc < 0 THEN close - greatest(high, pc) ELSE 0 END) {over()}")
window("ta_wvad", lambda: w.wvad(), "coalesce((close - open) / nullif(high - low, 0) * volume, 0)")
window("ta_iii", lambda: w.iii(), "coalesce((2 * close - high - low) / nullif(high - low, 0) * volume, 0)")
DAY = "symbol, date_trunc('day', ts)"
window("ta_vwap", lambda: w.vwap(S, w.hlc3(), X.volume), f"sum(tp * volume) {over(by=DAY)} / sum(volume) {over(by=DAY)}")
window("ta_vwap_upper", lambda: w.vwap_bands(S, w.hlc3(), X.volume, 2.0)["upper"], f"sum(tp * volume) {over(by=DAY)} / sum(volume) {over(by=DAY)} + 2 * sqrt(greatest(sum(tp * tp * volume) {over(by=DAY)} / sum(volume) {over(by=DAY)} - (sum(tp * volume) {over(by=DAY)} / sum(volume) {over(by=DAY)}) ** 2, 0))")
window("ta_correlation", lambda: w.correlation(S, X.close, X.volume, 20), full(20, f"CASE WHEN stddev_pop(close) {over(20)} = 0 OR stddev_pop(volume) {over(20)} = 0 THEN 0 ELSE corr(close, volume) {over(20)} END"))
window("ta_barssince", lambda: w.bars_since(S, X.close > X.open), f"rn - max(CASE WHEN close > open THEN rn END) {over()}")
window("nz", lambda: scalars.nz(S.lag(X.close)), "coalesce(pc, 0)")

# --- lists ----------------------------------------------------------------------------------

window("ta_wma", lambda: a.wma(S, X.close, 10), f"list_sum(list_transform({lst(10)}, lambda x, i: x * i)) / 55.0")
window("ta_cog", lambda: a.cog(S, X.close, 10), f"-list_sum(list_transform({lst(10)}, lambda x, i: x * (11 - i))) / list_sum({lst(10)})")
window("ta_percentile_nearest", lambda: a.percentile_nearest(S, X.close, 10, 75), f"list_sort({lst(10)})[8]")
window("ta_percentile_linear", lambda: a.percentile_linear(S, X.close, 10, 75), f"list_sort({lst(10)})[7] + (list_sort({lst(10)})[8] - list_sort({lst(10)})[7]) * 0.75")
window("ta_linreg", lambda: a.linreg(S, X.close, 10), f"list_avg({lst(10)}) + list_sum(list_transform({lst(10)}, lambda x, i: x * (i - 5.5))) / 82.5 * 4.5")
window("ta_highestbars", lambda: a.highest_bars(S, X.close, 10), f"list_position({lst(10)}, list_max({lst(10)})) - 10")
window("ta_lowestbars", lambda: a.lowest_bars(S, X.close, 10), f"list_position({lst(10)}, list_min({lst(10)})) - 10")


def listed(name: str, value: Callable[[], Column], n: int, sql: str) -> None:
    """As ``window``, with SQL over xs (the last n closes) of a finished relation, where lambdas may refer to it."""
    window(name, value, "NULL")
    SQL[name] = f"WITH {BARS_SQL}, e AS (SELECT symbol, ts, close, {lst(n)} AS xs FROM d) SELECT symbol, ts, round({sql}, 6) AS value FROM e"


listed("ta_dev", lambda: a.deviation(S, X.close, 10), 10, "list_sum(list_transform(xs, lambda x: abs(x - list_avg(xs)))) / 10")
listed("ta_cci", lambda: a.cci(S, X.close, 20), 20, "CASE WHEN xs IS NULL THEN NULL WHEN list_sum(list_transform(xs, lambda x: abs(x - list_avg(xs)))) = 0 THEN 0 ELSE (close - list_avg(xs)) / (0.015 * list_sum(list_transform(xs, lambda x: abs(x - list_avg(xs)))) / 20) END")
listed("ta_percentrank", lambda: a.percent_rank(S, X.close, 10), 11, "100.0 * len(list_filter(xs[1:10], lambda x: x <= close + 1e-10)) / 10")
listed("ta_rci", lambda: a.rci(S, X.close, 9), 9, "100 * (1 - 6 * list_sum(list_transform(xs, lambda v, i: (len(list_filter(xs, lambda o: o < v)) + (len(list_filter(xs, lambda o: o = v)) + 1) / 2.0 - i) ** 2)) / 720.0)")
listed("ta_alma", lambda: a.alma(S, X.close, 9), 9, "list_sum(list_transform(xs, lambda x, i: x * exp(-((i - 1 - 6.8) ** 2) / (2 * 1.5 * 1.5)))) / list_sum(list_transform(range(0, 9), lambda i: exp(-((i - 6.8) ** 2) / (2 * 1.5 * 1.5))))")


def framed(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """Register a query that makes its own columns from hourly bars."""
    QUERIES[name] = lambda spark, sf_dir: build(sources.event_bars(spark, sf_dir))
    if sql:
        SQL[name] = f"WITH {'RECURSIVE ' if 'rec AS' in sql else ''}{BARS_SQL}, {sql}"


framed("ta_valuewhen", lambda b: w.value_when(b, S, X.close > X.open, X.high, 1, "value").select("symbol", "ts", *rounded(value=X.value)), f"z AS (SELECT 1) SELECT symbol, ts, round((list(high) FILTER (close > open) {over()})[-2], 6) AS value FROM d")
framed("bars_hourly", lambda b: b.select("symbol", "ts", "open", "high", "low", "close", "volume"), "z AS (SELECT 1) SELECT symbol, ts, open, high, low, close, volume FROM bars")
framed(
    "ta_mfi",
    lambda b: b.withColumn("tp", w.hlc3()).select("symbol", "ts", *rounded(value=w.mfi(S, F.col("tp"), X.volume, 14))),
    f"e AS (SELECT *, lag(tp) OVER {LAG} AS ptp FROM d), f AS (SELECT symbol, ts, rn, {FLOW[0]} AS up, {FLOW[1]} AS dn FROM e) SELECT symbol, ts, round(CASE WHEN rn >= 15 THEN CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END END, 6) AS value FROM f",
)
framed(
    "ta_bb",
    lambda b: b.withColumn("_b", w.bollinger(S, X.close, 20, 2.0)).select("symbol", "ts", *rounded(middle=F.col("_b.middle"), upper=F.col("_b.upper"), lower=F.col("_b.lower"))),
    f"e AS (SELECT symbol, ts, rn, avg(close) {over(20)} AS m, 2 * stddev_pop(close) {over(20)} AS s FROM d) SELECT symbol, ts, round(CASE WHEN rn >= 20 THEN m END, 6) AS middle, round(CASE WHEN rn >= 20 THEN m + s END, 6) AS upper, round(CASE WHEN rn >= 20 THEN m - s END, 6) AS lower FROM e",
)
framed("ta_hma", lambda b: a.hma(b, S, "close", 9, "value").select("symbol", "ts", *rounded(value=F.col("value"))), f"""e AS (SELECT symbol, ts, rn, 2 * list_sum(list_transform({lst(4)}, lambda x, i: x * i)) / 10.0 - list_sum(list_transform({lst(9)}, lambda x, i: x * i)) / 45.0 AS x FROM d),
f AS (SELECT symbol, ts, rn, list(x) {over(3)} AS xs FROM e) SELECT symbol, ts, round(CASE WHEN rn >= 11 THEN list_sum(list_transform(xs, lambda x, i: x * i)) / 6.0 END, 6) AS value FROM f""")
TWO = f"e AS (SELECT symbol, ts, CASE WHEN rn >= 10 THEN avg(close) {over(10)} END AS a, CASE WHEN rn >= 30 THEN avg(close) {over(30)} END AS b FROM d), f AS (SELECT *, lag(a) OVER {LAG} AS pa, lag(b) OVER {LAG} AS pb FROM e)"


def averages(b: DataFrame) -> DataFrame:
    return b.select("symbol", "ts", w.sma(S, X.close, 10).alias("a"), w.sma(S, X.close, 30).alias("b"))


framed("ta_crossover", lambda b: averages(b).select("symbol", "ts", w.crossover(S, X.a, X.b).alias("flag")), f"{TWO} SELECT symbol, ts, coalesce(a > b AND (pa <= pb OR (pa IS NULL AND pb IS NOT NULL)), false) AS flag FROM f")
framed("ta_crossunder", lambda b: averages(b).select("symbol", "ts", w.crossunder(S, X.a, X.b).alias("flag")), f"{TWO} SELECT symbol, ts, coalesce(a < b AND (pa >= pb OR (pa IS NULL AND pb IS NOT NULL)), false) AS flag FROM f")
framed("ta_cross", lambda b: averages(b).select("symbol", "ts", w.cross(S, X.a, X.b).alias("flag")), f"{TWO}, g AS (SELECT symbol, ts, sign(a - b) AS s FROM f), h AS (SELECT *, last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM g) SELECT symbol, ts, coalesce(s <> 0 AND s <> p, false) AS flag FROM h")


# --- recurrences ----------------------------------------------------------------------------


def recurrent(name: str, spec: r.Spec, state: dict[str, tuple[str, str]] | None, values: dict[str, str] | None = None, digits: int = 6) -> None:
    """Register a recurrence; ``state`` gives SQL for each state column's first value (from b) and next (from r and b)."""
    outputs = list(spec.outputs)
    if state is None:
        sql = None
    else:
        start = ", ".join(f"CAST({v[0]} AS DOUBLE) AS {k}" for k, v in state.items())
        step = ", ".join(f"CAST({v[1]} AS DOUBLE)" for v in state.values())
        found = ", ".join(f"round({(values or {}).get(o, o)}, {digits}) AS {o}" for o in outputs)
        sql = f"rec AS (SELECT symbol, ts, rn, {start} FROM d b WHERE rn = 1 UNION ALL SELECT b.symbol, b.ts, b.rn, {step} FROM rec r JOIN d b ON b.symbol = r.symbol AND b.rn = r.rn + 1) SELECT symbol, ts, {found} FROM rec"
    framed(name, lambda b: r.recur(b, [spec]).select("symbol", "ts", *rounded(digits, **{o: F.col(o) for o in outputs})), sql)


def ema_sql(x: str, n: int, name: str) -> tuple[str, str]:
    return x.replace("b.", ""), f"{2.0 / (n + 1)!r} * {x} + {1 - 2.0 / (n + 1)!r} * r.{name}"


def rma_sql(x: str, n: int, name: str, lead: int = 0) -> dict[str, tuple[str, str]]:
    """Sum of the first n values and the smoothed mean; ``lead`` rows come before the first value."""
    m = n + lead
    first = "0" if lead else x.replace("b.", "")
    return {
        f"{name}_sum": (first, f"r.{name}_sum + {x}"),
        name: (f"CASE WHEN {m} = 1 THEN {first} END", f"CASE WHEN b.rn < {m} THEN NULL WHEN b.rn = {m} THEN (r.{name}_sum + {x}) / {n} ELSE ({x} + {n - 1} * r.{name}) / {n} END"),
    }


recurrent("ta_ema", r.ema("close", 10, "value"), {"value": ema_sql("b.close", 10, "value")})
recurrent("ta_rma", r.rma("close", 14, "value"), rma_sql("b.close", 14, "value"))
recurrent("ta_atr", r.atr(14, "value"), rma_sql("coalesce(b.tr, b.high - b.low)", 14, "value"))
recurrent("ta_rsi", r.rsi("close", 14, "value"), rma_sql("greatest(b.dc, 0)", 14, "up", 1) | rma_sql("greatest(-b.dc, 0)", 14, "down", 1), {"value": "CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END"})
FAST, SLOW = ema_sql("b.close", 12, "f"), ema_sql("b.close", 26, "s")
recurrent("ta_macd", r.macd("close", 12, 26, 9, "macd"), {"f": FAST, "s": SLOW, "g": ("0", f"0.2 * (({FAST[1]}) - ({SLOW[1]})) + 0.8 * r.g")}, {"macd": "f - s", "macd_signal": "g", "macd_hist": "f - s - g"})
#: The prices of events leap, so these indexes span many powers of ten and are compared by logarithm.
for _name, _spec, _turn in (("ta_nvi", r.nvi("value"), "<"), ("ta_pvi", r.pvi("value"), ">")):
    framed(
        _name,
        lambda b, spec=_spec: r.recur(b, [spec]).select("symbol", "ts", F.round(F.log10(X.value + 1), 6).alias("value")),
        f"rec AS (SELECT symbol, ts, rn, CAST(1 AS DOUBLE) AS value FROM d WHERE rn = 1 UNION ALL SELECT b.symbol, b.ts, b.rn, CASE WHEN b.volume {_turn} b.pv AND b.pc <> 0 THEN r.value + r.value * ((b.close - b.pc) / b.pc) ELSE r.value END FROM rec r JOIN d b ON b.symbol = r.symbol AND b.rn = r.rn + 1) SELECT symbol, ts, round(log10(value + 1), 6) AS value FROM rec",
    )
HA_CLOSE = "(b.open + b.high + b.low + b.close) / 4"
HA_OPEN = "(r.ha_open + r.ha_close) / 2"
recurrent(
    "heikin_ashi",
    r.heikin_ashi("ha"),
    {
        "ha_open": ("(open + close) / 2", HA_OPEN),
        "ha_high": ("greatest(high, (open + close) / 2, (open + high + low + close) / 4)", f"greatest(b.high, {HA_OPEN}, {HA_CLOSE})"),
        "ha_low": ("least(low, (open + close) / 2, (open + high + low + close) / 4)", f"least(b.low, {HA_OPEN}, {HA_CLOSE})"),
        "ha_close": (HA_CLOSE.replace("b.", ""), HA_CLOSE),
    },
)
K_TR = ("NULL", f"CASE WHEN b.rn = 2 THEN b.tr ELSE {2 / 21!r} * b.tr + {1 - 2 / 21!r} * r.k END")
recurrent("ta_kc", r.keltner("close", 20, 1.5, "kc"), {"m": ema_sql("b.close", 20, "m"), "k": K_TR}, {"kc": "CASE WHEN k IS NOT NULL THEN m END", "kc_upper": "m + 1.5 * k", "kc_lower": "m - 1.5 * k", "kc_width": "2 * 1.5 * k / nullif(m, 0)"})


def stepped(name: str, spec: r.Spec, start: str, steps: list[str], state: str, values: dict[str, str], source: str = "d") -> None:
    """Register a recurrence whose step is several selections, each over the one before; r is the row before, b this one."""
    inner = f"SELECT b.*, {steps[0]} FROM rec r JOIN src b ON b.symbol = r.symbol AND b.rn = r.rn + 1"
    for step in steps[1:]:
        inner = f"SELECT *, {step} FROM ({inner})"
    sql = f"src AS ({source}), rec AS (SELECT symbol, ts, rn, {start} FROM src WHERE rn = 1 UNION ALL SELECT symbol, ts, rn, {state} FROM ({inner})) SELECT symbol, ts, " + ", ".join(f"round({v}, 6) AS {o}" for o, v in values.items()) + " FROM rec"
    framed(name, lambda b: r.recur(b, [spec]).select("symbol", "ts", *rounded(**{o: F.col(o) for o in spec.outputs})), sql)


def nulls(*names: str) -> str:
    return ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in names)


def mean_of(x: str, n: int, total: str, mean: str, lead: int) -> str:
    """The smoothed mean of n values that begin after ``lead`` rows, as SQL over the row before and this one."""
    return f"CASE WHEN rn < {n + lead} THEN NULL WHEN rn = {n + lead} THEN ({total} + {x}) / {n} ELSE ({x} + {n - 1} * {mean}) / {n} END"


SMOOTH = lambda x, n, before: f"CASE WHEN rn = 2 THEN {x} ELSE {2 / (n + 1)!r} * {x} + {1 - 2 / (n + 1)!r} * {before} END"
stepped(
    "ta_tsi",
    r.tsi("close", 5, 10, "value"),
    nulls("a1", "a2", "b1", "b2"),
    ["r.a1 AS pa1, r.a2 AS pa2, r.b1 AS pb1, r.b2 AS pb2", f"{SMOOTH('dc', 10, 'pa1')} AS a1, {SMOOTH('abs(dc)', 10, 'pb1')} AS b1", f"{SMOOTH('a1', 5, 'pa2')} AS a2, {SMOOTH('b1', 5, 'pb2')} AS b2"],
    "a1, a2, b1, b2",
    {"value": "a2 / nullif(b2, 0)"},
    "SELECT * FROM d",
)
stepped(
    "ta_dmi",
    r.dmi(14, 14, "dmi"),
    "0.0::DOUBLE AS sp, 0.0::DOUBLE AS sm, 0.0::DOUBLE AS st, 0.0::DOUBLE AS sx, " + nulls("p", "m", "t", "x"),
    [
        "r.sp AS qsp, r.sm AS qsm, r.st AS qst, r.sx AS qsx, r.p AS qp, r.m AS qm, r.t AS qt, r.x AS qx, b.high - b.ph AS up, b.pl - b.low AS dn",
        "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS dp, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS dm",
        f"qsp + dp AS sp, qsm + dm AS sm, qst + tr AS st, {mean_of('dp', 14, 'qsp', 'qp', 1)} AS p, {mean_of('dm', 14, 'qsm', 'qm', 1)} AS m, {mean_of('tr', 14, 'qst', 'qt', 1)} AS t",
        "CASE WHEN p + m = 0 THEN 0 ELSE 100 * abs(p - m) / (p + m) END AS dx",
        f"qsx + coalesce(dx, 0) AS sx, {mean_of('dx', 14, 'qsx', 'qx', 14)} AS x",
    ],
    "sp, sm, st, sx, p, m, t, x",
    {"dmi_plus": "100 * p / nullif(t, 0)", "dmi_minus": "100 * m / nullif(t, 0)", "dmi_adx": "x"},
    "SELECT * FROM d",
)
stepped(
    "ta_supertrend",
    r.supertrend(3.0, 10, "st"),
    "high - low AS s, " + nulls("a", "top", "bottom", "side"),
    [
        "r.s AS qs, r.a AS qa, r.top AS qtop, r.bottom AS qbottom, r.side AS qside",
        f"qs + tr AS s, {mean_of('tr', 10, 'qs', 'qa', 0)} AS a",
        "(high + low) / 2 + 3 * a AS t0, (high + low) / 2 - 3 * a AS b0",
        "CASE WHEN rn > 10 AND pc <= qtop THEN least(t0, qtop) ELSE t0 END AS top, CASE WHEN rn > 10 AND pc >= qbottom THEN greatest(b0, qbottom) ELSE b0 END AS bottom",
        "CASE WHEN a IS NULL THEN NULL WHEN rn = 10 THEN CASE WHEN close > top THEN -1 ELSE 1 END WHEN qside > 0 AND close > top THEN -1 WHEN qside < 0 AND close < bottom THEN 1 ELSE qside END AS side",
    ],
    "s, a, top, bottom, CAST(side AS DOUBLE)",
    {"st": "CASE WHEN side > 0 THEN top WHEN side < 0 THEN bottom END", "st_direction": "side"},
    "SELECT * FROM d",
)
stepped(
    "ta_sar",
    r.sar(0.02, 0.02, 0.2, "value"),
    "CAST(NULL AS BOOLEAN) AS up, 0.02::DOUBLE AS k, " + nulls("e", "v"),
    [
        "CASE WHEN b.rn = 2 THEN b.close > b.pc ELSE r.up END AS u0, CASE WHEN b.rn > 2 THEN r.e WHEN b.close > b.pc THEN b.high ELSE b.low END AS e0, CASE WHEN b.rn > 2 THEN r.v WHEN b.close > b.pc THEN b.pl ELSE b.ph END AS v0, r.k AS k0",
        "v0 + k0 * (e0 - v0) AS v1",
        "CASE WHEN u0 THEN low < v1 ELSE high > v1 END AS turn",
        "u0 <> turn AS up, CASE WHEN NOT turn THEN v1 WHEN u0 THEN greatest(high, e0) ELSE least(low, e0) END AS v2, CASE WHEN NOT turn THEN e0 WHEN u0 THEN low ELSE high END AS e1, CASE WHEN turn THEN 0.02 ELSE k0 END AS k1",
        "NOT turn AND rn > 2 AND CASE WHEN up THEN high > e1 ELSE low < e1 END AS further",
        "CASE WHEN NOT further THEN e1 WHEN up THEN high ELSE low END AS e, CASE WHEN further THEN least(k1 + 0.02, 0.2) ELSE k1 END AS k, CASE WHEN up THEN least(v2, pl, coalesce(ppl, pl)) ELSE greatest(v2, ph, coalesce(pph, ph)) END AS v",
    ],
    "up, CAST(k AS DOUBLE), e, v",
    {"value": "v"},
    f"SELECT *, lag(low, 2) OVER {LAG} AS ppl, lag(high, 2) OVER {LAG} AS pph FROM d",
)

# --- timeframes -----------------------------------------------------------------------------

OHLC = "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS bars"
for _name, _tf, _sql in (("resample_4h", "240", "time_bucket(INTERVAL '4 hours', ts)"), ("resample_day", "D", "date_trunc('day', ts)"), ("resample_week", "W", "date_trunc('week', ts)"), ("resample_month", "M", "date_trunc('month', ts)")):
    framed(
        _name,
        lambda b, tf=_tf: timeframes.resample(b, tf).select("symbol", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "ts", "open", "high", "low", "close", "volume", "bars"),
        f"z AS (SELECT 1) SELECT symbol, CAST({_sql} AS TIMESTAMP) AS bucket, min(ts) AS ts, {OHLC} FROM bars GROUP BY symbol, {_sql}",
    )
framed("tf_change_day", lambda b: b.select("symbol", "ts", timeframes.tf_change("D").alias("flag")), f"e AS (SELECT symbol, ts, date_trunc('day', ts) <> date_trunc('day', lag(ts) OVER {LAG}) AS c FROM bars) SELECT symbol, ts, coalesce(c, false) AS flag FROM e")
framed(
    "tf_detect",
    timeframes.detect,
    f"""e AS (SELECT symbol, ts, epoch(ts) - epoch(lag(ts) OVER {LAG}) AS step FROM bars), f AS (SELECT *, row_number() OVER {LAG} AS n FROM e WHERE step > 0),
m AS (SELECT symbol, median(step) AS m FROM f WHERE n <= 100 GROUP BY symbol), o AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {v})" for n, v in timeframes.DETECTABLE.items())}) AS t(tf, size))
SELECT symbol, arg_min(tf, abs(size - m)) AS tf FROM m, o GROUP BY symbol""",
)
FOUR = "h AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bucket, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(high) AS hh, arg_max(close, ts) AS hc FROM bars GROUP BY ALL)"
DONE = f"{FOUR}, k AS (SELECT *, CASE WHEN n = 4 THEN last_ts ELSE lead(first_ts) OVER (PARTITION BY symbol ORDER BY bucket) END AS due FROM h)"
framed("security_projected", lambda b: timeframes.security(b, "240", "60", {"hc": X.close}, projected=True).select("symbol", "ts", "hc"), f"{FOUR} SELECT b.symbol, b.ts, hc FROM bars b JOIN h ON b.symbol = h.symbol AND h.bucket = time_bucket(INTERVAL '4 hours', b.ts)")
framed(
    "security_lookahead",
    lambda b: timeframes.security(b, "240", "60", {"hh": X.high, "hc": X.close}, lookahead=True).select("symbol", "ts", "hh", "hc"),
    f"""{DONE}, e AS (SELECT symbol, ts, close, max(high) OVER (PARTITION BY symbol, time_bucket(INTERVAL '4 hours', ts) ORDER BY ts) AS run FROM bars)
SELECT e.symbol, e.ts, coalesce(k.hh, run) AS hh, coalesce(k.hc, close) AS hc FROM e LEFT JOIN k ON k.symbol = e.symbol AND k.due = e.ts AND k.bucket < time_bucket(INTERVAL '4 hours', e.ts)""",
)
framed("security_gaps", lambda b: timeframes.security(b, "240", "60", {"hc": X.close}, gaps=True).select("symbol", "ts", "hc"), f"{DONE} SELECT b.symbol, b.ts, hc FROM bars b LEFT JOIN k ON b.symbol = k.symbol AND k.due = b.ts")
framed("security_asof", lambda b: timeframes.security(b, "240", "60", {"hc": X.close}).select("symbol", "ts", "hc"), f"{DONE} SELECT b.symbol, b.ts, j.hc FROM bars b ASOF LEFT JOIN (SELECT * FROM k WHERE due IS NOT NULL) j ON b.symbol = j.symbol AND b.ts >= j.due")
framed(
    "security_day",
    lambda b: timeframes.security(b, "D", "60", {"hc": X.close}).select("symbol", "ts", "hc"),
    """h AS (SELECT symbol, date_trunc('day', ts) AS bucket, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(close, ts) AS hc FROM bars GROUP BY ALL),
k AS (SELECT *, CASE WHEN hour(last_ts) = 23 AND n > 1 THEN last_ts ELSE lead(first_ts) OVER (PARTITION BY symbol ORDER BY bucket) END AS due FROM h)
SELECT b.symbol, b.ts, j.hc FROM bars b ASOF LEFT JOIN (SELECT * FROM k WHERE due IS NOT NULL) j ON b.symbol = j.symbol AND b.ts >= j.due""",
)
framed(
    "security_smoothed",
    lambda b: timeframes.security(b, "D", "60", {"hc": X.close}, heikin_ashi=True, projected=True).select("symbol", "ts", F.round("hc", 6).alias("hc")),
    """h AS (SELECT symbol, date_trunc('day', ts) AS bucket, (arg_min(open, ts) + max(high) + min(low) + arg_max(close, ts)) / 4 AS hc FROM bars GROUP BY ALL)
SELECT b.symbol, b.ts, round(hc, 6) AS hc FROM bars b JOIN h ON b.symbol = h.symbol AND h.bucket = date_trunc('day', b.ts)""",
)
framed("expected_bars", lambda b: timeframes.expected_bars(b, "240", "60"), f"{DONE} SELECT symbol, count(due) AS bars FROM k GROUP BY symbol")
framed("lower_tf_bars", lambda b: timeframes.lower_bars(b, "240").select("symbol", F.col("bucket").alias("ts"), F.size("children").cast("long").alias("n"), F.element_at("children", 1)["open"].alias("first_open")), "z AS (SELECT 1) SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, count(*) AS n, arg_min(open, ts) AS first_open FROM bars GROUP BY ALL")
framed("gap_filled_bars", lambda b: timeframes.filled(b, 3600), f"""e AS (SELECT *, coalesce(lead(ts) OVER {LAG}, ts + INTERVAL '1 hour') AS nx FROM bars), f AS (SELECT e.*, unnest(generate_series(ts, nx - INTERVAL '1 hour', INTERVAL '1 hour')) AS t FROM e)
SELECT symbol, t AS ts, CASE WHEN t = ts THEN open ELSE close END AS open, CASE WHEN t = ts THEN high ELSE close END AS high, CASE WHEN t = ts THEN low ELSE close END AS low, close, CASE WHEN t = ts THEN volume ELSE 0 END AS volume FROM f""")
PATH = """CASE WHEN l1 + l2 + l3 = 0 THEN open WHEN t * (l1 + l2 + l3) <= l1 THEN CASE WHEN l1 = 0 THEN a ELSE open + (a - open) * (t * (l1 + l2 + l3)) / l1 END
 WHEN t * (l1 + l2 + l3) <= l1 + l2 THEN CASE WHEN l2 = 0 THEN b ELSE a + (b - a) * (t * (l1 + l2 + l3) - l1) / l2 END ELSE CASE WHEN l3 = 0 THEN close ELSE b + (close - b) * (t * (l1 + l2 + l3) - l1 - l2) / l3 END END"""
LEGS = """e AS (SELECT *, abs(high - open) < abs(open - low) AS up FROM bars), f AS (SELECT *, CASE WHEN up THEN high ELSE low END AS a, CASE WHEN up THEN low ELSE high END AS b FROM e),
g AS (SELECT *, abs(a - open) AS l1, abs(b - a) AS l2, abs(close - b) AS l3 FROM f)"""


def corners(n: int) -> str:
    """Relations up to ``h``, with the list ts of n shares of the path at its corners and between."""
    even = f"list_transform(range(0, {n}), lambda i: i / {n - 1}.0)"
    return f"""{LEGS}, g1 AS (SELECT *, CASE WHEN l1 + l2 + l3 = 0 THEN NULL ELSE l1 / (l1 + l2 + l3) END AS b0, CASE WHEN l1 + l2 + l3 = 0 THEN NULL ELSE (l1 + l2) / (l1 + l2 + l3) END AS b1 FROM g),
g2 AS (SELECT *, CASE WHEN b0 >= 1e-12 THEN b0 ELSE 0 END AS m0 FROM g1), g3 AS (SELECT *, CASE WHEN b1 - m0 >= 1e-12 THEN b1 ELSE m0 END AS m1 FROM g2),
g4 AS (SELECT *, list_filter([0.0, CASE WHEN b0 >= 1e-12 THEN b0 END, CASE WHEN b1 - m0 >= 1e-12 THEN b1 END, CASE WHEN 1 - m1 >= 1e-12 THEN 1.0 END], lambda x: x IS NOT NULL) AS m FROM g3),
g5 AS (SELECT *, {n} - len(m) AS room FROM g4), g6 AS (SELECT *, m || list_filter(list_transform(range(1, room + 1), lambda i: i / (room + 1.0)), lambda t: len(list_filter(m, lambda c: abs(c - t) < 1e-12)) = 0) AS fresh FROM g5),
h AS (SELECT *, CASE WHEN l1 + l2 + l3 = 0 OR room < 0 THEN {even} WHEN room = 0 THEN m ELSE list_sort(fresh || list_transform(range(len(fresh), {n}), lambda k: k / {n + 1}.0))[1:{n}] END AS shares FROM g6)"""


def path_sql(n: int, spread: str) -> str:
    """(symbol, ts, step, price) of n samples."""
    u = f"(step / {n - 1}.0)"
    formulas = {"uniform": u, "cosine": f"0.5 * (1 - cos({u} * pi()))", "triangle": f"CASE WHEN {u} <= 0.5 THEN 0.5 * sqrt(2 * {u}) ELSE 1 - 0.5 * sqrt(2 * (1 - {u})) END", "front": f"{u} * {u}", "back": f"1 - (1 - {u}) * (1 - {u})"}
    head = corners(n) if spread == "endpoints" else f"{LEGS}, h AS (SELECT * FROM g)"
    t = "shares[step + 1]" if spread == "endpoints" else formulas[spread]
    return f"{head}, k AS (SELECT h.*, unnest(range(0, {n})) AS step FROM h), q AS (SELECT *, {t} AS t FROM k), p AS (SELECT symbol, ts, volume, step, CASE WHEN step = 0 THEN open WHEN step = {n - 1} THEN close ELSE {PATH} END AS price FROM q)"


for _spread in ("uniform", "cosine", "triangle", "endpoints", "front", "back"):
    framed(
        f"price_path_{_spread}",
        lambda b, spread=_spread: timeframes.sampled(b, 7, spread).select("symbol", "ts", F.col("step").cast("int").alias("step"), F.round("price", 6).alias("price")),
        f"{path_sql(7, _spread)} SELECT symbol, ts, CAST(step AS INTEGER) AS step, round(price, 6) AS price FROM p",
    )
framed(
    "synthetic_lower_bars",
    lambda b: timeframes.synthesised(b, 4, 3600).select("symbol", "ts", *rounded(open=X.open, high=X.high, low=X.low, close=X.close, volume=X.volume)),
    f"""{path_sql(5, "endpoints")}, w AS (SELECT *, lead(price) OVER (PARTITION BY symbol, ts ORDER BY step) AS nx FROM p)
SELECT symbol, ts + to_minutes(CAST(15 * step AS INTEGER)) AS ts, round(price, 6) AS open, round(greatest(price, nx), 6) AS high, round(least(price, nx), 6) AS low, round(nx, 6) AS close, round(volume / 4, 6) AS volume FROM w WHERE nx IS NOT NULL""",
)
framed(
    "volume_samples",
    lambda b: b.withColumn("m", F.avg("volume").over(Window.partitionBy("symbol"))).select("symbol", "ts", timeframes.sample_count(8, 4, 24, X.m).cast("int").alias("n")),
    "e AS (SELECT symbol, ts, volume, avg(volume) OVER (PARTITION BY symbol) AS m FROM bars) SELECT symbol, ts, CAST(least(greatest(round(8 * least(greatest(volume / m, 0.25), 4.0)), 4), 24) AS INTEGER) AS n FROM e",
)

# --- sessions and calendar ------------------------------------------------------------------

framed(
    "calendar_parts",
    lambda b: b.select("symbol", "ts", *[sessions.part(p, X.ts, "America/New_York").cast("int").alias(p) for p in ("year", "month", "dayofmonth", "dayofweek", "hour", "minute", "weekofyear")]),
    """e AS (SELECT symbol, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM bars)
SELECT symbol, ts, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, CAST(day(t) AS INTEGER) AS dayofmonth, CAST(dayofweek(t) + 1 AS INTEGER) AS dayofweek, CAST(hour(t) AS INTEGER) AS hour, CAST(minute(t) AS INTEGER) AS minute,
CAST((dayofyear(t) - 1 + 7 - (isodow(t) - 1)) // 7 AS INTEGER) AS weekofyear FROM e""",
)
framed("session_filter", lambda b: b.select("symbol", "ts", sessions.in_session("0930-1600:23456", X.ts, "America/New_York").alias("flag")), """e AS (SELECT symbol, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM bars)
SELECT symbol, ts, hour(t) * 60 + minute(t) >= 570 AND hour(t) * 60 + minute(t) < 960 AND isodow(t) <= 5 AS flag FROM e""")
framed("session_overnight", lambda b: b.select("symbol", "ts", sessions.in_session("2200-0600", X.ts).alias("flag")), "z AS (SELECT 1) SELECT symbol, ts, hour(ts) >= 22 OR hour(ts) < 6 AS flag FROM bars")

NY = "(ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"


def back(wall: str) -> str:
    """UTC time of a New York one."""
    return f"(({wall}) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'"


framed(
    "time_functions",
    lambda b: b.select(
        "symbol", "ts",
        sessions.time(X.ts, "D", zone="America/New_York").alias("day"), sessions.time_close(X.ts, "W", zone="America/New_York").alias("week_end"), sessions.time_close(X.ts, "M").alias("month_end"),
        sessions.time(X.ts, "240", "0930-1600", "America/New_York").alias("in_session"), sessions.time_close(X.ts, "240").alias("close_4h"), sessions.trading_day(X.ts, "1800-1700", "America/New_York").alias("trading_day"),
        sessions.time(X.ts, "D", "America/New_York").alias("no_session"), sessions.day_open(X.ts, "Asia/Tokyo").alias("tokyo"), sessions.part("hour", X.ts, "UTC+5:30").cast("int").alias("india"),
    ),
    f"""e AS (SELECT symbol, ts, {NY} AS t FROM bars) SELECT symbol, ts, {back("date_trunc('day', t)")} AS day, {back("date_trunc('week', t) + INTERVAL '7 days'")} - INTERVAL '1 millisecond' AS week_end,
    date_trunc('month', ts) + INTERVAL '1 month' - INTERVAL '1 millisecond' AS month_end, CASE WHEN hour(t) * 60 + minute(t) BETWEEN 570 AND 959 THEN time_bucket(INTERVAL '4 hours', ts) END AS in_session,
    time_bucket(INTERVAL '4 hours', ts) + INTERVAL '4 hours' AS close_4h, {back("date_trunc('day', CASE WHEN hour(t) < 18 THEN t - INTERVAL '24 hours' ELSE t END)")} + INTERVAL '18 hours' AS trading_day,
    CAST(date_trunc('day', ts) AS TIMESTAMP) AS no_session, (date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC' AS tokyo, CAST(hour(ts + INTERVAL '330 minutes') AS INTEGER) AS india FROM e""",
)
framed(
    "session_edges",
    lambda b: b.select("symbol", "ts", sessions.first_bar("0930-1600:23456", "ts", "America/New_York").alias("first"), sessions.last_bar("0930-1600:23456", "ts", "America/New_York").alias("last"), sessions.premarket("0930-1600:23456", X.ts, "America/New_York").alias("pre"), sessions.postmarket("0930-1600:23456", X.ts, "America/New_York").alias("post")),
    f"""e AS (SELECT symbol, ts, {NY} AS t FROM bars), f AS (SELECT *, hour(t) * 60 + minute(t) AS m, isodow(t) <= 5 AS wd FROM e), g AS (SELECT *, wd AND m >= 570 AND m < 960 AS ins FROM f)
SELECT symbol, ts, ins AND NOT coalesce(lag(ins) OVER {LAG}, false) AS first, ins AND NOT coalesce(lead(ins) OVER {LAG}, false) AS last, wd AND m >= 240 AND m < 570 AS pre, wd AND m >= 960 AND m < 1200 AS post FROM g""",
)
framed("time_text", lambda b: b.select("symbol", "ts", scalars.format_time(X.ts, "yyyy/MM/dd HH:mm:ss", "America/New_York").alias("text")), f"e AS (SELECT symbol, ts, {NY} AS t FROM bars) SELECT symbol, ts, strftime(t, '%Y/%m/%d %H:%M:%S') AS text FROM e")
framed(
    "timestamps",
    lambda b: b.select("symbol", "ts", sessions.timestamp(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), zone="America/New_York").alias("back"), sessions.timestamp(F.year("ts"), F.month("ts") + 12, F.lit(0)).alias("over")),
    f"z AS (SELECT 1) SELECT symbol, ts, {back('ts')} AS back, CAST(date_trunc('month', ts) + INTERVAL '1 year' - INTERVAL '1 day' AS TIMESTAMP) AS over FROM bars",
)

# --- orders, statistics ---------------------------------------------------------------------


def crossing(own: broker.Broker, bar: dict, memory: dict) -> None:
    """Long above, short below: moving averages cross."""
    fast, slow = bar["fast"], bar["slow"]
    if fast is None or slow is None or fast != fast or slow != slow:
        return
    before = memory.get("before")
    if before is not None and (fast > slow) != before:
        own.entry("cross", fast > slow)
    memory["before"] = fast > slow


def bracketed(own: broker.Broker, bar: dict, memory: dict) -> None:
    """Buy on new highs with a bracket of limit and stop."""
    if own.position == 0 and bar["top"] == bar["top"] and bar["close"] >= bar["top"]:
        own.entry("in", True)
        own.exit("out", "in", limit=bar["close"] * memory["params"].get("gain", 1.05), stop=bar["close"] * memory["params"].get("loss", 0.9))


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = sources.event_bars(spark, sf_dir)
    return bars.select("*", w.sma(S, X.close, 10).alias("fast"), w.sma(S, X.close, 30).alias("slow"))


ACCOUNT = broker.Account(fee_value=0.1, slippage=1)


def _money(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES["backtest_cross"] = lambda spark, d: _money(broker.backtest(crossed(spark, d), crossing, ACCOUNT))
QUERIES["backtest_equity"] = lambda spark, d: _money(broker.backtest(crossed(spark, d), crossing, ACCOUNT, equity=True))
QUERIES["backtest_bracket"] = lambda spark, d: _money(broker.backtest(sources.event_bars(spark, d).withColumn("top", w.highest(S, X.high, 20)), bracketed, ACCOUNT))


def crossing_sql(grid: str = "SELECT 0 AS param_id, 0.1 AS fee, 1 AS slip") -> str:
    """Trades of ``crossing``, for each row of a grid of fees and slippage, and the equity at each bar."""
    return f"""WITH {BARS_SQL}, grid AS ({grid}), a AS (SELECT *, CASE WHEN rn >= 10 THEN avg(close) {over(10)} END AS fast, CASE WHEN rn >= 30 THEN avg(close) {over(30)} END AS slow FROM d),
s AS (SELECT *, fast > slow AS up, lag(fast > slow) OVER {LAG} AS was, lead(rn) OVER {LAG} AS fill_rn, lead(ts) OVER {LAG} AS fill_ts, lead(open) OVER {LAG} AS fill_open FROM a),
f AS (SELECT symbol, param_id, fee, up, fill_rn, fill_ts, CASE WHEN up THEN ceil((fill_open + slip * 0.01) / 0.01 - 1e-9) ELSE floor((fill_open - slip * 0.01) / 0.01 + 1e-9) END * 0.01 AS price FROM s, grid WHERE up <> was AND fill_rn IS NOT NULL),
t AS (SELECT *, row_number() OVER o AS trade, lead(fill_rn) OVER o AS out_rn, lead(fill_ts) OVER o AS out_ts, lead(price) OVER o AS out_price, CASE WHEN up THEN 1 ELSE -1 END AS sign FROM f WINDOW o AS (PARTITION BY symbol, param_id ORDER BY fill_rn)),
p AS (SELECT *, (price + out_price) * fee / 100 AS commission, (out_price - price) * sign - (price + out_price) * fee / 100 AS pnl FROM t),
x AS (SELECT p.symbol, param_id, trade, greatest(max(high), any_value(out_price), any_value(price)) AS top, least(min(low), any_value(out_price), any_value(price)) AS bottom FROM p JOIN d ON d.symbol = p.symbol AND d.rn >= p.fill_rn AND d.rn < p.out_rn GROUP BY ALL),
closed AS (SELECT p.*, 'cross' AS entry_id, greatest(0, CASE WHEN up THEN top - price ELSE price - bottom END - price * fee / 100) AS max_run_up, CASE WHEN up THEN price - bottom ELSE top - price END + price * fee / 100 AS max_drawdown FROM p JOIN x USING (symbol, param_id, trade)),
curve AS (SELECT d.symbol, param_id, d.ts, d.rn, 100000 + coalesce((SELECT sum(pnl) FROM p WHERE p.symbol = d.symbol AND p.param_id = grid.param_id AND p.out_rn <= d.rn), 0) AS base,
 coalesce((SELECT sum((d.close - price) * sign) FROM t WHERE t.symbol = d.symbol AND t.param_id = grid.param_id AND t.fill_rn <= d.rn AND (t.out_rn > d.rn OR t.out_rn IS NULL)), 0) AS open_profit,
 coalesce((SELECT sum(sign) FROM t WHERE t.symbol = d.symbol AND t.param_id = grid.param_id AND t.fill_rn <= d.rn AND (t.out_rn > d.rn OR t.out_rn IS NULL)), 0) AS position FROM d, grid)"""


MONEY = ("entry_price", "exit_price", "qty", "pnl", "pnl_pct", "commission", "max_run_up", "max_drawdown")
SQL["backtest_cross"] = crossing_sql() + """ SELECT symbol, CAST(trade AS INTEGER) AS trade, entry_id, up AS is_long, fill_ts AS entry_ts, CAST(fill_rn - 1 AS INTEGER) AS entry_bar, round(price, 6) AS entry_price, out_ts AS exit_ts, CAST(out_rn - 1 AS INTEGER) AS exit_bar,
 round(out_price, 6) AS exit_price, 1.0 AS qty, round(pnl, 6) AS pnl, round(pnl / price * 100, 6) AS pnl_pct, round(commission, 6) AS commission, round(max_run_up, 6) AS max_run_up, round(max_drawdown, 6) AS max_drawdown, 'cross' AS exit_id, '' AS entry_comment, '' AS exit_comment FROM closed"""
SQL["backtest_equity"] = crossing_sql() + " SELECT symbol, ts, CAST(rn - 1 AS INTEGER) AS bar, round(base + open_profit, 6) AS equity, round(CAST(open_profit AS DOUBLE), 6) AS open_profit, round(CAST(position AS DOUBLE), 6) AS position FROM curve"
SWEEP = [{"account.fee_value": f, "account.slippage": k} for f in (0.0, 0.05, 0.1) for k in (0, 1, 4)]
QUERIES["parameter_sweep"] = lambda spark, d: _money(broker.sweep(crossed(spark, d), crossing, SWEEP, ACCOUNT, block=4))
SQL["parameter_sweep"] = crossing_sql("SELECT * FROM (VALUES " + ", ".join(f"({i}, {g['account.fee_value']}, {g['account.slippage']})" for i, g in enumerate(SWEEP)) + ") AS g(param_id, fee, slip)") + """,
h AS (SELECT *, max(base + open_profit) OVER (PARTITION BY symbol, param_id ORDER BY rn) - base - open_profit AS fall FROM curve), n AS (SELECT symbol, param_id, max(fall) AS fall FROM h GROUP BY ALL),
m AS (SELECT symbol, param_id, count(*) AS trades, sum(pnl) AS net FROM closed GROUP BY ALL)
SELECT symbol, CAST(n.param_id AS INTEGER) AS param_id, CAST(coalesce(trades, 0) AS INTEGER) AS trades, round(coalesce(net, 0), 6) AS net_profit, round(fall, 6) AS max_drawdown FROM n LEFT JOIN m USING (symbol, param_id)"""


def crossed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broker.backtest(crossed(spark, sf_dir), crossing, ACCOUNT)


QUERIES["trade_csv"] = lambda spark, d: reports.trade_csv(crossed_trades(spark, d)).withColumnRenamed("rank", "step")
SQL["trade_csv"] = crossing_sql() + """, r AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY trade) AS total FROM closed), l AS (SELECT *, unnest([0, 1]) AS leg FROM r)
SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY trade DESC, leg) AS INTEGER) AS step, CAST(trade AS VARCHAR) AS "Trade #", CASE leg WHEN 0 THEN 'Exit ' ELSE 'Entry ' END || CASE WHEN up THEN 'long' ELSE 'short' END AS "Type",
 strftime(CASE leg WHEN 0 THEN out_ts ELSE fill_ts END, '%Y-%m-%d %H:%M') AS "Date and time", printf('%.6f', CASE leg WHEN 0 THEN out_price ELSE price END) AS "Price", '1' AS "Qty", printf('%.6f', pnl) AS "Net PnL", printf('%.4f', pnl / price * 100) AS "Net PnL %",
 printf('%.6f', max_run_up) AS "Favorable excursion USD", printf('%.6f', -max_drawdown) AS "Adverse excursion USD", printf('%.6f', total) AS "Cumulative PnL" FROM l"""
QUERIES["report_summary"] = lambda spark, d: _money(reports.summary(crossed_trades(spark, d)))
SQL["report_summary"] = crossing_sql() + """, r AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY trade) AS total FROM closed), q AS (SELECT *, total - greatest(max(total) OVER (PARTITION BY symbol ORDER BY trade), 0) AS fall FROM r)
SELECT symbol, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, round(count(*) FILTER (pnl > 0) / count(*) * 100, 4) AS win_rate_pct, round(sum(pnl), 6) AS net_pnl, round(avg(pnl), 6) AS avg_trade, round(max(pnl), 6) AS best_trade, round(min(pnl), 6) AS worst_trade, round(min(fall), 6) AS max_drawdown FROM q GROUP BY symbol"""


def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read back out of the JSON reports."""
    bars = crossed(spark, sf_dir)
    found = reports.report_json(broker.backtest(bars, crossing, ACCOUNT), broker.backtest(bars, crossing, ACCOUNT, equity=True), ACCOUNT.capital)
    field = lambda path: F.get_json_object("report", f"$.{path}").cast("double")
    return found.select("symbol", *rounded(total=field("summary.net_pnl"), first=field("trades[0].pnl"), longs=field("metrics.long.net_profit"), equity=field("equity_curve[0].equity"), points=field("equity.points"), in_market=field("equity.time_in_market_pct")))


QUERIES["report_json"] = report_fields
SQL["report_json"] = crossing_sql() + """, c AS (SELECT symbol, count(*) AS points, count(*) FILTER (position <> 0) / count(*) * 100 AS in_market FROM curve GROUP BY symbol)
SELECT symbol, round(sum(pnl), 6) AS total, round(arg_min(pnl, trade), 6) AS first, round(sum(pnl) FILTER (up), 6) AS longs, round(CAST(100000 AS DOUBLE), 6) AS equity, round(CAST(any_value(points) AS DOUBLE), 6) AS points, round(any_value(in_market), 6) AS in_market FROM closed JOIN c USING (symbol) GROUP BY symbol"""
framed(
    "trace_records",
    lambda b: reports.trace(b, {"range": X.high - X.low, "close": X.close}).select("symbol", "ts", F.col("bar_index").cast("int").alias("bar_index"), F.col("name").alias("side"), F.round("value", 6).alias("value")),
    "e AS (SELECT symbol, ts, CAST(rn - 1 AS INTEGER) AS bar_index, unnest(['range', 'close']) AS side, unnest([high - low, close]) AS value FROM d) SELECT symbol, ts, bar_index, side, round(value, 6) AS value FROM e",
)
framed("security_diagnostics", lambda b: reports.security_diagnostics(b, timeframes.completions(b, "240", "60")), f"{DONE}, c AS (SELECT symbol, count(due) AS complete FROM k GROUP BY symbol), n AS (SELECT symbol, count(*) AS feeds FROM bars GROUP BY symbol) SELECT symbol, feeds, complete, feeds - complete AS partial FROM n JOIN c USING (symbol)")
framed("feed_digest", lambda b: reports.feed_digest(b), None)
QUERIES["run_4h"] = lambda spark, d: _money(broker.run(sources.event_bars(spark, d), crossing, "60", "240", ACCOUNT, indicators=lambda b: b.select("*", w.sma(S, X.close, 10).alias("fast"), w.sma(S, X.close, 30).alias("slow"))).select("symbol", "trade", "is_long", "entry_ts", "entry_price", "exit_ts", "exit_price", "pnl"))
SQL["run_4h"] = crossing_sql().replace(BARS_SQL, BARS_SQL.replace("bars AS (", "hours AS (", 1).replace("b AS (SELECT *", f"""buckets AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS bucket, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n FROM hours GROUP BY ALL),
marked AS (SELECT *, lead(bucket) OVER (PARTITION BY symbol ORDER BY bucket) AS nx FROM buckets), bars AS (SELECT symbol, ts, open, high, low, close, volume FROM marked WHERE n = 4 OR nx IS NOT NULL),
b AS (SELECT *""", 1)) + " SELECT symbol, CAST(trade AS INTEGER) AS trade, up AS is_long, fill_ts AS entry_ts, round(price, 6) AS entry_price, out_ts AS exit_ts, round(out_price, 6) AS exit_price, round(pnl, 6) AS pnl FROM closed"
QUERIES["run_magnified"] = lambda spark, d: _money(broker.run(sources.event_bars(spark, d), crossing, "60", "240", ACCOUNT, magnifier=True, indicators=lambda b: b.select("*", w.sma(S, X.close, 10).alias("fast"), w.sma(S, X.close, 30).alias("slow"))).select("symbol", "trade", "is_long", "entry_ts", "entry_price", "exit_ts", "exit_price", "pnl"))
SQL["run_magnified"] = SQL["run_4h"]  # market orders fill at the open, however finely the bar is walked
QUERIES["strategy_state"] = lambda spark, d: broker.backtest(crossed(spark, d), crossing, ACCOUNT, what="state").select("symbol", "ts", "closed_trades", "open_trades", *[F.round(c, 6).alias(c) for c in ("equity", "net_profit", "open_profit", "gross_profit", "position_size", "max_drawdown")])
SQL["strategy_state"] = crossing_sql() + """, h AS (SELECT *, max(base + open_profit) OVER (PARTITION BY symbol ORDER BY rn) - base - open_profit AS fall FROM curve)
SELECT h.symbol, ts, CAST((SELECT count(*) FROM closed c WHERE c.symbol = h.symbol AND c.out_rn <= h.rn) AS INTEGER) AS closed_trades, CAST(abs(position) AS INTEGER) AS open_trades, round(base + open_profit, 6) AS equity, round(CAST(base - 100000 AS DOUBLE), 6) AS net_profit, round(CAST(open_profit AS DOUBLE), 6) AS open_profit,
 round(CAST(coalesce((SELECT sum(pnl) FROM closed c WHERE c.symbol = h.symbol AND c.out_rn <= h.rn AND pnl > 0), 0) AS DOUBLE), 6) AS gross_profit, round(CAST(position AS DOUBLE), 6) AS position_size, round(max(fall) OVER (PARTITION BY symbol ORDER BY rn), 6) AS max_drawdown FROM h"""
QUERIES["open_trades"] = lambda spark, d: broker.backtest(crossed(spark, d), crossing, ACCOUNT, what="open").select("symbol", "entry_id", "is_long", "entry_ts", *[F.round(c, 6).alias(c) for c in ("entry_price", "profit", "profit_pct", "commission")])
SQL["open_trades"] = crossing_sql() + """, z AS (SELECT symbol, arg_max(close, ts) AS last FROM d GROUP BY symbol), o AS (SELECT *, (last - price) * sign - price * fee / 100 AS profit FROM t JOIN z USING (symbol) WHERE out_rn IS NULL)
SELECT symbol, 'cross' AS entry_id, up AS is_long, fill_ts AS entry_ts, round(price, 6) AS entry_price, round(profit, 6) AS profit, round(profit / price * 100, 6) AS profit_pct, round(price * fee / 100, 6) AS commission FROM o"""


def holding_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades that SQL can make too: each order date's price against the next, long on even days."""
    day = sources.order_bars(spark, sf_dir)
    n = F.row_number().over(S.slots())
    rows = day.select("symbol", n.alias("trade"), "close", F.lead("close").over(S.slots()).alias("next"), (n % 2 == 0).alias("is_long"))
    pnl = F.round((F.col("next") - F.col("close")) * F.when(F.col("is_long"), 1).otherwise(-1), 2)
    return rows.where("next is not null").select("symbol", "trade", "is_long", pnl.alias("pnl"), (pnl / F.col("close") * 100).alias("pnl_pct"), F.lit(1.0).alias("commission"), F.col("trade").alias("entry_bar"), (F.col("trade") + 1).alias("exit_bar"))


STATS = ["num_trades", "num_wins", "num_losses", "num_even", "net_profit", "gross_profit", "gross_loss", "commission_paid", "avg_trade_pct", "avg_win", "avg_loss", "largest_win", "largest_loss", "percent_profitable", "profit_factor", "avg_trade", "expectancy", "max_consecutive_wins", "max_consecutive_losses"]
QUERIES["trade_stats"] = lambda spark, d: metrics.trade_stats(holding_trades(spark, d), 1e6).select("symbol", "side", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in STATS])
SQL["trade_stats"] = """WITH day AS (SELECT date_trunc('day', o_orderdate) AS ts, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY ts) AS trade, close, lead(close) OVER (ORDER BY ts) AS nx FROM day),
t AS (SELECT trade, trade % 2 = 0 AS is_long, close, round((nx - close) * CASE WHEN trade % 2 = 0 THEN 1 ELSE -1 END, 2) AS pnl FROM n WHERE nx IS NOT NULL),
s AS (SELECT *, unnest(['all', CASE WHEN is_long THEN 'long' ELSE 'short' END]) AS side, sign(pnl) AS g FROM t),
i AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY trade) - row_number() OVER (PARTITION BY side, g ORDER BY trade) AS island FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY side, g, island ORDER BY trade) AS run FROM i),
x AS (SELECT 'orders' AS symbol, side, count(*) AS num_trades, count(*) FILTER (g > 0) AS num_wins, count(*) FILTER (g < 0) AS num_losses, count(*) FILTER (g = 0) AS num_even, sum(pnl) AS net_profit,
 coalesce(sum(pnl) FILTER (g > 0), 0) AS gross_profit, coalesce(-sum(pnl) FILTER (g < 0), 0) AS gross_loss, count(*) * 1.0 AS commission_paid, avg(pnl / close * 100) AS avg_trade_pct, avg(pnl) FILTER (g > 0) AS avg_win, -avg(pnl) FILTER (g < 0) AS avg_loss,
 max(pnl) FILTER (g > 0) AS largest_win, -min(pnl) FILTER (g < 0) AS largest_loss, coalesce(max(run) FILTER (g > 0), 0) AS max_consecutive_wins, coalesce(max(run) FILTER (g < 0), 0) AS max_consecutive_losses FROM r GROUP BY side),
y AS (SELECT *, num_wins / num_trades * 100 AS percent_profitable, gross_profit / nullif(gross_loss, 0) AS profit_factor, net_profit / num_trades AS avg_trade, num_wins / num_trades * coalesce(avg_win, 0) - num_losses / num_trades * coalesce(avg_loss, 0) AS expectancy FROM x)
SELECT symbol, side, """ + ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in STATS) + " FROM y"


def order_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.order_bars(spark, sf_dir).select("symbol", "ts", (F.col("close") + 1e6).alias("equity"))


CURVE = "WITH c AS (SELECT date_trunc('day', o_orderdate) AS ts, arg_max(o_totalprice, o_orderkey) + 1e6 AS equity FROM orders GROUP BY 1)"
EQUITY = ["max_drawdown", "max_drawdown_pct", "max_run_up", "max_run_up_pct", "final_equity", "net_profit", "cagr", "recovery_factor", "calmar", "sharpe", "sortino", "sharpe_bar", "sortino_bar", "buy_hold_return", "buy_hold_return_pct"]
QUERIES["equity_stats"] = lambda spark, d: metrics.equity_stats(order_curve(spark, d), 1e6, bars=sources.order_bars(spark, d)).select("symbol", "points", *[F.round(c, 6).alias(c) for c in EQUITY])
SQL["equity_stats"] = CURVE + """, n AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn, max(equity) OVER (ORDER BY ts) AS peak FROM c), e AS (SELECT *, sum(CASE WHEN rn = 1 OR equity > before THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS era FROM (SELECT *, lag(peak) OVER (ORDER BY ts) AS before FROM n)),
t AS (SELECT *, min(equity) OVER (PARTITION BY era ORDER BY ts) AS trough FROM e),
dd AS (SELECT peak - equity AS dd, (peak - equity) / peak * 100 AS pct FROM t ORDER BY dd DESC, ts LIMIT 1), ru AS (SELECT equity - trough AS ru, (equity - trough) / trough * 100 AS pct FROM t ORDER BY ru DESC, ts LIMIT 1),
a AS (SELECT count(*) AS points, arg_max(equity, ts) AS last, (epoch(max(ts)) - epoch(min(ts))) / (365.25 * 86400) AS years FROM c),
m AS (SELECT date_trunc('month', ts) AS p, arg_max(equity, ts) AS equity FROM c GROUP BY 1), mr AS (SELECT equity / lag(equity) OVER (ORDER BY p) - 1 AS r FROM m), br AS (SELECT equity / lag(equity) OVER (ORDER BY ts) - 1 AS r FROM c),
ms AS (SELECT (avg(r) - 0.02 / 12) / stddev_samp(r) * sqrt(12) AS sharpe, (avg(r) - 0.02 / 12) / sqrt(avg(least(r - 0.02 / 12, 0) ** 2)) * sqrt(12) AS sortino FROM mr WHERE r IS NOT NULL),
bs AS (SELECT (avg(r) - 0.02 / k) / stddev_samp(r) * sqrt(any_value(k)) AS sharpe_bar, (avg(r) - 0.02 / k) / sqrt(avg(least(r - 0.02 / k, 0) ** 2)) * sqrt(any_value(k)) AS sortino_bar FROM (SELECT r, (points - 1) / years AS k FROM br, a WHERE r IS NOT NULL) GROUP BY k),
h AS (SELECT arg_max(o_totalprice, o_orderkey) AS close, arg_min(o_totalprice, o_orderkey) AS open, date_trunc('day', o_orderdate) AS ts FROM orders GROUP BY 3), bh AS (SELECT arg_max(close, ts) / arg_min(open, ts) - 1 AS held FROM h)
SELECT 'orders' AS symbol, points, round(dd, 6) AS max_drawdown, round(dd.pct, 6) AS max_drawdown_pct, round(ru, 6) AS max_run_up, round(ru.pct, 6) AS max_run_up_pct, round(last, 6) AS final_equity, round(last - 1e6, 6) AS net_profit, round(((last / 1e6) ** (1 / years) - 1) * 100, 6) AS cagr,
 round((last - 1e6) / dd, 6) AS recovery_factor, round(((last / 1e6) ** (1 / years) - 1) * 100 / dd.pct, 6) AS calmar, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(sharpe_bar, 6) AS sharpe_bar, round(sortino_bar, 6) AS sortino_bar, round(held * 1e6, 6) AS buy_hold_return, round(held * 100, 6) AS buy_hold_return_pct FROM dd, ru, a, ms, bs, bh"""
QUERIES["sharpe_ratio"] = lambda spark, d: _money(metrics.sharpe(order_curve(spark, d)))
SQL["sharpe_ratio"] = CURVE + """, m AS (SELECT date_trunc('month', ts) AS p, arg_max(equity, ts) AS equity FROM c GROUP BY 1), r AS (SELECT equity / lag(equity) OVER (ORDER BY p) - 1 - 0.02 / 12 AS r FROM m)
SELECT 'orders' AS symbol, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe, round(avg(r) / sqrt(avg(least(r, 0) ** 2)) * sqrt(12), 6) AS sortino FROM r WHERE r IS NOT NULL"""

# --- scalars --------------------------------------------------------------------------------


def matrices(b: DataFrame) -> DataFrame:
    m = F.array(F.array(X.open, X.high), F.array(X.low, X.close))
    return b.select("symbol", "ts", m.alias("m"))


framed(
    "matrix_functions",
    lambda b: matrices(b).select(
        "symbol", "ts",
        *rounded(total=scalars.matrix_sum(X.m), trace=scalars.matrix_trace(X.m), product=scalars.matrix_mult(X.m, scalars.matrix_transpose(X.m))[0][1], difference=scalars.matrix_diff(X.m, scalars.matrix_reverse(X.m))[0][0]),
        scalars.matrix_is(X.m, "symmetric").alias("symmetric"),
    ),
    "z AS (SELECT 1) SELECT symbol, ts, round(open + high + low + close, 6) AS total, round(open + close, 6) AS trace, round(open * low + high * close, 6) AS product, round(open - close, 6) AS difference, abs(high - low) < 1e-10 AS symmetric FROM bars",
)
framed(
    "matrix_structure",
    lambda b: matrices(b).select(
        "symbol", "ts",
        *rounded(
            average=scalars.matrix_avg(X.m), least=scalars.matrix_min(X.m), most=scalars.matrix_max(X.m), mode=scalars.matrix_mode(X.m),
            corner=scalars.matrix_kron(X.m, scalars.matrix_swap_rows(X.m, 0, 1))[3][2],
            squared=scalars.matrix_pow(X.m, 2)[0][1],
            swapped=scalars.matrix_swap_columns(scalars.matrix_set(X.m, 0, 0, F.lit(1.0)), 0, 1)[0][1],
            wide=scalars.matrix_sum(scalars.matrix_add_column(scalars.matrix_remove_row(scalars.matrix_add_row(X.m, 1, X.m[0]), 0), 0, X.m[1])),
            thin=scalars.matrix_sum(scalars.matrix_remove_column(X.m, 0)),
        ),
        scalars.matrix_count(scalars.matrix_fill(X.m, F.lit(0.0))).alias("cells"),
    ),
    """z AS (SELECT *, list_sort([open, high, low, close]) AS v FROM bars) SELECT symbol, ts, round((open + high + low + close) / 4, 6) AS average, round(v[1], 6) AS least, round(v[4], 6) AS most,
    round(CASE WHEN v[1] = v[2] OR NOT (v[2] = v[3] OR v[3] = v[4]) THEN (CASE WHEN v[2] = v[3] AND v[3] = v[4] THEN v[2] ELSE v[1] END) WHEN v[2] = v[3] THEN v[2] ELSE v[3] END, 6) AS mode,
    round(close * open, 6) AS corner, round(open * high + high * close, 6) AS squared, round(CAST(1 AS DOUBLE), 6) AS swapped, round(open + high + low + close + low + close, 6) AS wide, round(high + close, 6) AS thin, 4 AS cells FROM z""",
)
framed("matrix_linear", lambda b: matrices(b).select("symbol", "ts", F.round(scalars.matrix_det(X.m), 4).alias("det")), "z AS (SELECT 1) SELECT symbol, ts, round(open * close - high * low, 4) AS det FROM bars")
LEVELS_SQL = {
    "Traditional": {"p": "tp", "r1": "2 * tp - low", "s1": "2 * tp - high", "r2": "tp + wide", "s2": "tp - wide", "r3": "high + 2 * (tp - low)", "s3": "low - 2 * (high - tp)", "r4": "tp + 3 * wide", "s4": "tp - 3 * wide", "r5": "tp + 4 * wide", "s5": "tp - 4 * wide"},
    "Fibonacci": {"p": "tp", "r1": "tp + 0.382 * wide", "s1": "tp - 0.382 * wide", "r2": "tp + 0.618 * wide", "s2": "tp - 0.618 * wide", "r3": "tp + wide", "s3": "tp - wide"},
    "Woodie": {"p": "wp", "r1": "2 * wp - low", "s1": "2 * wp - high", "r2": "wp + wide", "s2": "wp - wide", "r3": "wp + 2 * wide", "s3": "wp - 2 * wide", "r4": "wp + 3 * wide", "s4": "wp - 3 * wide"},
    "Classic": {"p": "tp", "r1": "2 * tp - low", "s1": "2 * tp - high", "r2": "tp + wide", "s2": "tp - wide", "r3": "tp + 2 * wide", "s3": "tp - 2 * wide", "r4": "tp + 3 * wide", "s4": "tp - 3 * wide"},
    "DM": {"p": "x / 4", "r1": "x / 2 - low", "s1": "x / 2 - high"},
    "Camarilla": {"p": "tp", **{f"{s}{k + 1}": f"close {g} wide * 1.1 / {n}" for k, n in enumerate((12, 6, 4, 2)) for s, g in (("r", "+"), ("s", "-"))}, "r5": "high / low * close", "s5": "close - (high / low * close - close)"},
    "Other": {"p": "tp"},
}
for _method, _levels in LEVELS_SQL.items():
    framed(
        f"pivot_levels_{_method.lower()}",
        lambda b, method=_method: b.select("symbol", "ts", scalars.pivot_levels(method, S.lag(X.high), S.lag(X.low), S.lag(X.close)).alias("_p")).select("symbol", "ts", *[F.round(f"_p.{n}", 6).alias(n) for n in scalars.LEVELS]),
        f"q AS (SELECT symbol, ts, lag(high) OVER {LAG} AS high, lag(low) OVER {LAG} AS low, lag(close) OVER {LAG} AS close FROM bars), e AS (SELECT *, (high + low + close) / 3 AS tp, (high + low + 2 * close) / 4 AS wp, high - low AS wide, CASE WHEN close = high THEN high + 2 * low + close WHEN close = low THEN 2 * high + low + close ELSE high + low + 2 * close END AS x FROM q) SELECT symbol, ts, "
        + ", ".join(f"round(CAST({_levels.get(n, 'NULL')} AS DOUBLE), 6) AS {n}" for n in scalars.LEVELS) + " FROM e",
    )
framed("text_functions", lambda b: b.select("symbol", "ts", scalars.text_format("{0}: {1}", F.col("symbol"), X.volume.cast("int")).alias("formatted"), scalars.text_match(F.col("symbol"), "^(.)").alias("first"), F.size(scalars.text_split(F.col("symbol"), "i")).cast("int").alias("parts")), "z AS (SELECT 1) SELECT symbol, ts, symbol || ': ' || CAST(CAST(volume AS INTEGER) AS VARCHAR) AS formatted, symbol[1] AS first, CAST(len(string_split(symbol, 'i')) AS INTEGER) AS parts FROM bars")
framed("map_functions", lambda b: b.select("symbol", "ts", scalars.map_put(F.create_map(F.lit("a"), X.close), F.lit("b"), X.open).alias("m")).select("symbol", "ts", F.size("m").cast("int").alias("n"), F.try_element_at("m", F.lit("b")).alias("value"), F.size(scalars.map_remove(F.col("m"), F.lit("a"))).cast("int").alias("left")), "z AS (SELECT 1) SELECT symbol, ts, 2 AS n, open AS value, 1 AS \"left\" FROM bars")
framed("fill_prices", lambda b: b.select("symbol", "ts", *rounded(buy=scalars.to_tick_against(X.close, 0.05, True), sell=scalars.to_tick_against(X.close, 0.05, False), lot=scalars.to_lot(X.volume, 2.0), fee=scalars.commission("percent", 0.1, X.close, X.volume))), "z AS (SELECT 1) SELECT symbol, ts, round(ceil(close / 0.05 - 1e-9) * 0.05, 6) AS buy, round(floor(close / 0.05 + 1e-9) * 0.05, 6) AS sell, floor(volume / 2 + 1e-9) * 2 AS lot, round(close * volume * 0.1 / 100, 6) AS fee FROM bars")
