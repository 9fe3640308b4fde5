"""More registered queries: missing values, scalar families, relational operations; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe import sources
from tickframe.functions import lists, numbers, scalars, text
from tickframe.operators import arrays as a
from tickframe.operators import recurrences as r
from tickframe.operators import windows as w
from tickframe.plans import metrics, periods, timeframes
from tickframe.plans.queries import BARS_SQL, LAG, QUERIES, SQL, X, crossed, crossed_trades, crossing_sql, framed, over, rounded

__all__ = ["QUERIES", "SQL"]

# --- missing values: every seventh close is gone ---------------------------------------------

G = w.Series()
HOLES = "q AS (SELECT *, CASE WHEN rn % 7 = 0 THEN NULL ELSE close END AS c FROM d), p AS (SELECT symbol, ts, c, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM q WHERE c IS NOT NULL)"


def holed(b: DataFrame) -> DataFrame:
    return b.withColumn("c", F.when(F.row_number().over(G.slots()) % 7 != 0, F.col("close")))


def missing(name: str, value: Callable[[], Column], sql: str) -> None:
    framed(name, lambda b: holed(b).select("symbol", "ts", F.round(value().cast("double"), 6).alias("value")), f"{HOLES}, {sql}")


def skipping(name: str, value: Callable[[], Column], n: int, sql: str, holds: bool = False) -> None:
    """Windows over present values; a missing one has none, or holds the value before."""
    shown = "last_value(v.value IGNORE NULLS) OVER (PARTITION BY q.symbol ORDER BY q.ts)" if holds else "v.value"
    missing(name, value, f"v AS (SELECT symbol, ts, CASE WHEN k >= {n} THEN {sql} END AS value FROM p) SELECT q.symbol, q.ts, round({shown}, 6) AS value FROM q LEFT JOIN v USING (symbol, ts)")


skipping("ta_sma_missing", lambda: w.sma(G, X.c, 14), 14, f"avg(c) {over(14)}", True)
skipping("ta_sum_missing", lambda: w.rolling_sum(G, X.c, 10), 10, f"sum(c) {over(10)}", True)
skipping("ta_vwma_missing", lambda: w.vwma(G, X.c, X.volume, 10), 10, f"sum(c * volume) {over(10)} / sum(volume) {over(10)}")
skipping("ta_mom_missing", lambda: w.momentum(G, X.c, 10), 1, f"c - lag(c, 10) OVER {LAG}")
skipping("ta_roc_missing", lambda: w.roc(G, X.c, 9), 1, f"100 * (c - lag(c, 9) OVER {LAG}) / lag(c, 9) OVER {LAG}")
skipping("ta_stdev_missing", lambda: w.stdev(G, X.c, 20), 20, f"stddev_pop(c) {over(20)}")
skipping("ta_median_missing", lambda: w.median(G, X.c, 9), 9, f"quantile_cont(c, 0.5) {over(9)}")
skipping("ta_wma_missing", lambda: a.wma(G, X.c, 5), 5, f"list_sum(list_transform(list(c) {over(5)}, lambda x, i: x * i)) / 15.0")
missing("ta_change_missing", lambda: w.change(G, X.c, 3), f"z AS (SELECT 1) SELECT symbol, ts, round(c - lag(c, 3) OVER {LAG}, 6) AS value FROM q")
missing("ta_highest_missing", lambda: w.highest(G, X.c, 10), f"z AS (SELECT 1) SELECT symbol, ts, round(CASE WHEN rn >= 10 THEN max(c) {over(10)} END, 6) AS value FROM q")
missing("ta_cum_missing", lambda: w.cumulative(G, X.c), f"z AS (SELECT 1) SELECT symbol, ts, round(coalesce(sum(c) {over()}, 0), 6) AS value FROM q")
missing(
    "ta_pivothigh_missing",
    lambda: w.pivot_high(G, X.c, 2, 2),
    f"e AS (SELECT *, lag(c, 2) OVER {LAG} AS m, count(c) {over(5)} AS n, max(c) {over(2, 3)} AS l, max(c) {over(2)} AS h FROM q) SELECT symbol, ts, round(CASE WHEN n = 5 AND m >= l AND m > h THEN m END, 6) AS value FROM e",
)
missing(
    "ta_percentrank_missing",
    lambda: a.percent_rank(G, X.c, 10),
    f"e AS (SELECT symbol, ts, rn, c, list(c) FILTER (c IS NOT NULL) {over(10, 1)} AS xs FROM q) SELECT symbol, ts, round(CASE WHEN rn >= 11 AND c IS NOT NULL AND len(xs) > 0 THEN 100.0 * len(list_filter(xs, lambda x: x <= c + 1e-10)) / 10 END, 6) AS value FROM e",
)
missing(
    "ta_linreg_missing",
    lambda: a.linreg(G, X.c, 5),
    f"e AS (SELECT symbol, ts, rn, count(c) {over(5)} AS n, list(c) {over(5)} AS xs FROM q) SELECT symbol, ts, round(CASE WHEN rn >= 5 AND n = 5 THEN list_avg(xs) + list_sum(list_transform(xs, lambda x, i: x * (i - 3))) / 10.0 * 2 END, 6) AS value FROM e",
)
framed(
    "ta_crossover_missing",
    lambda b: holed(b).select("symbol", "ts", w.crossover(G, X.c, X.open).alias("flag")),
    f"{HOLES}, e AS (SELECT symbol, ts, c, open, lag(c) OVER {LAG} AS pc, lag(open) OVER {LAG} AS po FROM q) SELECT symbol, ts, coalesce(c > open AND (pc <= po OR (pc IS NULL AND po IS NOT NULL)), false) AS flag FROM e",
)
_REC = "g AS (SELECT symbol, ts, k AS rn, c, c - lag(c) OVER (PARTITION BY symbol ORDER BY ts) AS dc FROM p), rec AS (SELECT symbol, ts, rn, {start} FROM g WHERE rn = 1 UNION ALL SELECT b.symbol, b.ts, b.rn, {step} FROM rec r JOIN g b ON b.symbol = r.symbol AND b.rn = r.rn + 1) SELECT q.symbol, q.ts, round({value}, 6) AS value FROM q LEFT JOIN rec USING (symbol, ts)"
framed("ta_ema_missing", lambda b: r.recur(holed(b), [r.ema("c", 10, "value")]).select("symbol", "ts", *rounded(value=X.value)), f"{HOLES}, " + _REC.format(start="c AS v", step=f"{2 / 11!r} * b.c + {9 / 11!r} * r.v", value="v"))
_RMA = "CASE WHEN b.rn < 15 THEN NULL WHEN b.rn = 15 THEN (r.{s} + {x}) / 14 ELSE ({x} + 13 * r.{m}) / 14 END"
_UP, _DOWN = "greatest(b.dc, 0)", "greatest(-b.dc, 0)"
framed(
    "ta_rsi_missing",
    lambda b: r.recur(holed(b), [r.rsi("c", 14, "value")]).select("symbol", "ts", *rounded(value=X.value)),
    f"{HOLES}, " + _REC.format(start="0.0::DOUBLE AS us, CAST(NULL AS DOUBLE) AS u, 0.0::DOUBLE AS ds, CAST(NULL AS DOUBLE) AS dn", step=f"r.us + {_UP}, {_RMA.format(s='us', x=_UP, m='u')}, r.ds + {_DOWN}, {_RMA.format(s='ds', x=_DOWN, m='dn')}", value="CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + u / dn) END"),
)

# --- scalar families -------------------------------------------------------------------------

framed(
    "math_functions",
    lambda b: b.select(
        "symbol", "ts",
        *rounded(
            log=numbers.log(X.close), log10=numbers.log10(X.close), no_log=numbers.log(X.open - X.open), root=numbers.sqrt(X.close), power=numbers.power(X.volume, 1.5), away=numbers.rounded(X.close, 1), negative=numbers.rounded(-X.close),
            quotient=numbers.divide(X.close, X.volume), none=numbers.divide(X.close, X.volume - X.volume), rest=numbers.remainder(-X.close, X.volume), most=numbers.greatest(X.open, X.close), gap=numbers.least(X.open, F.lit(None).cast("double")),
            mean=numbers.average(X.open, X.high, X.low), sine=numbers.PLAIN["sin"](X.volume), degrees=numbers.PLAIN["todegrees"](X.volume), whole=numbers.PLAIN["ceil"](X.close).cast("double"), sign=numbers.PLAIN["sign"](X.close - X.open),
        ),
        numbers.to_int(X.close).alias("cut"), numbers.to_bool(X.close - X.open).alias("moved"),
    ),
    """z AS (SELECT 1) SELECT symbol, ts, round(ln(close), 6) AS log, round(log10(close), 6) AS log10, CAST(NULL AS DOUBLE) AS no_log, round(sqrt(close), 6) AS root, round(volume ** 1.5, 6) AS power, round(round(close, 1), 6) AS away, round(round(-close), 6) AS negative,
    round(close / volume, 6) AS quotient, CAST(NULL AS DOUBLE) AS none, round((-close) % volume, 6) AS rest, round(greatest(open, close), 6) AS most, CAST(NULL AS DOUBLE) AS gap, round((open + high + low) / 3, 6) AS mean, round(sin(volume), 6) AS sine, round(degrees(volume), 6) AS degrees,
    round(CAST(ceil(close) AS DOUBLE), 6) AS whole, round(CAST(sign(close - open) AS DOUBLE), 6) AS sign, CAST(trunc(close) AS INTEGER) AS cut, close <> open AS moved FROM bars""",
)
framed(
    "number_texts",
    lambda b: b.select("symbol", "ts", scalars.number_text(X.close, "mintick", 0.05).alias("tick"), scalars.number_text(X.close / 1000, "percent").alias("percent"), scalars.number_text((X.close - X.open) * 1e5, "volume").alias("volume"), scalars.number_text(X.close).alias("plain"), scalars.number_text(w.Series().lag(X.close)).alias("before")),
    f"""e AS (SELECT *, abs((close - open) * 1e5) AS v, CASE WHEN close < open THEN '-' ELSE '' END AS s FROM d) SELECT symbol, ts, printf('%.2f', round(close / 0.05) * 0.05) AS tick, printf('%.2f', close / 1000 * 100) || '%' AS percent,
    s || CASE WHEN v >= 1e9 THEN printf('%.2f', v / 1e9) || 'B' WHEN v >= 1e6 THEN printf('%.2f', v / 1e6) || 'M' WHEN v >= 1e3 THEN printf('%.2f', v / 1e3) || 'K' ELSE printf('%.2f', v) END AS volume, printf('%.6f', close) AS plain, CASE WHEN pc IS NULL THEN 'NaN' ELSE printf('%.6f', pc) END AS before FROM e""",
)
framed(
    "string_functions",
    lambda b: b.select(
        "symbol", "ts",
        text.contains("symbol", F.lit("i")).alias("has"), text.startswith("symbol", F.lit("s")).alias("begins"), text.endswith("symbol", F.lit("p")).alias("ends"), text.length("symbol").alias("size"), text.upper("symbol").alias("up"),
        text.position(X.symbol, "i").cast("int").alias("at"), text.repeat(X.symbol, 2, "-").alias("twice"), text.replace(X.symbol, "i", "_", 1).alias("second"), text.replace_all(X.symbol, "i", "_").alias("every"),
        text.substring(X.symbol, 1, 3).alias("part"), text.trim(F.concat(F.lit(" \t"), X.symbol, F.lit("\n "))).alias("bare"), text.to_number(F.lit(" 12.5 ")).alias("number"), text.to_number(X.symbol).alias("none"),
        scalars.text_match(X.symbol, "s.g").alias("found"), scalars.text_format("{1}/{0}/{1}", X.symbol, F.lit("x")).alias("filled"),
    ),
    """z AS (SELECT 1) SELECT symbol, ts, contains(symbol, 'i') AS has, starts_with(symbol, 's') AS begins, suffix(symbol, 'p') AS ends, CAST(length(symbol) AS INTEGER) AS size, upper(symbol) AS up, CAST(nullif(instr(symbol, 'i'), 0) - 1 AS INTEGER) AS at,
    symbol || '-' || symbol AS twice, CASE WHEN len(string_split(symbol, 'i')) > 2 THEN string_split(symbol, 'i')[1] || 'i' || string_split(symbol, 'i')[2] || '_' || array_to_string(string_split(symbol, 'i')[3:], 'i') ELSE symbol END AS second,
    replace(symbol, 'i', '_') AS every, substring(symbol, 2, 2) AS part, symbol AS bare, CAST(12.5 AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS none, regexp_extract(symbol, 's.g') AS found, 'x/' || symbol || '/x' AS filled FROM bars""",
)


def quads(b: DataFrame) -> DataFrame:
    return b.select("symbol", "ts", F.array(X.open, X.high, X.low, X.close).alias("xs"))


framed(
    "array_functions",
    lambda b: quads(b).select(
        "symbol", "ts",
        *rounded(
            total=lists.total(X.xs), mean=lists.average(X.xs), least=lists.least(X.xs), third=lists.least(X.xs, 2), most=lists.greatest(X.xs), wide=lists.value_range(X.xs), spread=lists.deviation(X.xs), sample=lists.variance(X.xs, False), median=lists.median(X.xs),
            near=lists.percentile_nearest(X.xs, 60.0), between=lists.percentile_linear(X.xs, 30.0), shared=lists.covariance(X.xs, lists.reverse(X.xs)), last=lists.get(X.xs, -1), put=lists.get(lists.set_at(X.xs, 1, F.lit(7.0)), 1), pushed=lists.last(lists.push(X.xs, F.lit(9.0))),
            begun=lists.first(lists.unshift(X.xs, F.lit(8.0))), popped=lists.last(lists.pop(X.xs)), shifted=lists.first(lists.shift(X.xs)), inserted=lists.get(lists.insert(X.xs, 2, F.lit(5.0)), 2), filled=lists.total(lists.fill(X.xs, F.lit(1.0), 1, 3)), commonest=lists.mode(X.xs),
        ),
        lists.size(lists.remove(X.xs, 0)).alias("fewer"), lists.size(lists.part(X.xs, 1, 3)).alias("sliced"), lists.index_of(X.xs, X.xs[3]).alias("where_close"), lists.last_index_of(X.xs, X.xs[0]).alias("last_open"), lists.includes(X.xs, F.lit(-1.0)).alias("negative"),
        lists.get(lists.sort_indices(X.xs), 0).alias("lowest_at"), lists.binary_search_leftmost(lists.sort(X.xs), F.lit(0.0)).alias("below"), lists.size(lists.concat(X.xs, lists.clear(X.xs))).alias("joined"), lists.every(F.transform("xs", lambda x: x > 0)).alias("positive"),
    ),
    """e AS (SELECT symbol, ts, open, high, low, close, [open, high, low, close] AS xs, list_sort([open, high, low, close]) AS v, (open + high + low + close) / 4 AS m FROM bars)
    SELECT symbol, ts, round(4 * m, 6) AS total, round(m, 6) AS mean, round(v[1], 6) AS least, round(v[3], 6) AS third, round(v[4], 6) AS most, round(high - low, 6) AS wide, round(sqrt(((open - m) ** 2 + (high - m) ** 2 + (low - m) ** 2 + (close - m) ** 2) / 4), 6) AS spread,
    round(((open - m) ** 2 + (high - m) ** 2 + (low - m) ** 2 + (close - m) ** 2) / 3, 6) AS sample, round((v[2] + v[3]) / 2, 6) AS median, round(v[3], 6) AS near, round(v[1] + (v[2] - v[1]) * 0.9, 6) AS between, round(((open - m) * (close - m) + (high - m) * (low - m)) / 2, 6) AS shared,
    round(close, 6) AS last, round(CAST(7 AS DOUBLE), 6) AS put, round(CAST(9 AS DOUBLE), 6) AS pushed, round(CAST(8 AS DOUBLE), 6) AS begun, round(low, 6) AS popped, round(high, 6) AS shifted, round(CAST(5 AS DOUBLE), 6) AS inserted, round(open + close + 2, 6) AS filled,
    round(CASE WHEN v[1] = v[2] OR NOT (v[2] = v[3] OR v[3] = v[4]) THEN (CASE WHEN v[2] = v[3] AND v[3] = v[4] THEN v[2] ELSE v[1] END) WHEN v[2] = v[3] THEN v[2] ELSE v[3] END, 6) AS commonest,
    3 AS fewer, 2 AS sliced, CAST(list_position(xs, close) - 1 AS INTEGER) AS where_close, CAST(4 - list_position(list_reverse(xs), open) AS INTEGER) AS last_open, false AS negative, CAST(list_position(xs, v[1]) - 1 AS INTEGER) AS lowest_at, -1 AS below, 4 AS joined, true AS positive FROM e""",
)
framed(
    "map_operations",
    lambda b: b.select("symbol", "ts", scalars.map_put(scalars.map_put(F.create_map(F.lit("a"), X.open), F.lit("b"), X.high), F.lit("a"), X.low).alias("m")).select(
        "symbol", "ts",
        F.array_join(scalars.map_keys(F.col("m")), ",").alias("keys"), F.round(scalars.map_values(F.col("m"))[0], 6).alias("first"), scalars.map_contains(F.col("m"), F.lit("c")).alias("has"), F.round(scalars.map_get(F.col("m"), F.lit("b")), 6).alias("b"),
        scalars.map_get(F.col("m"), F.lit("zz")).alias("none"), F.size(scalars.map_clear(F.col("m"))).alias("cleared"), F.array_join(scalars.map_keys(scalars.map_put_all(F.col("m"), F.create_map(F.lit("c"), F.lit(1.0), F.lit("b"), F.lit(2.0)))), ",").alias("all_keys"),
        scalars.map_get(scalars.map_put_all(F.col("m"), F.create_map(F.lit("c"), F.lit(1.0), F.lit("b"), F.lit(2.0))), F.lit("b")).alias("put"),
    ),
    "z AS (SELECT 1) SELECT symbol, ts, 'a,b' AS keys, round(low, 6) AS first, false AS has, round(high, 6) AS b, CAST(NULL AS DOUBLE) AS none, 0 AS cleared, 'a,b,c' AS all_keys, CAST(2 AS DOUBLE) AS put FROM bars",
)
framed(
    "matrix_inverse",
    lambda b: b.select("symbol", "ts", F.array(F.array(X.close + 1, F.lit(1.0)), F.array(F.lit(1.0), X.volume + 1)).alias("m")).select(
        "symbol", "ts",
        F.round(scalars.matrix_inv(X.m)[0][1], 8).alias("inverse"), F.round(scalars.matrix_pinv(X.m)[0][1], 8).alias("pseudo"), scalars.matrix_rank(X.m).alias("rank"), F.round(scalars.matrix_eigenvalues(X.m)[0], 6).alias("eigen"),
        scalars.matrix_rows(X.m).alias("rows"), scalars.matrix_columns(X.m).alias("columns"), F.round(scalars.matrix_sum(scalars.matrix_submatrix(X.m, 0, 1, 0, 2)), 6).alias("top"), F.round(scalars.matrix_reshape(X.m, 1, 4)[0][3], 6).alias("corner"),
        F.round(scalars.matrix_sort(X.m, 0)[0][0], 6).alias("sorted"), F.size(scalars.matrix_concat(X.m, X.m, True)[0]).alias("wide"), *[scalars.matrix_is(X.m, k).alias(k) for k in ("square", "diagonal", "zero", "binary", "triangular", "identity", "antisymmetric")],
    ),
    """e AS (SELECT symbol, ts, close + 1 AS a, volume + 1 AS b FROM bars) SELECT symbol, ts, round(-1 / (a * b - 1), 8) AS inverse, round(-1 / (a * b - 1), 8) AS pseudo, 2 AS rank, round((a + b + sqrt((a - b) ** 2 + 4)) / 2, 6) AS eigen, 2 AS rows, 2 AS columns, round(a + 1, 6) AS top,
    round(b, 6) AS corner, round(least(a, 1), 6) AS sorted, 4 AS wide, true AS square, false AS diagonal, false AS zero, false AS binary, false AS triangular, false AS identity, false AS antisymmetric FROM e""",
)
framed(
    "colors",
    lambda b: b.select("symbol", "ts", (F.lit(0xFF000000) + X.volume.cast("long") * 65536 + 515).alias("c")).select("symbol", "ts", scalars.channel(F.col("c"), "r").cast("int").alias("r"), scalars.channel(F.col("c"), "g").cast("int").alias("g"), scalars.channel(F.col("c"), "b").cast("int").alias("b"), F.round(scalars.channel(scalars.with_transparency(F.col("c"), 50.0), "t"), 4).alias("t")),
    "z AS (SELECT 1) SELECT symbol, ts, CAST(volume AS INTEGER) % 256 AS r, 2 AS g, 3 AS b, round(100 * (1 - 128 / 255.0), 4) AS t FROM bars",
)
framed(
    "bar_state",
    lambda b: b.select("symbol", "ts", (F.row_number().over(G.slots()) - 1).alias("bar_index"), (F.count("*").over(Window.partitionBy("symbol")) - 1).cast("int").alias("last_bar_index"), F.max("ts").over(Window.partitionBy("symbol")).alias("last_bar_time"), (F.row_number().over(G.slots()) == 1).alias("is_first"), F.lead("ts").over(G.slots()).isNull().alias("is_last"), F.round(numbers.fixnan(F.when(X.close > X.open, X.close), G.running()), 6).alias("fixed")),
    f"z AS (SELECT 1) SELECT symbol, ts, CAST(rn - 1 AS INTEGER) AS bar_index, CAST(count(*) OVER (PARTITION BY symbol) - 1 AS INTEGER) AS last_bar_index, max(ts) OVER (PARTITION BY symbol) AS last_bar_time, rn = 1 AS is_first, lead(ts) OVER {LAG} IS NULL AS is_last, round(last_value(CASE WHEN close > open THEN close END IGNORE NULLS) {over()}, 6) AS fixed FROM d",
)
framed("random_numbers", lambda b: b.select("symbol", "ts", numbers.random(0.0, 10.0, 7, 3, F.row_number().over(G.slots()) - 1).alias("value")).groupBy("symbol").agg(F.min(F.col("value").between(0, 10)).alias("within"), (F.countDistinct("value") == F.count("*")).alias("distinct")), "z AS (SELECT 1) SELECT symbol, true AS within, true AS \"distinct\" FROM bars GROUP BY symbol")


def timeframe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What timeframe strings say, one row each."""
    known = ["1", "15", "60", "240", "30S", "D", "W", "M", "3M"]
    return spark.createDataFrame([(t, periods.tf_seconds(t), periods.unit(t), periods.multiplier(t), periods.is_intraday(t), periods.is_dwm(t), periods.tf_ratio("15", t)) for t in known], "tf string, seconds int, unit string, multiplier int, intraday boolean, dwm boolean, ratio int")


QUERIES["timeframe_predicates"] = timeframe_table
SQL["timeframe_predicates"] = """SELECT * FROM (VALUES ('1', 60, 'minutes', 1, true, false, -2), ('15', 900, 'minutes', 15, true, false, 1), ('60', 3600, 'minutes', 60, true, false, 4), ('240', 14400, 'minutes', 240, true, false, 16), ('30S', 30, 'seconds', 30, true, false, -2),
('D', 86400, 'day', 1, false, true, 96), ('W', 604800, 'week', 1, false, true, 672), ('M', -1, 'month', 1, false, true, -1), ('3M', -1, 'month', 3, false, true, -1)) AS t(tf, seconds, unit, multiplier, intraday, dwm, ratio)"""

# --- currency --------------------------------------------------------------------------------


def converted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices at the rate of the month before."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_totalprice")
    closes = orders.groupBy(F.last_day("ts").alias("day")).agg((F.avg("o_totalprice") / 1e5).alias("rate"))
    return timeframes.converted(orders, sources.fx_daily(closes), ("o_totalprice",)).select("o_orderkey", "ts", F.round("o_totalprice", 4).alias("value"))


QUERIES["fx_converted"] = converted_orders
SQL["fx_converted"] = """WITH r AS (SELECT last_day(o_orderdate) + INTERVAL '1 day' AS at, avg(o_totalprice) / 1e5 AS rate FROM orders GROUP BY 1)
SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS ts, round(o_totalprice * coalesce(rate, 1.0), 4) AS value FROM orders ASOF LEFT JOIN r ON o_orderdate >= r.at"""

# --- relational operations: joins, grouping sets, ranks, sets, JSON ---------------------------


def relational(name: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    SQL[name] = sql


relational(
    "join_kinds",
    lambda t: t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")),
    "SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY r_name",
)
relational(
    "semi_join",
    lambda t: t("part").join(t("lineitem").where("l_quantity >= 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy("p_brand").agg(F.count("*").alias("n")),
    "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) GROUP BY p_brand",
)
relational(
    "grouping_cube",
    lambda t: t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n")),
    "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS level, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
relational(
    "grouping_rollup",
    lambda t: t("orders").rollup(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total")),
    "SELECT CAST(year AS INTEGER) AS year, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM (SELECT year(o_orderdate) AS year, * FROM orders) GROUP BY ROLLUP (year, o_orderstatus)",
)
relational(
    "ranking",
    lambda t: t("orders").select("o_orderkey", *[f().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias(n) for n, f in (("place", F.row_number), ("rank", F.rank), ("dense", F.dense_rank))], F.round(F.percent_rank().over(Window.partitionBy("o_orderstatus").orderBy("o_totalprice")), 8).alias("share"), F.ntile(4).over(Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")).alias("quarter")),
    "SELECT o_orderkey, CAST(row_number() OVER a AS INTEGER) AS place, CAST(rank() OVER a AS INTEGER) AS rank, CAST(dense_rank() OVER a AS INTEGER) AS dense, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 8) AS share, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS quarter FROM orders WINDOW a AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)",
)
relational(
    "top_orders",
    lambda t: t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
relational(
    "set_operations",
    lambda t: t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct().intersect(t("supplier").select("s_nationkey")).exceptAll(t("nation").where("n_regionkey = 0").select("n_nationkey")),
    "((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) INTERSECT SELECT s_nationkey FROM supplier) EXCEPT ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
)
relational(
    "distinct_counts",
    lambda t: t("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), (F.abs(F.approx_count_distinct("l_partkey", 0.02) / F.countDistinct("l_partkey") - 1) < 0.1).alias("near"), F.round(F.percentile("l_extendedprice", 0.9), 2).alias("p90")),
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near, round(quantile_cont(l_extendedprice, 0.9), 2) AS p90 FROM lineitem GROUP BY l_returnflag",
)
relational(
    "json_fields",
    lambda t: t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct("user_id", "event_type")).alias("json")),
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS json FROM events",
)


def followers(rows: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    """(key, n): how many rows of other keys begin within ``days`` from each row of the key, where there are any; no pair is made.

    Rows are counted by instant. A range that begins in one stretch of its own length ends in the
    next, so what lies in it is the rest of the one and the beginning of the other.
    """
    wide = days * 86_400_000_000
    rows = rows.select(F.col(key), F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))").alias("_at")).dropna()
    ends = F.array(F.struct(F.lit(0).alias("k"), X._at.alias("at"), X._c.alias("c")), F.struct(F.lit(1).alias("k"), (X._at + wide).alias("at"), F.lit(0).cast("long").alias("c")))
    found = rows.groupBy("_at").agg(F.count("*").alias("_c")).select("_at", F.explode(ends).alias("_e")).select("_at", "_e.*").withColumn("_stretch", X.at - F.pmod("at", F.lit(wide)))
    stretch = Window.partitionBy("_stretch")
    before = F.coalesce(F.sum("c").over(stretch.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = found.select("_at", F.when(X.k == 0, F.sum("c").over(stretch) - before).otherwise(before).alias("n")).groupBy("_at").agg(F.sum("n").alias("_n"))
    own = F.count("*").over(Window.partitionBy(key).orderBy("_at").rangeBetween(0, wide - 1))
    return rows.withColumn("_own", own).join(within, "_at").groupBy(key).agg(F.sum(X._n - X._own).alias("n")).where("n > 0")


relational(
    "range_join",
    lambda t: followers(t("orders").where("o_totalprice > 480000"), "o_orderkey", "o_orderdate", 10),
    "SELECT a.o_orderkey, count(*) AS n FROM orders a JOIN orders b ON b.o_orderdate >= a.o_orderdate AND b.o_orderdate < a.o_orderdate + INTERVAL '10 days' AND a.o_orderkey <> b.o_orderkey WHERE a.o_totalprice > 480000 AND b.o_totalprice > 480000 GROUP BY a.o_orderkey",
)

# --- comparing two runs ----------------------------------------------------------------------


def moved_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades aligned with the same trades twenty minutes and half a point off."""
    trades = crossed_trades(spark, sf_dir)
    other = trades.withColumns({"entry_ts": F.col("entry_ts") + F.expr("interval 20 minutes"), "entry_price": F.col("entry_price") + 0.5})
    return metrics.aligned(trades, other)


QUERIES["trades_aligned"] = moved_trades
SQL["trades_aligned"] = crossing_sql() + " SELECT symbol, CAST(trade AS INTEGER) AS trade, CAST(trade AS INTEGER) AS other FROM closed"


def split_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades cut into three parts and put together again."""
    trades = crossed_trades(spark, sf_dir)
    parts = trades.withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    parts = parts.withColumns({c: F.col(c) * F.col("_k") / 6 for c in ("qty", "pnl", "commission", "max_run_up", "max_drawdown")}).drop("_k")
    return metrics.consolidated(parts).select("symbol", "trade", "is_long", "parts", *[F.round(c, 5).alias(c) for c in ("exit_price", "qty", "pnl")])


QUERIES["trades_consolidated"] = split_trades
SQL["trades_consolidated"] = crossing_sql() + " SELECT symbol, CAST(trade AS INTEGER) AS trade, up AS is_long, 3 AS parts, round(out_price, 5) AS exit_price, 1.0 AS qty, round(pnl, 5) AS pnl FROM closed"
QUERIES["indicator_diff"] = lambda spark, d: metrics.compared(crossed(spark, d), crossed(spark, d).withColumn("fast", F.when(F.col("volume") % 2 == 0, F.col("fast") * 1.01)), "fast").select("bars", "both", "left_only", "right_only", "neither", *[F.round(c, 6).alias(c) for c in ("max_abs", "p50_rel", "p99_rel", "max_rel")])
SQL["indicator_diff"] = f"""WITH {BARS_SQL}, e AS (SELECT volume, CASE WHEN rn >= 10 THEN avg(close) {over(10)} END AS a FROM d), f AS (SELECT a, CASE WHEN CAST(volume AS INTEGER) % 2 = 0 THEN a * 1.01 END AS b FROM e), g AS (SELECT *, abs(a - b) / greatest(abs(a), abs(b), 1e-9) AS r FROM f)
SELECT count(*) AS bars, count(b) AS "both", count(a) - count(b) AS left_only, 0 AS right_only, count(*) - count(a) AS neither, round(coalesce(max(abs(a - b)), 0), 6) AS max_abs, round(coalesce(quantile_cont(r, 0.5), 0), 6) AS p50_rel, round(coalesce(quantile_cont(r, 0.99), 0), 6) AS p99_rel, round(coalesce(max(r), 0), 6) AS max_rel FROM g"""
QUERIES["trade_percentiles"] = lambda spark, d: metrics.trade_percentiles(crossed_trades(spark, d), "pnl").select("symbol", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])
SQL["trade_percentiles"] = crossing_sql() + " SELECT symbol, round(quantile_cont(pnl, 0.5), 6) AS p50, round(quantile_cont(pnl, 0.9), 6) AS p90, round(quantile_cont(pnl, 0.99), 6) AS p99 FROM closed GROUP BY symbol"
