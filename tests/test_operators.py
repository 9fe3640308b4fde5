import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe import broker, sources
from tickframe.functions import scalars, sessions
from tickframe.operators import arrays as a
from tickframe.operators import recurrences as r
from tickframe.operators import windows as w
from tickframe.plans import metrics, reports, timeframes
from tickframe.streaming import ticks as live

T0 = dt.datetime(2024, 1, 1)


def bars(spark, rows, minutes=60, symbol="x"):
    """Bars of (open, high, low, close) or of a close alone."""
    full = [(c, c, c, c) if not isinstance(c, tuple) else c for c in rows]
    return spark.createDataFrame([(symbol, T0 + dt.timedelta(minutes=minutes * i), *x, 10.0) for i, x in enumerate(full)], sources.BAR)


def column(df, value):
    return [x[0] for x in df.withColumn("_v", value).orderBy("ts").select("_v").collect()]


def test_missing_values(spark):
    s, x = w.Series(), F.col("close")
    df = sources.clean(bars(spark, [1.0, 2.0, float("nan"), 3.0, 5.0]))
    assert column(df, w.sma(s, x, 3)) == [None, None, None, 2.0, 10 / 3]
    assert column(df, w.sma(s, x, 2)) == [None, 1.5, 1.5, 2.5, 4.0]  # holds
    assert column(df, w.momentum(s, x, 1)) == [None, 1.0, None, 1.0, 2.0]  # skips
    assert column(df, w.highest(s, x, 2)) == [None, 2.0, 2.0, 3.0, 5.0]  # a slot
    assert column(df, a.linreg(s, x, 2)) == [None, 2.0, None, None, 5.0]  # a slot that spoils the frame
    assert column(df, w.crossover(s, x, F.lit(2.5))) == [False, False, False, True, False]
    got = [z.v for z in r.recur(df, [r.ema("close", 1, "v")]).orderBy("ts").collect()]
    assert got == [1.0, 2.0, None, 3.0, 5.0]


def test_events(spark):
    s, x = w.Series(dense=True), F.col("close")
    df = bars(spark, [1.0, 3.0, 2.0, 2.0, 5.0, 4.0, 6.0])
    up = x > F.lag("close").over(s.slots())
    assert column(df, w.bars_since(s, up)) == [None, 0, 1, 2, 0, 1, 0]
    latest = [[z.v for z in w.value_when(df, s, up, x, k, "v").orderBy("ts").collect()] for k in (0, 1)]
    assert latest == [[None, 3.0, 3.0, 3.0, 5.0, 5.0, 6.0], [None, None, None, None, 3.0, 3.0, 5.0]]
    assert column(df, w.rising(s, x, 2))[4] == 1.0 and column(df, w.falling(s, x, 1))[5] == 1.0
    assert column(df, w.mode(s, x, 3))[3] == 2.0 and column(df, a.highest_bars(s, x, 3))[3] == -2


def test_recurrences(spark):
    rng = np.random.default_rng(1)
    close = 100 + np.cumsum(rng.normal(size=300))
    df = bars(spark, [(float(c), float(c + 1), float(c - 1), float(c)) for c in close])
    specs = [r.rsi("close", 14, "rsi"), r.dmi(14, 14, "dmi"), r.supertrend(2.0, 10, "st"), r.sar(0.02, 0.02, 0.2, "sar"), r.tsi("close", 5, 10, "tsi"), r.keltner("close", 20, 1.5, "kc"), r.nvi("nvi")]
    rows = r.recur(df, specs).orderBy("ts").collect()
    assert rows[0].sar is None and rows[13].rsi is None and rows[14].rsi is not None
    for x in rows[40:]:
        assert 0 <= x.rsi <= 100 and 0 <= x.dmi_adx <= 100 and -1 <= x.tsi <= 1 and x.kc_lower < x.kc < x.kc_upper and x.nvi == 1
        assert x.st_direction in (-1.0, 1.0) and (x.st <= x.close if x.st_direction < 0 else x.st >= x.close)
        assert x.sar >= x.low or x.sar <= x.high


def test_constant_and_short_series(spark):
    flat = r.recur(bars(spark, [5.0] * 30), [r.rsi("close", 3, "rsi"), r.tsi("close", 2, 3, "tsi"), r.sar(0.02, 0.02, 0.2, "sar")]).orderBy("ts").collect()
    assert flat[-1].rsi == 100.0 and flat[-1].tsi is None and flat[-1].sar == 5.0
    one = r.recur(bars(spark, [5.0]), [r.dmi(3, 3, "d"), r.sar(0.02, 0.02, 0.2, "sar"), r.heikin_ashi("ha")]).collect()
    assert one[0].sar is None and one[0].ha_open == 5.0


def test_timeframes(spark):
    assert [timeframes.tf_seconds(t) for t in ("15", "30S", "D", "W", "M", "")] == [900, 30, 86_400, 604_800, -1, 0]
    assert [timeframes.tf_ratio("15", t) for t in ("60", "M", "5")] == [4, -1, -2]
    quarter = bars(spark, [10.0, 20.0, 30.0, 40.0, 50.0], 15)
    hours = timeframes.resample(quarter, "60", complete=4).collect()
    assert [(x.open, x.close, x.bars) for x in hours] == [(10.0, 40.0, 4)]
    assert [x.tf for x in timeframes.detect(quarter).collect()] == ["15"]
    off = timeframes.security(quarter, "60", "15", {"v": F.col("close")}).orderBy("ts").collect()
    assert [x.v for x in off] == [None, None, None, 40.0, 40.0]
    on = timeframes.security(quarter, "60", "15", {"v": F.col("close"), "h": F.col("high"), "o": F.col("open")}, lookahead=True).orderBy("ts").collect()
    assert [(x.v, x.h, x.o) for x in on] == [(10.0, 10.0, 10.0), (20.0, 20.0, 10.0), (30.0, 30.0, 10.0), (40.0, 40.0, 10.0), (50.0, 50.0, 50.0)]
    whole = timeframes.security(quarter, "60", "15", {"v": F.col("close")}, projected=True).orderBy("ts").collect()
    assert [x.v for x in whole] == [40.0] * 4 + [50.0]
    gone = quarter.where("close <> 40")  # the bucket's last bar is missing: the next bucket's first bar completes it
    assert [x.v for x in timeframes.security(gone, "60", "15", {"v": F.col("close")}, gaps=True).orderBy("ts").collect()] == [None, None, None, 30.0]
    assert [x.v for x in timeframes.security(gone, "60", "15", {"v": F.col("close")}, lookahead=True).orderBy("ts").collect()] == [10.0, 20.0, 30.0, 30.0]
    assert [x.bars for x in timeframes.expected_bars(quarter, "60", "15").collect()] == [1]
    done = timeframes.completions(quarter, "15", "15")
    assert timeframes.published(done, "15", "60").count() == 1
    assert [timeframes.lower_ratio(*x) for x in (("15", "5"), ("15", "30S"), ("15", "4"), ("D", "60"), ("5", "15"))] == [3, 30, None, None, None]
    assert [timeframes.check_security(*x) for x in (("15", "15", "60"), ("15", "15", "15"), ("1", "15", "5", True), ("15", "15", "5", True))] == ["higher", "same", "real", "synthetic"]
    for wrong in (("15", "15", "40"), ("15", "15", "7", True), ("15", "15", "5", True, True)):
        with pytest.raises(ValueError):
            timeframes.check_security(*wrong)
    with pytest.raises(ValueError):
        timeframes.security(quarter, "5", "15", {})
    one = bars(spark, [(100.0, 110.0, 90.0, 105.0)])
    path = [x.price for x in timeframes.sampled(one, 2).collect()]
    assert path == [100.0, 105.0]
    assert [x.price for x in timeframes.sampled(one, 4, "endpoints").orderBy("step").collect()] == pytest.approx([100.0, 90.0, 110.0, 105.0])
    low = timeframes.synthesised(one, 3, 3600).orderBy("part").collect()
    assert sum(x.volume for x in low) == 10.0 and [x.close for x in low] == pytest.approx([90.0, 110.0, 105.0]) and low[0].open == 100.0 and min(x.low for x in low) == 90.0
    still = bars(spark, [(5.0, 5.0, 5.0, 5.0)])
    for spread in ("uniform", "cosine", "triangle", "endpoints", "front", "back"):
        assert [x.price for x in timeframes.sampled(still, 5, spread).collect()] == [5.0] * 5
        found = [x.price for x in timeframes.sampled(one, 9, spread).orderBy("step").collect()]
        assert found[0] == 100.0 and found[-1] == 105.0 and len(found) == 9
    assert timeframes.sampled_by_volume(bars(spark, [1.0, 2.0]), 4, 2, 8).count() == 8


def test_sessions(spark):
    times = ["2024-03-08 14:29:00", "2024-03-08 14:30:00", "2024-03-08 21:00:00", "2024-03-11 13:30:00", "2024-03-10 15:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp_ntz(F.col("t")).alias("ts"))
    found = [x[0] for x in df.select(sessions.in_session("0930-1600:23456", F.col("ts"), "America/New_York")).collect()]
    assert found == [False, True, False, True, False]  # the clocks change between the Fridays


def trades(spark, rows, strategy, **account):
    return broker.backtest(bars(spark, rows), strategy, broker.Account(**account)).orderBy("trade").collect()


def test_market_orders_fill_at_the_next_open(spark):
    def run(own, bar, memory):
        if own.bar == 0:
            own.entry("a", True, 2)
        if own.bar == 2:
            own.entry("b", False, 1)

    (t,) = trades(spark, [(10.0, 11.0, 9.0, 10.0), (12.0, 13.0, 11.0, 12.0), (13.0, 15.0, 12.0, 14.0), (16.0, 17.0, 15.0, 16.0)], run, fee_value=1.0)
    assert (t.entry_price, t.exit_price, t.qty, t.is_long) == (12.0, 16.0, 2.0, True)
    assert t.pnl == pytest.approx(8 - 0.24 - 0.32) and t.pnl_pct == pytest.approx(t.pnl / 24 * 100) and t.max_run_up == pytest.approx(8.0 - 0.24)


def test_brackets_follow_the_path(spark):
    def run(own, bar, memory):
        if own.bar == 0:
            own.entry("a", True, 1)
            own.exit("x", "a", limit=110.0, stop=95.0)

    def closes(bar):
        return trades(spark, [(100.0,) * 4, bar], run)[0].exit_price

    assert closes((100.0, 111.0, 80.0, 90.0)) == 110.0  # the high is nearer
    assert closes((100.0, 125.0, 94.0, 90.0)) == 95.0  # the low is nearer
    assert trades(spark, [(100.0,) * 4, (100.0,) * 4, (90.0,) * 4], run)[0].exit_price == 90.0  # a gap


def test_stops_limits_trailing_and_pyramids(spark):
    def stop(own, bar, memory):
        if own.bar == 0:
            own.entry("a", True, 1, stop=105.0)
            own.entry("b", True, 1, limit=103.0)
        if own.bar == 1:
            own.exit("x", trail=5.0)

    found = trades(spark, [(100.0,) * 4, (104.0, 108.0, 102.0, 107.0), (107.0, 120.0, 106.0, 119.0), (119.0, 119.0, 100.0, 100.0)], stop, pyramiding=2)
    assert sorted((t.entry_id, t.entry_price) for t in found) == [("a", 105.0), ("b", 103.0)] and all(t.exit_price == 115.0 for t in found)


def test_accounting_and_determinism(spark):
    rng = np.random.default_rng(3)
    close = 100 + np.cumsum(rng.normal(size=400))
    rows = [(float(c), float(c + 1), float(c - 1), float(c + 0.5)) for c in close]

    def run(own, bar, memory):
        if own.bar % 7 == 0:
            own.entry("a", own.bar % 2 == 0)
        if own.bar % 11 == 5:
            own.close()

    account = broker.Account(fee_value=0.05, slippage=2, sizing="percent", size=50)
    df = bars(spark, rows)
    found = broker.backtest(df, run, account).collect()
    curve = broker.backtest(df, run, account, equity=True).orderBy("ts").collect()
    assert found == broker.backtest(df, run, account).collect()
    flat = [p for p in curve if p.position == 0][-1]
    done = sum(t.pnl for t in found if t.exit_bar <= flat.bar)
    assert flat.equity == pytest.approx(account.capital + done)
    stats = {x.side: x for x in metrics.trade_stats(broker.backtest(df, run, account), account.capital).collect()}
    assert stats["all"].num_trades == stats["long"].num_trades + stats["short"].num_trades == len(found)
    assert stats["all"].net_profit == pytest.approx(stats["all"].gross_profit - stats["all"].gross_loss)
    assert broker.sweep(df, run, [{}, {"account.slippage": 0}], account).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([([[2.0, 1.0], [1.0, 3.0]], 1234567.0, "ab-12")], "m array<array<double>>, x double, t string")
    m = F.col("m")
    row = df.select(
        scalars.matrix_det(m).alias("det"), scalars.matrix_inv(m).alias("inv"), scalars.matrix_eigenvalues(m).alias("eig"), scalars.matrix_sort(m, 0).alias("sorted"), scalars.matrix_is(m, "symmetric").alias("sym"),
        scalars.matrix_is(m, "identity").alias("id"), scalars.number_text(F.col("x"), "volume").alias("text"), scalars.text_match(F.col("t"), "-(\\d+)").alias("match"), scalars.channel(F.lit(scalars.argb(1, 2, 3)), "g").alias("g"),
    ).first()
    assert row.det == pytest.approx(5.0) and row.inv[0][0] == pytest.approx(0.6) and row.eig[0] > row.eig[1]
    assert row.sorted == [[1.0, 3.0], [2.0, 1.0]] and row.sym and not row.id and (row.text, row.match, row.g) == ("1.23M", "12", 2)
    texts = [(12.3456, "mintick"), (0.1234, "percent"), (-1234.5, "volume"), (0.5, "volume"), (1.5, ""), (None, "percent")]
    shown = [spark.range(1).select(scalars.number_text(F.lit(x).cast("double"), m, 0.05)).first()[0] for x, m in texts]
    assert shown == ["12.35", "12.34%", "-1.23K", "0.50", "1.500000", "NaN"]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    at = np.sort(rng.integers(0, 6 * 3600, 200))
    rows = [("s", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=int(t)), float(100 + i % 17), 1.0) for i, t in enumerate(at)]
    rows += [("s", dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc), 99.0, 1.0)]  # after a gap
    schema = "symbol string, ts timestamp, price double, quantity double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ticks"))
    query = live.continuous(stream, 3600).writeStream.format("memory").queryName("bars").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("bars").orderBy("ts").collect()
    batch = timeframes.filled(sources.from_ticks(spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 60, quantity=F.col("quantity")), 3600).orderBy("ts").collect()
    assert len(got) == 12
    for x, y in list(zip(got, batch))[:12]:
        assert (x.high, x.low, x.close, x.volume) == (y.high, y.low, y.close, y.volume)


def test_bar_builder():
    own, rows = live.Builder(), []
    for t, price, number in ((60, 10.0, 1), (70, 12.0, 2), (65, 99.0, 3), (80, 9.0, 2), (400, 11.0, 9)):
        rows += own.push(t, price, 1.0, 60, sequence=number)
    assert [(r[0].timestamp(), *r[1:5], r[6]) for r in rows] == [(60.0, 10.0, 12.0, 10.0, 12.0, 2), *[(float(t), 12.0, 12.0, 12.0, 12.0, 0) for t in (120, 180, 240, 300)]]
    assert [r[5] for r in rows] == [2.0, 0.0, 0.0, 0.0, 0.0] and list(own.end(False)) == []
    assert [(r[0].timestamp(), r[1]) for r in own.end(True)] == [(360.0, 11.0)]
    assert [r[0].timestamp() for r in own.advance(500, 60)] == [360.0, 420.0]  # the clock closes bars without ticks
    night, found = live.Builder(), []
    for t in (9 * 3600, 9 * 3600 + 3 * 86400):
        found += night.push(t, 5.0, 1.0, 3600, "0900-1100")
    assert [r[0].hour for r in found] == [9, 10] * 3 and len({r[0] for r in found}) == 6


def test_a_quiet_stream_closes_its_bars(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, quantity double"
    at = lambda m, s: (s, dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m), 100.0 + m, 1.0)
    for k, rows in enumerate(([at(0, "a"), at(1, "b")], [at(200, "b")], [at(201, "b")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ticks"))
        query = live.continuous(stream, 3600, late="0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = [(r.symbol, r.ts.hour) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("symbol", "ts").collect()]
    assert ("a", 0) in found and ("b", 0) in found  # no tick of a came after its first


def test_finished_bars_and_sessions(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 10), 1.0, 1.0), ("s", dt.datetime(2024, 1, 1, 12, 30), 2.0, 1.0)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, quantity double")
    assert live.finished(ticks, 3600).count() == 2 and live.finished(ticks, 3600, partial=True).count() == 3
    assert sessions.zone_id("UTC+2") == "+02:00" and sessions.zone_id("GMT-0530") == "-05:30" and sessions.zone_id("UTC+0") == "UTC" and sessions.zone_id("Asia/Tokyo") == "Asia/Tokyo"
    noon = int(dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc).timestamp())
    assert sessions.holds("1200-1300:2", noon) and not sessions.holds("1200-1300:3", noon) and sessions.holds("2200-1300", noon) and not sessions.holds("0900-0900", noon) and sessions.holds("1400-1500", noon, "UTC+2")


def test_reports(spark):
    def run(own, bar, memory):
        if own.bar % 4 == 0:
            own.entry("a", own.bar % 8 == 0, 1.0)

    df = bars(spark, [100.0 + (i % 5) for i in range(40)])
    found, curve = broker.backtest(df, run), broker.backtest(df, run, equity=True)
    row = reports.report(found, curve, 1e5).first()
    assert len(row.trades) == found.count() == row.summary.total_trades and len(row.equity_curve) == 40 and set(row.metrics) == {"all", "long", "short"}
    assert row.equity.net_profit == pytest.approx(row.summary.net_pnl) and row.equity.points == 40
    one, two = reports.fingerprint({"b": 1, "a": [0.5, "x"]}), reports.fingerprint({"a": [0.5, "x"], "b": 1})
    assert one["digest"] == two["digest"] and one["token"] == two["token"] and one["digest"] != reports.fingerprint({"a": 1})["digest"]
    with pytest.raises(ValueError):
        reports.fingerprint({"a": float("nan")})
    digest = lambda d: reports.feed_digest(d).first().digest
    assert digest(df) == digest(df.repartition(5)) != digest(df.where("close > 100"))


def test_equity_extremes_are_of_their_points(spark):
    values = [100.0, 90.0, 95.0, 120.0, 100.0, 110.0, 130.0, 118.0]  # the first point, not the capital, begins the peaks
    df = spark.createDataFrame([("x", T0 + dt.timedelta(days=40 * i), v) for i, v in enumerate(values)], "symbol string, ts timestamp_ntz, equity double")
    row = metrics.equity_stats(df, 200.0).first()
    assert (row.max_drawdown, row.max_drawdown_pct) == (20.0, pytest.approx(100 / 6)) and (row.max_run_up, row.max_run_up_pct, row.final_equity) == (10.0, 10.0, 118.0)


def test_curves_of_currency(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, d, h), 10.0) for d, h in ((1, 0), (2, 1), (2, 23), (9, 5))], "ts timestamp_ntz, v double")
    curve = sources.fx_points(spark.createDataFrame([(dt.datetime(2024, 1, 2), 2.0), (dt.datetime(2024, 1, 2, 12), 3.0)], "ts timestamp_ntz, rate double"))
    found = [x.v for x in timeframes.converted(rows, curve, ("v",)).orderBy("ts").collect()]
    assert found == [10.0, 20.0, 30.0, 30.0]
    for wrong in ([(dt.datetime(2024, 1, 2), 2.0), (dt.datetime(2024, 1, 2), 3.0)], [(dt.datetime(2024, 1, 2), -1.0)]):
        with pytest.raises(Exception):
            sources.fx_points(spark.createDataFrame(wrong, "ts timestamp_ntz, rate double")).collect()


def test_matrix_structure(spark):
    rows = [(1, [[2.0, 1.0], [1.0, 2.0]]), (2, [[1.0, 2.0, 3.0]]), (3, []), (4, None), (5, [[float("nan"), 1.0], [1.0, 1.0]])]
    m = F.col("m")
    found = spark.createDataFrame(rows, "id int, m array<array<double>>").select(
        "id", scalars.matrix_pow(m, 3).alias("cube"), scalars.matrix_pow(m, 0).alias("unit"), scalars.matrix_eigenvectors(m).alias("vectors"), scalars.matrix_mode(m).alias("mode"),
        scalars.matrix_avg(m).alias("avg"), scalars.matrix_kron(m, F.array(F.array(F.lit(1.0), F.lit(10.0)))).alias("kron"), scalars.matrix_remove_column(m, 0).alias("less"),
    ).orderBy("id").collect()
    two, flat, empty, none, bad = found
    assert two.cube == [[14.0, 13.0], [13.0, 14.0]] and two.unit == [[1.0, 0.0], [0.0, 1.0]] and two.mode == 1.0 and two.avg == 1.5
    assert abs(abs(two.vectors[0][1]) - 0.5**0.5) < 1e-12 and two.kron == [[2.0, 20.0, 1.0, 10.0], [1.0, 10.0, 2.0, 20.0]] and two.less == [[1.0], [2.0]]
    assert flat.cube == [] and flat.vectors == [] and flat.mode == 1.0 and flat.kron == [[1.0, 10.0, 2.0, 20.0, 3.0, 30.0]]
    assert empty.avg is None and empty.mode == 0.0 and empty.kron == [] and empty.cube == []
    assert none.cube is None and none.avg is None and bad.cube == [] and bad.vectors == []


def test_sources_by_name_and_derived_feeds(spark):
    df = bars(spark, [(1.0, 4.0, 0.5, 3.0)])
    assert [column(df, w.source(n))[0] for n in ("close", "hl2", "ohlc4")] == [3.0, 2.25, 2.125]
    rows = [("x", T0, 5.0, 5.0, 5.0, 5.0, 0.0), ("x", T0 + dt.timedelta(minutes=1), 7.0, 8.0, 6.0, 7.5, 0.1), ("x", T0 + dt.timedelta(minutes=2), 7.5, 7.5, 7.5, 7.5, 0.2)]
    (row,) = timeframes.resample(spark.createDataFrame(rows, sources.BAR), "15", first_traded=True).collect()
    assert (row.open, row.high, row.low, row.close, row.volume) == (7.0, 8.0, 5.0, 7.5, 0.3)


def test_matrices_of_text(spark):
    df = spark.createDataFrame([([["b", "x"], ["a", "y"]],)], "m array<array<string>>")
    m = F.col("m")
    row = df.select(scalars.matrix_transpose(m).alias("t"), scalars.matrix_sort(m, 0).alias("s"), scalars.matrix_set(m, 0, 1, F.lit("z")).alias("z"), scalars.matrix_concat(m, m, False).alias("c"), scalars.matrix_reverse(m).alias("r")).first()
    assert row.t == [["b", "a"], ["x", "y"]] and row.s == [["a", "y"], ["b", "x"]] and row.z[0] == ["b", "z"] and len(row.c) == 4 and row.r == [["y", "a"], ["x", "b"]]


def test_live_report(spark, tmp_path):
    """Each batch hands on the trades of all bars so far."""
    df = bars(spark, [100.0 + (i % 5) for i in range(30)])
    ordered = sorted(df.collect(), key=lambda r: r.ts)
    seen = {}

    def run(own, bar, memory):
        if own.bar % 4 == 0:
            own.entry("a", own.bar % 8 == 0, 1.0)

    for k in range(2):
        spark.createDataFrame(ordered[15 * k : 15 * k + 15], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bars"))
    query = live.live(stream, run, broker.Account(), lambda trades, k: seen.update({k: trades.count()}), folder=str(tmp_path / "seen"))
    query.processAllAvailable()
    query.stop()
    assert seen[1] == broker.backtest(df, run).count() > seen[0] > 0


def test_runs_of_timeframes(spark):
    df = bars(spark, [100.0 + (i * 7 % 11) for i in range(120)], 15)

    def flip(own, bar, memory):
        own.entry("a", own.bar % 2 == 0, 1.0)

    hours = broker.run(df, flip, "15", "60").orderBy("trade").collect()
    assert hours == broker.run(df, flip, "15", "60", magnifier=True).orderBy("trade").collect()  # market orders fill at opens
    assert hours[0].entry_ts == T0 + dt.timedelta(hours=1)
    assert broker.run(df, flip, "15", "15", magnifier=True, samples=6).count() == broker.backtest(df, flip).count()
    with pytest.raises(ValueError):
        broker.run(df, flip, "60", "15")
