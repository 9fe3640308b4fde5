import datetime as dt
import math

import pytest

from tickframe.broker import Account, Broker, Drawings, Inputs
from tickframe.broker.drawing import DrawingError, Line
from tickframe.broker.run import _simulate, walk

T0 = dt.datetime(2025, 3, 31)


def play(rows, strategy, start=None, points=None, extra=None, **account):
    bars = [{"ts": T0 + dt.timedelta(minutes=15 * i), "open": o, "high": h, "low": low, "close": c, **(extra or {}).get(i, {})} for i, (o, h, low, c) in enumerate(rows)]
    return _simulate(bars, strategy, Account(**({"capital": 1e6} | account)), {}, start, points)


def trades(rows, strategy, **account):
    return play(rows, strategy, **account)[0].trades


FLAT = (100.0, 101.0, 99.0, 100.0)
STILL = (100.0,) * 4


def script(**calls):
    """A strategy that does ``b<n>`` at bar n."""

    def run(own, bar, memory):
        do = calls.get(f"b{own.bar}")
        if do:
            do(own)

    return run


def test_limits_do_not_slip():
    def exits(own, bar, memory):
        if own.bar == 0:
            own.entry("L", True, 1.0)
        if own.position > 0:
            own.exit("LX", "L", limit=100.515, stop=99.0)

    (t,) = trades([(100, 100.1, 99.9, 100), (100, 100.2, 99.9, 100.1), (100.1, 101, 100, 100.5), (100.5, 100.6, 100.4, 100.5)], exits, slippage=2)
    assert (t["entry_price"], t["exit_price"]) == (pytest.approx(100.02), pytest.approx(100.52))

    def stops(own, bar, memory):
        if own.bar == 0:
            own.entry("L", True, 1.0)
        if own.position > 0:
            own.exit("LX", "L", limit=102.0, stop=99.515)

    (t,) = trades([(100, 100.1, 99.9, 100), (100, 100.2, 99.9, 100.1), (100.1, 100.2, 99.0, 99.2)], stops, slippage=2)
    assert t["exit_price"] == pytest.approx(99.49)
    (t,) = trades([(100, 100.1, 99.9, 100), (99.5, 99.6, 98, 99), (99, 99.1, 98.9, 99), (99, 99.1, 98.9, 99)], script(b0=lambda o: o.entry("L", True, 1.0, limit=98.485), b2=lambda o: o.close("L")), slippage=2)
    assert t["entry_price"] == pytest.approx(98.48)
    # A limit that gaps fills at the open, and doesn't slip either.
    own, _ = play([FLAT, (90, 91, 89, 90)], script(b0=lambda o: o.entry("a", True, 1.0, limit=95.0)), slippage=3)
    assert own.lots[0].price == 90.0


def test_raw_orders_net_and_open_nothing():
    own, _ = play([FLAT] * 5, script(b0=lambda o: o.entry("a", True, 1.0), b2=lambda o: o.order("b", False, 3.0)))
    assert own.position == 0 and len(own.trades) == 1
    own, _ = play([(100, 105, 95, 100), (101, 106, 96, 101)], script(b0=lambda o: o.order("R", True, 3.0)))
    assert own.position == 3.0 and own.average_price == 101.0
    own, _ = play([FLAT] * 5, script(b0=lambda o: o.order("a", True, 1.0), b2=lambda o: o.order("b", True, 1.0)))
    assert own.position == 1.0  # the limit on entries holds for raw orders too


def test_closing_takes_the_oldest_lots_unless_told():
    def two(own, bar, memory):
        if own.bar == 0:
            own.entry("a", True, 1.0)
        if own.bar == 1:
            own.entry("b", True, 2.0)
        if own.bar == 3:
            own.close("b")

    first = trades([FLAT] * 6, two, pyramiding=5)
    assert [(t["entry_id"], t["qty"]) for t in first] == [("a", 1.0), ("b", 1.0)]  # two of the oldest, as much as b's
    assert [(t["entry_id"], t["qty"]) for t in trades([FLAT] * 6, two, pyramiding=5, closing="ANY")] == [("b", 2.0)]

    def twice(own, bar, memory):
        two(own, bar, memory)
        if own.bar == 4:
            own.close("b")  # its quantity has been closed already

    assert len(trades([FLAT] * 8, twice, pyramiding=5)) == 2
    parts = trades([FLAT] * 5, script(b0=lambda o: o.entry("a", True, 4.0), b2=lambda o: o.close("a", percent=25.0)))
    assert [t["qty"] for t in parts] == [1.0]
    now = trades([FLAT, FLAT, (100, 101, 99, 100.5)], script(b0=lambda o: o.entry("a", True, 1.0), b2=lambda o: o.close(immediately=True)))
    assert now[0]["exit_price"] == 100.5 and now[0]["exit_bar"] == 2


def test_tiers_share_the_position():
    def tiers(limits, stop):
        def run(own, bar, memory):
            if own.bar == 0:
                own.entry("L", True, 10.0)
            if own.bar == 1:
                for k, (limit, percent) in enumerate(limits):
                    own.exit(f"TP{k}", "L", limit=limit, stop=stop, percent=percent)

        return run

    found = trades([FLAT, FLAT, (100, 108, 100, 107), (107, 108, 106, 107)], tiers([(102.0, 40.0), (104.0, 33.0), (106.0, 100.0)], None))
    assert [(t["exit_price"], pytest.approx(t["qty"])) for t in found] == [(102.0, 4.0), (104.0, 3.3), (106.0, 2.7)]
    found = trades([FLAT, FLAT, (100, 102, 94, 96), (96, 97, 95, 96)], tiers([(103.0, 35.0), (105.0, 35.0), (107.0, 100.0)], 96.0))
    assert [t["exit_price"] for t in found] == [96.0] * 3 and sum(t["qty"] for t in found) == pytest.approx(10.0)


def test_a_bracket_takes_the_additions_of_its_bar_along():
    def run(own, bar, memory):
        if own.bar == 0:
            own.entry("L", True, 2.0)
        if own.bar == 1:
            own.exit("x", "L", limit=104.0, qty=2.0)
            own.entry("L", True, 1.0)  # fills at the next open, before the bracket

    own, _ = play([STILL, STILL, (101, 105, 100, 103)], run, pyramiding=5)
    assert own.position == 0 and [(t["qty"], t["entry_price"], t["exit_price"]) for t in own.trades] == [(2.0, 100.0, 104.0), (1.0, 101.0, 104.0)]


def test_partial_exits_are_done_once():
    def again(own, bar, memory):
        if own.bar == 0:
            own.entry("L", True, 4.0)
        if own.position > 0:
            own.exit("half", "L", limit=105.0, percent=50.0)

    own, _ = play([FLAT, FLAT, (100, 106, 99, 104), (104, 106, 103, 104), (104, 106, 103, 104)], again)
    assert own.position == 2.0 and [t["qty"] for t in own.trades] == [2.0]


def test_ticks_of_profit_and_loss():
    run = script(b0=lambda o: (o.entry("L", True, 1.0), o.exit("x", "L", profit=500, loss=300)))
    (t,) = trades([FLAT, (100, 102, 99, 101), (101, 105.5, 100, 105)], run)
    assert t["exit_price"] == pytest.approx(105.0)
    (t,) = trades([FLAT, (100, 102, 99, 101), (101, 101.5, 96, 97)], run)
    assert t["exit_price"] == pytest.approx(97.0)


def test_trailing_stops():
    rows = [FLAT, FLAT, (100, 110, 99.5, 109), (109, 112, 104, 105)]
    (t,) = trades(rows, script(b0=lambda o: o.entry("L", True, 1.0), b1=lambda o: o.exit("x", "L", trail_from=105.0, trail=5.0)))
    assert t["exit_price"] == pytest.approx(107.0)  # five below 112
    (t,) = trades(rows, script(b0=lambda o: o.entry("L", True, 1.0), b1=lambda o: o.exit("x", "L", trail_points=500, trail=5.0)))
    assert t["exit_price"] == pytest.approx(107.0)
    (t,) = trades(rows, script(b0=lambda o: o.entry("L", True, 1.0), b1=lambda o: o.exit("x", "L", trail_from=105.0)))
    assert t["exit_price"] == pytest.approx(105.0)  # without a distance it is a limit of a kind


def test_groups():
    def grouped(kind, qtys):
        def run(own, bar, memory):
            if own.bar == 1:
                for name, (qty, limit) in zip("ABC", qtys):
                    own.order(name, True, qty, limit=limit, group="G", grouped=kind)

        return run

    rows = [(100, 105, 95, 100), (100, 108, 95, 105), (100, 110, 90, 105), (100, 110, 85, 105)]
    own, _ = play(rows, grouped("reduce", [(3.0, 100.0), (5.0, 80.0)]), pyramiding=100)
    assert [(o.id, o.qty) for o in own.orders] == [("B", 2.0)]
    own, _ = play(rows, grouped("reduce", [(5.0, 100.0), (5.0, 80.0), (3.0, 70.0)]), pyramiding=100)
    assert own.orders == []
    own, _ = play(rows, grouped("cancel", [(3.0, 100.0), (5.0, 80.0)]), pyramiding=100)
    assert own.orders == [] and own.position == 3.0
    own, _ = play(rows, grouped("none", [(3.0, 100.0), (5.0, 80.0)]), pyramiding=100)
    assert [(o.id, o.qty) for o in own.orders] == [("B", 5.0)]


def test_cancelling_and_the_start():
    def armed(own, bar, memory):
        if own.bar == 1:
            for k in range(3):
                own.order(f"E{k}", True, 1.0, stop=200.0 + 10 * k)
        if own.bar == 2:
            own.cancel()

    own, _ = play([(100, 105, 90, 100)] * 3 + [(100, 230, 90, 100)] * 3, armed, pyramiding=100)
    assert own.orders == [] and own.lots == [] and own.trades == []
    for bar, held in ((1, 0.0), (2, 2.0)):
        own, _ = play([FLAT] * 6, script(**{f"b{bar}": lambda o: o.order("E", True, 2.0)}), start=T0 + dt.timedelta(minutes=45))
        assert own.position == held


def test_reversals():
    own, _ = play([FLAT] * 4, script(b0=lambda o: o.entry("a", True, 2.0), b1=lambda o: o.entry("b", False, 3.0)))
    assert own.position == -3.0 and len(own.trades) == 1
    # Armed when flat it nets against what came since.
    own, _ = play([FLAT, FLAT, (100, 100.5, 94, 95)], script(b0=lambda o: (o.entry("s", False, 3.0, stop=95.0), o.entry("a", True, 2.0))))
    assert own.position == -1.0
    # Placed against a position that is gone when it fills, it opens what it was to close as well.
    own, _ = play([FLAT, FLAT, FLAT, (100, 100.5, 94, 95)], script(b0=lambda o: o.entry("a", True, 2.0), b1=lambda o: (o.entry("s", False, 1.0, stop=95.0), o.close("a"))))
    assert own.position == -3.0
    own, _ = play([FLAT] * 4, script(b0=lambda o: o.entry("a", True, 1.0), b1=lambda o: o.entry("b", False, 1.0)), direction="long")
    assert own.position == 0.0


def test_stops_and_stop_limits():
    own, _ = play([FLAT, (100, 110, 99, 105)], script(b0=lambda o: o.entry("a", True, 1.0, stop=103.005)))
    assert own.lots[0].price == pytest.approx(103.01) and own.lots[0].inside
    own, _ = play([FLAT, (106, 110, 99, 105)], script(b0=lambda o: o.entry("a", True, 1.0, stop=103.0)))
    assert own.lots[0].price == 106.0
    own, _ = play([FLAT, (100, 110, 99, 105)], script(b0=lambda o: o.entry("a", True, 1.0, stop=103.0, limit=102.0)))
    assert own.lots == []  # armed on the way up, and the price doesn't come back
    own, _ = play([FLAT, (104, 104.5, 100, 101)], script(b0=lambda o: o.entry("a", True, 1.0, stop=103.0, limit=102.0)))
    assert own.lots[0].price == 102.0
    both = script(b0=lambda o: (o.entry("s", False, 1.0, stop=95.0), o.entry("l", True, 1.0, stop=105.0)))
    own, _ = play([FLAT, (100, 106, 99, 105)], both)
    assert own.position == 1.0


def test_orders_on_close():
    own, _ = play([FLAT, (100, 110, 90, 104)], script(b1=lambda o: (o.entry("L", True, 4.0))), on_close=True)
    assert own.lots[0].price == 104.0 and own.lots[0].bar == 1

    def run(own, bar, memory):
        if own.bar == 0:
            own.entry("L", True, 4.0)
        if own.bar == 1:
            own.exit("TP", "L", limit=9999.0)
            own.close("L")
            memory["left"] = [o.kind for o in own.orders]

    own, _ = play([(100, 110, 90, 100)] * 5, run, on_close=True)
    assert own.position == 0 and len(own.trades) == 1 and own.orders == []


def test_limits_on_losses():
    lose = lambda own, bar, memory: own.entry("a", True, 1.0) if own.position == 0 else own.close()
    fall = [(100 - 5 * i, 101 - 5 * i, 94 - 5 * i, 95 - 5 * i) for i in range(12)]
    free = trades(fall, lose)
    assert len(trades(fall, lose, max_drawdown=8.0)) < len(free) and len(trades(fall, lose, max_day_loss=6.0)) < len(free)
    assert len(trades(fall, lose, max_loss_days=1)) == 1
    own, _ = play([FLAT] * 10, lambda o, b, m: o.entry("a", o.bar % 2 == 0, 1.0), max_orders_a_day=3)
    assert own.filled_today == 3 and own.position == 0
    own, _ = play([FLAT] * 5, lambda o, b, m: o.entry("a", True, 1.0), pyramiding=9, max_position=2.0)
    assert own.position == 2.0


def test_margin():
    own, _ = play([STILL, STILL, (100, 130, 99, 128)], script(b0=lambda o: o.entry("s", False, 100.0)), capital=10_000, margin=100.0)
    short = 100 - (10_000 - 30 * 100) / 130
    assert own.trades[0]["exit_comment"] == "Margin call" and own.trades[0]["qty"] == pytest.approx(min(100, 4 * short)) and own.trades[0]["exit_price"] == 130.0
    own, _ = play([FLAT, FLAT], script(b0=lambda o: o.entry("a", True, 200.0)), capital=10_000, margin=100.0)
    assert own.lots == []  # more than there is money for
    own, _ = play([FLAT, FLAT], script(b0=lambda o: o.entry("a", True, 100.0)), capital=10_000, margin=50.0)
    assert own.liquidation_price() == pytest.approx((10_000 / 100 - 100) / (0.5 - 1))


def test_currency():
    rates = ((T0, 1.0), (T0 + dt.timedelta(minutes=30), 2.0))
    (t,) = trades([FLAT, FLAT, (110, 111, 109, 110)], script(b0=lambda o: o.entry("a", True, 1.0), b1=lambda o: o.close()), rates=rates, fee_value=1.0)
    assert t["pnl"] == pytest.approx((110 - 100) * 2 - (100 + 110) * 2 * 0.01)


def test_fees_by_order_and_contract():
    run = script(b0=lambda o: o.entry("a", True, 2.0), b1=lambda o: o.close())
    assert trades([FLAT] * 3, run, fee="order", fee_value=3.0)[0]["commission"] == 6.0
    assert trades([FLAT] * 3, run, fee="contract", fee_value=3.0)[0]["commission"] == 12.0


def test_excursions_and_masks():
    (t,) = trades([FLAT, (100, 112, 98, 105), (105, 106, 104, 105)], script(b0=lambda o: o.entry("a", True, 2.0, stop=108.0), b1=lambda o: o.close()))
    assert t["entry_price"] == 108.0 and t["max_run_up"] == 0.0 and t["max_drawdown"] == pytest.approx(6.0)  # extremes before the fill don't count


def test_walks():
    children = [{"open": 100, "high": 101, "low": 99, "close": 100.5}, {"open": 103, "high": 104, "low": 102.5, "close": 103.5}]
    path, jumps = walk(children)
    assert path == [100, 99, 101, 100.5, 103, 102.5, 104, 103.5] and jumps == {3}
    run = script(b0=lambda o: o.entry("a", True, 1.0, stop=102.0))
    own, _ = play([FLAT, (100, 104, 99, 103.5)], run, extra={1: {"children": children}})
    assert own.lots[0].price == 103.0  # the leap passes the stop
    own, _ = play([FLAT, (100, 104, 99, 103.5)], run)
    assert own.lots[0].price == 102.0
    own, _ = play([FLAT, (100, 104, 99, 103.5)], run, extra={1: {"path": [100.0, 99.0, 101.0, 104.0, 103.5]}})
    assert own.lots[0].price == 102.0


def test_running_again_after_fills():
    calls = []

    def run(own, bar, memory):
        memory["n"] = memory.get("n", 0) + 1
        calls.append((own.bar, memory["n"], bar["close"]))
        if own.bar == 0:
            own.entry("a", True, 1.0, stop=103.0)
        if own.position > 0 and not own.orders:
            own.exit("x", "a", limit=104.0, stop=98.0)

    own, _ = play([FLAT, (100, 105, 99, 104.5), FLAT], run, on_fills=True)
    assert own.trades[0]["exit_price"] == 104.0 and own.trades[0]["exit_bar"] == 1  # the bracket was made inside the bar
    assert [c[:2] for c in calls if c[0] == 1][-1] == (1, 2)  # memory is as if the bar had run once
    own, _ = play([FLAT, (100, 105, 99, 104.5), FLAT], run)
    assert own.trades == [] or own.trades[0]["exit_bar"] == 2


def test_state_and_open_trades():
    own, _ = play([FLAT, FLAT, (100, 110, 99, 109)], script(b0=lambda o: o.entry("a", True, 2.0)), fee_value=1.0)
    (row,) = own.open_trades()
    assert row["profit"] == pytest.approx(18 - 2.0) and row["max_run_up"] == 20.0 and row["commission"] == 2.0
    now = own.state()
    assert now["equity"] == 1e6 + 18 and now["open_trades"] == 1 and now["max_contracts_held_long"] == 2.0 and now["avg_trade"] == 0.0


def test_inputs():
    own = Inputs({"n": "14abc", "x": " 2.5", "f": "true", "g": "maybe", "s": "hl2", "big": str(2**40), "word": "w"}, {"employees": 10.0})
    assert own.integer("n", 1) == 14 and own.number("x", 0.0) == 2.5 and own.flag("f", False) and own.flag("g", True) and own.source("s") == "hl2"
    assert own.integer("big", 7) == 7 and own.integer("big", 7, 64) == 2**40 and own.number("word", 1.5) == 1.5 and own.source("word") == "close" and own.text("none", "d") == "d"
    assert own.meta("employees") == 10.0 and own.meta("none") is None


def test_drawings():
    own = Drawings()
    first = own.lines.new(Line(0, 10.0, 10, 20.0))
    assert own.line_price(first, 20) == 30.0 and own.line_price(own.lines.new(Line(3, 1.0, 3, 2.0)), 5) is None
    for k in range(60):
        own.lines.new(Line(k, 0.0, k + 1, 1.0))
    assert len(own.lines.living) == 50 and own.lines.copy(first) is None and own.line_price(first, 0) == 10.0
    own.lines.set(first, y1=0.0)
    assert own.lines[first].y1 == 0.0 and own.lines.new(Line(0, 0.0, 1, 1.0)) == 62
    with pytest.raises(DrawingError):
        own.line_price(None, 1)
    with pytest.raises(DrawingError):
        own.line_price(own.lines.new(Line(0, 0.0, 1, 1.0, by_time=True)), 1)
    assert not math.isnan(Broker().equity())
