"""The broker of one series: pending orders, fills along each bar's path, lots, fees and equity.

A bar's price is taken to go from the open to the nearer extreme, to the other and to the close, or
along a finer path that is given. Each pending order has a first place on that path where it fills;
orders fill in that sequence, stops before trailing stops before limits at one place.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from zoneinfo import ZoneInfo

TINY = 1e-10
#: Below this share of the position, or of a percent, an exit still counts as whole.
WHOLE = 1e-9
CLOSE = "__close__"


@dataclass(frozen=True)
class Account:
    """Rules of the account. Sizing is 'fixed', 'percent' of equity, or 'cash'; fees are 'percent', 'order' or 'contract'.

    ``closing`` is 'FIFO' or 'ANY': whether closing an entry takes the oldest lots or its own. Margins are
    percents of a position's worth; limits that are infinite or 0 days don't bind. ``rates`` are times
    and rates of the account's currency, in force until the next; ``rate`` holds before the first.
    """

    capital: float = 100_000.0
    sizing: str = "fixed"
    size: float = 1.0
    pyramiding: int = 1
    closing: str = "FIFO"
    fee: str = "percent"
    fee_value: float = 0.0
    slippage: int = 0
    tick: float = 0.01
    lot: float = 0.0
    point_value: float = 1.0
    on_close: bool = False
    on_fills: bool = False
    margin: float = 0.0
    margin_short: float | None = None
    direction: str = "both"
    max_position: float = math.inf
    max_drawdown: float = math.inf
    max_drawdown_percent: float = math.inf
    max_day_loss: float = math.inf
    max_day_loss_percent: float = math.inf
    max_loss_days: int = 0
    max_orders_a_day: float = math.inf
    zone: str = "UTC"
    rate: float = 1.0
    rates: tuple[tuple[object, float], ...] = ()


@dataclass(eq=False)
class Order:
    """A pending order. ``kind`` is entry, order, exit or close; prices that are None don't bind.

    ``born`` and ``side`` are the bar and the position's sign when it was placed, ``carry`` the opposite
    position it was to reverse. ``reserved`` is the quantity an exit holds back from its siblings.
    """

    id: str
    kind: str
    long: bool
    qty: float | None = None
    limit: float | None = None
    stop: float | None = None
    trail: float | None = None
    trail_from: float | None = None
    trail_points: float | None = None
    profit: float | None = None
    loss: float | None = None
    percent: float = 100.0
    sizing: str | None = None
    of: str | None = None
    group: str | None = None
    grouped: str = "cancel"
    comment: str = ""
    best: float | None = None
    reserved: float | None = None
    partial: bool = False
    born: int = -1
    side: int = 0
    carry: float = 0.0

    @property
    def priced(self) -> bool:
        return self.limit is not None or self.stop is not None

    @property
    def trails(self) -> bool:
        return self.trail is not None or self.trail_from is not None or self.trail_points is not None


@dataclass(eq=False)
class Lot:
    id: str
    long: bool
    qty: float
    price: float
    bar: int
    ts: object
    high: float = 0.0
    low: float = 0.0
    comment: str = ""
    #: Whether it was filled on the way along a bar, so that the price before doesn't count.
    inside: bool = False
    #: Whether a market order added it to a position.
    added: bool = False


@dataclass
class Touch:
    """Where an order first fills: place on the path, price, rank among orders of one place, whether a limit fills."""

    place: float
    price: float
    rank: int
    limit: bool = False


@dataclass
class Broker:
    """State of one series. A strategy calls its order methods; ``advance`` fills them on the next bar."""

    account: Account = field(default_factory=Account)
    lots: list[Lot] = field(default_factory=list)
    orders: list[Order] = field(default_factory=list)
    trades: list[dict] = field(default_factory=list)
    realised: float = 0.0
    bar: int = -1
    ts: object = None
    close_price: float = 0.0
    peak: float = -math.inf
    trough: float = math.inf
    max_drawdown: float = 0.0
    max_run_up: float = 0.0
    most_held: dict = field(default_factory=lambda: {"all": 0.0, "long": 0.0, "short": 0.0})
    halted: bool = False
    filled_today: int = 0
    capped: bool = False
    day: object = None
    day_profit: float = 0.0
    loss_day: object = None
    loss_days: int = 0
    #: Quantity of each entry id that no default close has taken yet, entry ids of this position, partial exits done.
    unclosed: dict = field(default_factory=dict)
    cycle: set = field(default_factory=set)
    done_partials: set = field(default_factory=set)
    entries: int = 0
    fills: int = 0
    #: Number, profit and percents of trades won (1), lost (-1) and even (0).
    tally: dict = field(default_factory=lambda: {k: [0, 0.0, 0.0] for k in (1, -1, 0)})

    # --- what a strategy reads -------------------------------------------------------------

    @property
    def sign(self) -> int:
        return 0 if not self.lots else 1 if self.lots[0].long else -1

    @property
    def held(self) -> float:
        return sum(x.qty for x in self.lots)

    @property
    def position(self) -> float:
        """Signed quantity."""
        return self.sign * self.held

    @property
    def average_price(self) -> float | None:
        held = self.held
        return sum(x.qty * x.price for x in self.lots) / held if held else None

    @property
    def fx(self) -> float:
        """Worth of the instrument's currency in the account's, at the bar's time."""
        rates = self.account.rates
        k = bisect_right(rates, self.ts, key=lambda point: point[0]) if rates else 0
        return rates[k - 1][1] if k else self.account.rate

    @property
    def worth(self) -> float:
        return self.account.point_value * self.fx

    def open_profit(self, price: float) -> float:
        return sum((price - x.price) * (x.qty if x.long else -x.qty) for x in self.lots) * self.worth

    def equity(self, price: float | None = None) -> float:
        return self.account.capital + self.realised + self.open_profit(self.close_price if price is None else price)

    def open_trades(self) -> list[dict]:
        """The open lots, oldest first, marked at the close: profit is net of the entry's fee."""
        rows = []
        for k, x in enumerate(self.lots):
            sign, cost = (1 if x.long else -1), x.price * x.qty * self.worth
            fee = self._fee(x.price, x.qty)
            profit = (self.close_price - x.price) * sign * x.qty * self.worth - fee
            up, down = self._excursions(x, x.qty)
            rows.append(
                {"trade": k, "entry_id": x.id, "is_long": x.long, "entry_ts": x.ts, "entry_bar": x.bar, "entry_price": x.price, "qty": x.qty, "profit": profit, "profit_pct": profit / cost * 100 if cost > 0 else None}
                | {"commission": fee, "max_run_up": up * self.worth, "max_drawdown": down * self.worth, "max_run_up_pct": up / (x.price * x.qty) * 100 if cost > 0 else 0.0, "max_drawdown_pct": down / (x.price * x.qty) * 100 if cost > 0 else 0.0, "comment": x.comment}
            )
        return rows

    def state(self) -> dict:
        """What a strategy may ask of its account, at the close; averages over nothing are 0."""
        won, lost, even = (self.tally[k] for k in (1, -1, 0))
        every = [a + b + c for a, b, c in zip(won, lost, even)]
        mean = lambda some, k: some[k] / some[0] if some[0] else 0.0
        capital, now = self.account.capital, self.open_profit(self.close_price)
        percent = lambda x: x / capital * 100 if capital > 0 else 0.0
        return {
            "equity": self.equity(), "initial_capital": capital, "net_profit": self.realised, "net_profit_pct": percent(self.realised), "open_profit": now, "open_profit_pct": now / (capital + self.realised) * 100 if capital + self.realised else 0.0,
            "gross_profit": won[1], "gross_profit_pct": percent(won[1]), "gross_loss": -lost[1], "gross_loss_pct": percent(-lost[1]),
            "closed_trades": every[0], "open_trades": len(self.lots), "win_trades": won[0], "loss_trades": lost[0], "even_trades": even[0],
            "avg_trade": mean(every, 1), "avg_trade_pct": mean(every, 2), "avg_winning_trade": mean(won, 1), "avg_winning_trade_pct": mean(won, 2), "avg_losing_trade": mean(lost, 1), "avg_losing_trade_pct": mean(lost, 2),
            "position_size": self.position, "position_avg_price": self.average_price, "position_entry_name": self.lots[-1].id if self.lots else "", "capital_held": self.held * (self.average_price or 0.0) * self.account.point_value,
            "max_drawdown": self.max_drawdown, "max_run_up": self.max_run_up, "max_contracts_held_all": self.most_held["all"], "max_contracts_held_long": self.most_held["long"], "max_contracts_held_short": self.most_held["short"],
            "margin_liquidation_price": self.liquidation_price(),
        }

    def liquidation_price(self) -> float | None:
        """The price at which equity just meets the margin, snapped away from the position."""
        margin = self._margin_share()
        if not self.lots or margin is None or not self.account.point_value > 0:
            return None
        sign, room = self.sign, margin - self.sign
        if abs(room) < 1e-12:
            return None
        basis = (self.account.capital + self.realised) / self.fx
        price = (basis / (self.held * self.account.point_value) - sign * self.average_price) / room
        tick = self.account.tick
        return (math.ceil(price / tick) if sign < 0 else math.floor(price / tick)) * tick if tick > 0 else price

    # --- what a strategy calls -------------------------------------------------------------

    def entry(self, id: str, long: bool, qty: float | None = None, limit: float | None = None, stop: float | None = None, group: str | None = None, grouped: str = "none", sizing: str | None = None, comment: str = "") -> None:
        """Open or add; against the position it reverses. An order of the same id is replaced in its place."""
        self._put(Order(id, "entry", long, qty, limit, stop, group=group, grouped=grouped, sizing=sizing, comment=comment))

    def order(self, id: str, long: bool, qty: float | None = None, limit: float | None = None, stop: float | None = None, group: str | None = None, grouped: str = "none", sizing: str | None = None, comment: str = "") -> None:
        """Open or add; against the position it closes all of it, and opens nothing."""
        self._put(Order(id, "order", long, qty, limit, stop, group=group, grouped=grouped, sizing=sizing, comment=comment))

    def exit(
        self,
        id: str,
        of: str | None = None,
        qty: float | None = None,
        limit: float | None = None,
        stop: float | None = None,
        trail: float | None = None,
        trail_from: float | None = None,
        trail_points: float | None = None,
        profit: float | None = None,
        loss: float | None = None,
        percent: float | None = None,
        group: str | None = None,
        comment: str = "",
    ) -> None:
        """Bracket: the first of limit, stop and trailing stop that is touched closes; once an entry ``of`` has filled.

        ``trail`` is a distance in price, from the best price since ``trail_from``, or since ``trail_points``
        ticks of profit; without it the stop is that very price. ``profit`` and ``loss`` are ticks from the entry. ``qty``
        or ``percent`` take a part, once in a position for each id; exits of one entry share its quantity
        in the sequence of their making. Without a price it takes back an exit of the same id.
        """
        before = [o for o in self.orders if o.kind == "exit" and (o.id, o.of) == (id, of)]
        if all(x is None for x in (limit, stop, trail, trail_from, trail_points, profit, loss)):
            self.orders = [o for o in self.orders if o not in before]
            return
        live, share = self.held, min(max(100.0 if percent is None else percent, 0.0), 100.0)
        if qty is not None and live > TINY:
            share = min(qty, live) / live * 100
        partial = share < 100 - WHOLE
        if partial and live > TINY and id in self.done_partials:
            return
        slot = self.orders.index(before[0]) if before else None
        self.orders = [o for o in self.orders if o not in before]
        new = Order(id, "exit", False, None, limit, stop, trail, trail_from, trail_points, profit, loss, share, None, of, group, "cancel", comment)
        new.best = before[0].best if before and new.trails else None
        if new.trails and not before and self.lots:
            new.best = self.close_price
        if live <= TINY:
            new.reserved = qty
        elif not self._reserve(new, qty, before[0].reserved if before else None):
            return
        new.partial = partial if live <= TINY or new.reserved is None else new.reserved < live - WHOLE
        self._place(new, slot)

    def close(self, of: str | None = None, qty: float | None = None, percent: float | None = None, immediately: bool = False, comment: str = "") -> None:
        """Close lots at the next open, or at this close. By default an entry's quantity is taken from the oldest lots, once."""
        if not self.lots:
            return
        any_lot = self.account.closing == "ANY"
        if of is not None and not any_lot and qty is None and percent is None:
            target = min(self.unclosed.get(of, 0.0), self.held)
            if target <= TINY:
                return
            self.unclosed[of] -= target
        else:
            own = self.held if of is None else sum(x.qty for x in self.lots if x.id == of)
            target = own if qty is None and percent is None else min(max(qty, 0.0), own) if qty is not None else own * min(max(percent, 0.0), 100.0) / 100
            if target <= TINY:
                return
        whole = target >= self.held - TINY
        if whole:
            self.orders = [o for o in self.orders if not (o.kind == "exit" and o.of == of)]
        new = Order(CLOSE + (of or ""), "close", False, None if whole else target, of=of if any_lot and not whole else None, comment=comment)
        if immediately or self.account.on_close:
            self._leave(new, self.close_price, False)
        else:
            self._place(new)

    def cancel(self, id: str | None = None) -> None:
        self.orders = [o for o in self.orders if id is not None and o.id != id]

    def _put(self, new: Order) -> None:
        for k, old in enumerate(self.orders):
            if (old.id, old.kind) == (new.id, new.kind):
                del self.orders[k]
                self._place(new, k)
                return
        self._place(new)

    def _place(self, new: Order, at: int | None = None) -> None:
        new.born, new.side = self.bar, self.sign
        if new.kind in ("entry", "order") and self.sign and (self.sign > 0) != new.long:
            new.carry = self.held
        self.orders.insert(len(self.orders) if at is None else at, new)

    def _reserve(self, new: Order, qty: float | None, before: float | None) -> bool:
        """Set aside what the exit takes of the position, after its siblings; False if nothing is left for it."""
        live = self.held
        siblings = [o for o in self.orders if o.kind == "exit" and o.of == new.of]
        taken = sum(o.reserved if o.reserved is not None else live * o.percent / 100 for o in siblings)
        coming = [o for o in self.orders if o.kind in ("entry", "order") and o.id == new.of and not self._full(o)]
        if qty is not None:
            room = live
            if coming:
                room = sum(x.qty for x in self.lots if x.id == new.of) + sum(math.inf if o.qty is None else o.qty for o in coming)
            new.reserved = min(qty, max(0.0, room - taken))
            return new.reserved > TINY
        if new.of is not None and new.percent >= 100 - WHOLE and any(o.qty is None and (self.sign > 0) != o.long for o in coming):
            return True  # it is for the entry that is to reverse the position
        left = max(0.0, live - taken)
        if before is not None and new.percent < 100 - WHOLE:
            new.reserved = min(before, live)
        else:
            asked = live * new.percent / 100
            new.reserved = min(self._floored(asked) if new.percent < 100 - WHOLE else asked, left)
        if new.reserved <= TINY:
            return False
        new.percent = new.reserved / live * 100
        return not (new.reserved < live - WHOLE and any(o.percent >= 100 - WHOLE for o in siblings))

    def _floored(self, qty: float) -> float:
        lot = self.account.lot
        return min(qty, math.floor(qty / lot + 1e-6) * lot) if lot > 0 and qty > 0 else qty

    # --- a bar -----------------------------------------------------------------------------

    def advance(self, ts: object, o: float, h: float, low: float, c: float, path: list[float] | None = None, jumps: frozenset[int] = frozenset(), again: Callable[[], None] | None = None) -> None:
        """Fill what the bar fills, in the sequence of its path; ``again`` runs the strategy anew after each fill.

        ``path`` are prices from open to close; on its legs in ``jumps`` the price leaps.
        """
        self.bar, self.ts, self.close_price = self.bar + 1, ts, c
        self._new_day()
        self._risk()
        corners = path or ([o, h, low, c] if abs(h - o) < abs(o - low) else [o, low, h, c])
        at, runs = 0.0, 0
        while (found := self._next(corners, jumps, at)) is not None:
            touch, order = found
            at = touch.place
            if order not in self.orders:
                continue
            self.orders.remove(order)
            fills = self.fills
            self._fill(order, touch.price, touch.limit, corners, at)
            if again is not None and self.fills != fills and runs < 16 * len(corners):
                shown, self.close_price, runs = self.close_price, touch.price, runs + 1
                again()
                self.close_price = shown
        for order in self.orders:
            if order.kind == "exit" and order.trails and self.lots:
                self._follow(order, corners, len(corners) - 1.0)
        self.orders = [x for x in self.orders if x.kind != "close" or x.born == self.bar]
        self._extremes(h, low, c)

    def settle(self, h: float | None = None, low: float | None = None) -> None:
        """After the strategy has run: orders at the close if the account fills there, margin, and the day's extremes."""
        if self.account.on_close:
            for order in list(self.orders):
                touch = self._at_close(order) if order in self.orders else None
                if touch is not None:
                    self.orders.remove(order)
                    self._fill(order, touch.price, touch.limit, [self.close_price], 0.0)
        if h is not None and low is not None:
            self._margin_call(low if self.sign > 0 else h)
        now = self.equity()
        if now > self.peak:
            self.peak = self.trough = now
        self.trough = min(self.trough, now)
        self.max_drawdown, self.max_run_up = max(self.max_drawdown, self.peak - now), max(self.max_run_up, now - self.trough)
        for side in ("all", "long" if self.sign > 0 else "short") if self.lots else ():
            self.most_held[side] = max(self.most_held[side], self.held)

    def _at_close(self, order: Order) -> Touch | None:
        """Where an order fills at this bar's close, if it does."""
        c = self.close_price
        if order.kind == "exit":
            if not self.lots or order.trails:
                return None
            long = self.sign > 0
            stop, limit = self._levels(order)
            if stop is not None and (c <= stop if long else c >= stop):
                return Touch(0.0, c, 0)
            return Touch(0.0, c, 2, True) if limit is not None and (c >= limit if long else c <= limit) else None
        if order.kind == "close":
            return Touch(0.0, c, 0) if self.lots else None
        if order.stop is not None:
            return None
        if order.limit is None:
            return Touch(0.0, c, 0)
        return Touch(0.0, c, 2, True) if (c <= order.limit if order.long else c >= order.limit) else None

    def _new_day(self) -> None:
        ts, zone = self.ts, self.account.zone
        if zone not in ("", "UTC", "Etc/UTC") and hasattr(ts, "astimezone"):
            local = (ts.replace(tzinfo=ZoneInfo("UTC")) if ts.tzinfo is None else ts).astimezone(ZoneInfo(zone))
            day = str(local)[:10]
        else:
            day = str(ts)[:10]
        if day != self.day:
            self.day, self.filled_today, self.capped, self.day_profit = day, 0, False, 0.0

    def _risk(self) -> None:
        """Limits on losses: once one is passed, nothing is entered any more."""
        a = self.account
        limits = (
            self.max_drawdown >= min(a.max_drawdown, self.peak * a.max_drawdown_percent / 100 if self.peak > 0 and a.max_drawdown_percent < math.inf else math.inf),
            -self.day_profit >= min(a.max_day_loss, self.equity() * a.max_day_loss_percent / 100 if a.max_day_loss_percent < math.inf else math.inf) and self.day_profit < 0,
            0 < a.max_loss_days <= self.loss_days,
        )
        if any(limits):
            self.halted = True

    def _next(self, corners: list[float], jumps: frozenset[int], since: float) -> tuple[Touch, Order] | None:
        """The first fill at or after ``since``; at one place stops precede limits, then the older order."""
        best: tuple[tuple, Touch, Order] | None = None
        for k, order in enumerate(self.orders):
            touch = self._touch(order, corners, jumps, since)
            if touch is None:
                continue
            # Of two opposite stops at one place the long one is first.
            rank = touch.place, touch.rank, 0 if order.kind != "entry" or order.stop is None or order.long else 1, k
            if best is None or rank < best[0]:
                best = rank, touch, order
        return None if best is None else (best[1], best[2])

    def _levels(self, order: Order) -> tuple[float | None, float | None]:
        """Stop and limit of an exit, of which those in ticks are counted from the entry."""
        stop, limit = order.stop, order.limit
        if self.lots and order.kind == "exit":
            step, price = self.sign * self.account.tick, self.average_price
            limit = price + order.profit * step if limit is None and order.profit is not None else limit
            stop = price - order.loss * step if stop is None and order.loss is not None else stop
        return stop, limit

    def _touch(self, order: Order, corners: list[float], jumps: frozenset[int], since: float) -> Touch | None:
        """Where the order first fills from ``since`` on."""
        if order.kind in ("exit", "close"):
            return self._exit_touch(order, corners, jumps, since)
        if self.account.on_close and order.born == self.bar and not (order.limit is not None and order.stop is None):
            return None
        buy = order.long
        if not order.priced:
            return Touch(since, _price(corners, since), 0) if since == 0 or order.born == self.bar else None
        if order.limit is not None and order.stop is not None:
            opened = _reach(corners, jumps, order.stop, buy, since)  # a stop that arms a limit
            if opened is None:
                return None
            within = opened[1] <= order.limit if buy else opened[1] >= order.limit
            done = opened if within else _reach(corners, jumps, order.limit, not buy, opened[0])
            return None if done is None else Touch(*done, 2, True)
        if order.stop is not None:
            hit = _reach(corners, jumps, order.stop, buy, since)
            if hit is None:
                return None
            return Touch(hit[0], self._up(hit[1], buy) if hit[0] > 0 else hit[1], 0)
        hit = _reach(corners, jumps, order.limit, not buy, since)
        return None if hit is None else Touch(hit[0], hit[1], 2, True)

    def _exit_touch(self, order: Order, corners: list[float], jumps: frozenset[int], since: float) -> Touch | None:
        if not self.lots or order.of is not None and order.kind == "exit" and order.of not in self.cycle:
            return None
        if order.kind == "close":
            stale = self.lots[0].bar > order.born or since > 0 and order.born != self.bar
            return None if stale else Touch(since, _price(corners, since), 0)
        buy = not self.lots[0].long
        stop, limit = self._levels(order)
        if self.lots[0].bar == self.bar and self.lots[0].inside:  # levels that the entry already lies beyond wait
            price = self.average_price
            if stop is not None and (stop < price if buy else stop > price) or limit is not None and (limit > price if buy else limit < price):
                return None
        found = []
        if stop is not None and (hit := _reach(corners, jumps, stop, buy, since)):
            found.append(Touch(*hit, 0))
        if order.trails and (trailed := self._follow(replace(order), corners, None, since)):
            found.append(Touch(*trailed, 1))
        if limit is not None and (hit := _reach(corners, jumps, limit, not buy, since)):
            found.append(Touch(*hit, 2, True))
        return min(found, key=lambda t: (t.place, t.rank)) if found else None

    def _follow(self, order: Order, corners: list[float], until: float | None, since: float | None = None) -> tuple[float, float] | None:
        """(place, price) where a trailing stop is touched; with ``until`` it only follows the best price, which is kept."""
        buy = not self.lots[0].long
        sign, tick = (-1 if buy else 1), self.account.tick
        start = order.trail_from
        if order.trail_points is not None:
            start = self.average_price + sign * math.ceil(order.trail_points) * tick
        entered = self.lots[0].bar == self.bar
        since = 0.0 if since is None else since
        best = order.best
        if entered and best is None:
            best = self.average_price
        beyond = lambda price: start is None or sign * (price - start) >= 0
        one_shot = order.trail is None or order.trail == 0
        armed = best is not None and beyond(best) and not (order.trail == 0)
        for leg in range(int(since), len(corners) - 1):
            a, b = corners[leg], corners[leg + 1]
            origin = a
            if leg < since:
                a = a + (b - a) * (since - leg)
            if until is None and leg == 0 and since == 0 and not entered:  # a gap
                level = start if one_shot else best - sign * order.trail if best is not None and armed else None
                if level is not None and (sign * (a - level) >= 0 if one_shot else sign * (level - a) >= 0):
                    return 0.0, a
            place = lambda level: leg + ((level - origin) / (b - origin) if b != origin else 0.0)  # noqa: E731,B023
            if sign * (b - a) > 0:
                if until is None and one_shot and start is not None and sign * (b - start) >= 0 and sign * (start - a) >= 0:
                    return place(start), start
                best = b if best is None or sign * (b - best) > 0 else best
                armed = beyond(best) and order.trail != 0
            elif until is None and armed and order.trail:
                level = best - sign * order.trail
                if sign * (level - a) >= 0:
                    return max(float(leg), since), a
                if sign * (level - b) >= 0:
                    return place(level), level
        if until is not None:
            order.best = best
        return None

    # --- fills -----------------------------------------------------------------------------

    def _up(self, price: float, buy: bool) -> float:
        tick = self.account.tick
        return price if not tick > 0 else (math.ceil(price / tick - 1e-9) if buy else math.floor(price / tick + 1e-9)) * tick

    def _snapped(self, price: float, buy: bool, limit: bool) -> float:
        """Slipped against the trader by ticks, and snapped to a tick likewise; a limit doesn't slip and is snapped in favour."""
        if limit:
            return self._up(price, not buy)
        return self._up(price + self.account.slippage * self.account.tick * (1 if buy else -1), buy)

    def _fill(self, order: Order, price: float, limit: bool, corners: list[float], place: float) -> None:
        if order.kind in ("exit", "close"):
            self._leave(order, price, limit, corners, place)
            return
        if self.capped:
            return
        before = self.fills, self.held
        if order.kind == "order":
            self._raw(order, price, limit, place)
        else:
            self._enter(order, price, limit, place)
        if self.fills == before[0]:
            return
        self._group(order, abs(self.held - before[1]))
        self.filled_today += 1
        if self.filled_today >= self.account.max_orders_a_day:
            self.capped, self.orders = True, []
            if self.lots:
                self._leave(Order(CLOSE, "close", False, comment="limit of orders a day"), price, False)

    def _group(self, order: Order, filled: float) -> None:
        if order.group is None or order.grouped == "none":
            return
        left = []
        for o in self.orders:
            if o.group != order.group or o.id == order.id:
                left.append(o)
            elif order.grouped == "reduce" and o.qty is not None and o.qty - filled > 1e-12:
                o.qty -= filled
                left.append(o)
        self.orders = left

    def _allowed(self, long: bool) -> bool:
        a = self.account
        return not self.halted and a.direction in ("both", "long" if long else "short") and self.held < a.max_position

    def _full(self, order: Order) -> bool:
        """Whether the limit on entries keeps an order in the position's direction out; not one armed from elsewhere."""
        if self.sign == 0 or (self.sign > 0) != order.long:
            return False
        return self.entries >= self.account.pyramiding and not (order.priced and order.side != self.sign)

    def _enter(self, order: Order, price: float, limit: bool, place: float) -> None:
        want = 1 if order.long else -1
        if self.sign == -want and self.account.direction == ("short" if order.long else "long"):
            self._close(math.inf, None, self._snapped(price, order.long, limit), order.id, order.comment)
            return
        if not self._allowed(order.long) or self._full(order):
            return
        at = self._snapped(price, order.long, limit)
        qty = self._quantity(order, at)
        if self.sign == -want:
            if order.side == 0 and order.priced:  # armed when flat: it nets
                closed = min(qty, self.held)
                self._close(closed, None, at, order.id, order.comment)
                qty -= closed
            else:
                only = order.side not in (0, -want)
                self._close(math.inf, None, at, order.id, order.comment)
                qty = 0.0 if only else self._quantity(order, at)
            self._purge()
        elif self.sign == 0 and order.priced and order.side == -want:
            qty += order.carry
            for o in self.orders:
                o.carry = 0.0
        if qty > TINY and self._affordable(qty, at):
            self._open(order, qty, at, place)

    def _raw(self, order: Order, price: float, limit: bool, place: float) -> None:
        want = 1 if order.long else -1
        at = self._snapped(price, order.long, limit)
        if self.sign == -want:
            self._close(math.inf, None, at, order.id, order.comment)
            self._purge()
        elif not self._full(order) and self._allowed(order.long):
            qty = self._quantity(order, at)
            if qty > TINY:
                self._open(order, qty, at, place)

    def _open(self, order: Order, qty: float, price: float, place: float) -> None:
        if not self.lots:
            self.unclosed, self.cycle, self.done_partials, self.entries = {}, set(), set(), 0
        self.lots.append(Lot(order.id, order.long, qty, price, self.bar, self.ts, price, price, order.comment, place > 0, bool(self.lots) and not order.priced))
        self.unclosed[order.id] = self.unclosed.get(order.id, 0.0) + qty
        self.cycle.add(order.id)
        self.entries += 1
        self.fills += 1

    def _leave(self, order: Order, price: float, limit: bool, corners: list[float] | None = None, place: float = 0.0) -> None:
        """An exit or a close: its quantity, its share, or all."""
        if not self.lots:
            return
        held, done = self.held, len(self.trades)
        at = self._snapped(price, not self.lots[0].long, limit)
        own = order.of if self.account.closing == "ANY" else None
        qty = order.reserved if order.kind == "exit" else order.qty
        if qty is None:
            part = sum(x.qty for x in self.lots if own in (None, x.id)) * order.percent / 100
            qty = math.inf if order.percent >= 100 - WHOLE else self._floored(part)
        self._close(qty, own, at, order.id, order.comment, corners, place)
        if order.kind == "exit" and order.partial and len(self.trades) > done:
            self.done_partials.add(order.id)
        if order.kind == "exit" and order.of is not None and self.lots:
            self._cover(order, at)
        if not self.lots:
            self._purge()
        elif order.kind == "exit":
            self.entries = max(self.entries, len(self.lots))
        else:
            self.entries = len(self.lots)
        self._group(order, held - self.held)

    def _cover(self, order: Order, price: float) -> None:
        """A bracket that fills closes, at its price, what was added to its entry by market orders on this bar."""
        added = [x for x in self.lots if x.id == order.of and x.bar == self.bar and x.added]
        if added:
            kept = [x for x in self.lots if x not in added]
            self.lots = added
            self._close(math.inf, None, price, order.id, order.comment)
            self.lots = kept

    def _purge(self) -> None:
        """Without a position, exits go, but those of entries that are still to come."""
        coming = {o.id for o in self.orders if o.kind == "entry"}
        self.orders = [o for o in self.orders if o.kind not in ("exit", "close") or o.kind == "exit" and o.of in coming]

    def _quantity(self, order: Order, price: float) -> float:
        a = self.account
        kind, size = (order.sizing or "fixed", order.qty) if order.qty is not None else (a.sizing, a.size)
        if kind == "fixed":
            qty = size
        elif not price > 0 or not math.isfinite(price):
            return 0.0
        else:
            cash = self.equity(self.close_price) * size / 100 if kind == "percent" else size
            if kind == "percent" and a.fee == "percent":
                cash /= 1 + a.fee_value / 100
            qty = cash / self.fx / (price * a.point_value)
        return math.floor(qty / a.lot) * a.lot if a.lot > 0 and qty > 0 else qty

    def _fee(self, price: float, qty: float) -> float:
        a = self.account
        if a.fee == "percent":
            return price * qty * self.worth * a.fee_value / 100
        return a.fee_value if a.fee == "order" else a.fee_value * qty

    def _margin_share(self) -> float | None:
        a = self.account
        percent = a.margin if self.sign >= 0 or a.margin_short is None else a.margin_short
        return percent / 100 if percent > 0 else None

    def _affordable(self, qty: float, price: float) -> bool:
        margin = self._margin_share()
        return margin is None or (self.held + qty) * price * self.worth * margin <= self.equity(price) + 1e-9

    def _excursions(self, lot: Lot, qty: float) -> tuple[float, float]:
        """How far, in price times quantity, the lot was in profit and in loss."""
        up, down = (lot.high - lot.price, lot.price - lot.low) if lot.long else (lot.price - lot.low, lot.high - lot.price)
        return max(0.0, up * qty), max(0.0, down * qty)

    def _close(self, qty: float, of: str | None, price: float, exit_id: str, comment: str, corners: list[float] | None = None, place: float = 0.0) -> None:
        """Close lots first in, first out."""
        left = []
        for lot in self.lots:
            part = min(lot.qty, qty) if of in (None, lot.id) else 0.0
            if part <= TINY:
                left.append(lot)
                continue
            qty -= part
            seen = [price] + ([corners[k] for k in range(len(corners)) if k < place] if corners and not (lot.inside and lot.bar == self.bar) else [])
            lot.high, lot.low = max(lot.high, *seen), min(lot.low, *seen)
            fee_in, fee_out = self._fee(lot.price, part), self._fee(price, part)
            pnl = (price - lot.price) * part * (1 if lot.long else -1) * self.worth - fee_in - fee_out
            cost = lot.price * part * self.worth
            up, down = self._excursions(lot, part)
            self.trades.append(
                {"trade": len(self.trades) + 1, "entry_id": lot.id, "is_long": lot.long, "entry_ts": lot.ts, "entry_bar": lot.bar, "entry_price": lot.price, "exit_ts": self.ts, "exit_bar": self.bar, "exit_price": price, "qty": part}
                | {"pnl": pnl, "pnl_pct": pnl / cost * 100 if cost > 0 else 0.0, "commission": fee_in + fee_out, "max_run_up": max(0.0, up * self.worth - fee_in), "max_drawdown": down * self.worth + fee_in, "exit_id": exit_id, "entry_comment": lot.comment, "exit_comment": comment}
            )
            self._book(pnl, pnl / cost * 100 if cost > 0 else 0.0)
            if lot.qty - part > TINY:
                lot.qty -= part
                left.append(lot)
        self.lots = left

    def _book(self, pnl: float, percent: float) -> None:
        self.fills += 1
        own = self.tally[(pnl > 0) - (pnl < 0)]
        own[0], own[1], own[2] = own[0] + 1, own[1] + pnl, own[2] + percent
        self.realised += pnl
        self.day_profit += pnl
        if pnl < 0 and self.loss_day != self.day:
            self.loss_day, self.loss_days = self.day, self.loss_days + 1
        elif pnl > 0:
            self.loss_days = 0

    def _extremes(self, h: float, low: float, c: float) -> None:
        for lot in self.lots:
            seen = [c] if lot.inside and lot.bar == self.bar else [h, low, c]
            lot.high, lot.low = max(lot.high, *seen), min(lot.low, *seen)

    def _margin_call(self, worst: float) -> None:
        """At the worst price of the bar, four times the quantity that is short of margin is closed; at full margin a long never is."""
        margin = self._margin_share()
        if margin is None or not self.lots or not worst > 0 or self.sign > 0 and abs(margin - 1) < 1e-12:
            return
        unit = worst * self.worth * margin
        short, lot = self.held - self.equity(worst) / unit, self.account.lot
        if short <= TINY:
            return
        qty = 4 * short
        if lot > 0:
            qty = math.floor(4 * math.floor(short / lot) * lot / lot + 1e-6) * lot
            if qty <= TINY:
                if not (lot <= 1 and short < 1):
                    return
                qty = min(1.0, self.held)
        self._leave(Order("__margin__", "close", False, qty if qty < self.held - TINY else None, comment="Margin call"), worst, False)


def _price(corners: list[float], place: float) -> float:
    """The price at a place of the path."""
    leg = min(int(place), len(corners) - 2) if len(corners) > 1 else 0
    return corners[leg] + (corners[leg + 1] - corners[leg]) * (place - leg) if len(corners) > 1 else corners[0]


def _reach(corners: list[float], jumps: frozenset[int], level: float, rising: bool, since: float) -> tuple[float, float] | None:
    """(place, price) where the path first lies at or beyond ``level`` from ``since`` on; a gap fills at its far side."""
    sign = 1 if rising else -1
    if since == 0 and sign * (corners[0] - level) >= 0:
        return 0.0, corners[0]
    for leg in range(int(since), len(corners) - 1):
        origin, b = corners[leg], corners[leg + 1]
        a = origin + (b - origin) * (since - leg) if leg < since else origin
        if leg < since and sign * (a - level) > 0:
            return since, a
        if sign * (b - level) >= 0 and sign * (a - level) <= 0:
            if leg in jumps:
                return leg + 1.0, b
            place = leg + ((level - origin) / (b - origin) if b != origin else 0.0)
            return max(place, since), level
    return None
