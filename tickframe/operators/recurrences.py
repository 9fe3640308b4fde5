"""Indicators that depend on their own past: one grouped pass over each series computes all that are asked for.

Each spec turns NumPy columns into NumPy columns. Rows that miss a source are left out and get NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAN = float("nan")


@dataclass(frozen=True)
class Spec:
    """What to compute: output columns from input columns."""

    outputs: tuple[str, ...]
    inputs: tuple[str, ...]
    run: Callable[..., tuple[np.ndarray, ...]]


def _ema(x: np.ndarray, n: int) -> np.ndarray:
    a = 2.0 / (n + 1)
    return np.array(list(accumulate(x.tolist(), lambda p, v: a * v + (1 - a) * p)))


def _rma(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), NAN)
    if len(x) >= n:
        seed = [sum(x[:n].tolist()) / n]
        out[n - 1 :] = list(accumulate(seed + x[n:].tolist(), lambda p, v: (v + (n - 1) * p) / n))
    return out


def _shifted(fn: Callable[[np.ndarray, int], np.ndarray], x: np.ndarray, n: int) -> np.ndarray:
    """``fn`` from the first value on that isn't missing."""
    start = int(np.argmax(~np.isnan(x))) if len(x) and not np.isnan(x).all() else len(x)
    return np.concatenate([np.full(start, NAN), fn(x[start:], n)])


def _tr(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    """True range; the first is high - low."""
    before = np.concatenate([[NAN], c[:-1]])
    return np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before)))


def ema(x: str, n: int, out: str) -> Spec:
    return Spec((out,), (x,), lambda v: (_ema(v, n),))


def rma(x: str, n: int, out: str) -> Spec:
    return Spec((out,), (x,), lambda v: (_rma(v, n),))


def rsi(x: str, n: int, out: str) -> Spec:
    def run(v: np.ndarray) -> tuple[np.ndarray]:
        d = np.diff(v)
        up, down = _rma(np.maximum(d, 0), n), _rma(np.maximum(-d, 0), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
        return (np.concatenate([[NAN], r])[: len(v)],)

    return Spec((out,), (x,), run)


def macd(x: str, fast: int, slow: int, signal: int, out: str) -> Spec:
    def run(v: np.ndarray) -> tuple[np.ndarray, ...]:
        line = _ema(v, fast) - _ema(v, slow)
        smooth = _ema(line, signal)
        return line, smooth, line - smooth

    return Spec((out, f"{out}_signal", f"{out}_hist"), (x,), run)


def tsi(x: str, short: int, long: int, out: str) -> Spec:
    def run(v: np.ndarray) -> tuple[np.ndarray]:
        d = np.diff(v)
        twice = lambda y: _ema(_ema(y, long), short)
        bottom = twice(np.abs(d))
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.concatenate([[NAN], np.where(bottom == 0, NAN, twice(d) / bottom)])[: len(v)],)

    return Spec((out,), (x,), run)


HLC = ("high", "low", "close")


def atr(n: int, out: str) -> Spec:
    return Spec((out,), HLC, lambda h, low, c: (_rma(_tr(h, low, c), n),))


def keltner(x: str, n: int, mult: float, out: str) -> Spec:
    """Middle, upper, lower and the width as a share of the middle."""

    def run(v: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        mid = _ema(v, n)
        span = _tr(h, low, c)
        span[:1] = NAN
        wide = mult * _shifted(_ema, span, n)
        missing = np.where(np.isnan(wide), NAN, mid)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(mid == 0, NAN, 2 * wide / mid)
        return missing, mid + wide, mid - wide, share

    return Spec((out, f"{out}_upper", f"{out}_lower", f"{out}_width"), (x, *HLC), run)


def dmi(di: int, adx: int, out: str) -> Spec:
    def run(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        up, down = np.diff(h), -np.diff(low)
        move = lambda a, b: _rma(np.where((a > b) & (a > 0), a, 0.0), di)
        span = _rma(_tr(h, low, c)[1:], di)
        with np.errstate(divide="ignore", invalid="ignore"):
            plus, minus = (np.where(span == 0, NAN, 100 * m / span) for m in (move(up, down), move(down, up)))
            both = plus + minus
            dx = np.where(both == 0, 0.0, 100 * np.abs(plus - minus) / both)
        lead = lambda a: np.concatenate([[NAN], a])[: len(c)]
        return lead(plus), lead(minus), lead(_present(dx, adx))

    return Spec((f"{out}_plus", f"{out}_minus", f"{out}_adx"), HLC, run)


def _present(x: np.ndarray, n: int) -> np.ndarray:
    """RMA over the values that aren't missing."""
    out, there = np.full(len(x), NAN), ~np.isnan(x)
    out[there] = _rma(x[there], n)
    return out


def supertrend(factor: float, n: int, out: str) -> Spec:
    """The band that price trails, and its direction: -1 up, 1 down."""

    def run(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        wide = factor * _rma(_tr(h, low, c), n)
        value, way = np.full(len(c), NAN), np.full(len(c), NAN)
        upper = lower = side = None
        for i in np.flatnonzero(~np.isnan(wide)).tolist():
            mid, before = (h[i] + low[i]) / 2, c[i - 1] if i else NAN
            top, bottom = mid + wide[i], mid - wide[i]
            if side is None:
                side = -1.0 if c[i] > top else 1.0
            else:
                top = min(top, upper) if before <= upper else top
                bottom = max(bottom, lower) if before >= lower else bottom
            if side > 0 and c[i] > top or side < 0 and c[i] < bottom:
                side = -side
            upper, lower = top, bottom
            value[i], way[i] = (top if side > 0 else bottom), side
        return value, way

    return Spec((out, f"{out}_direction"), HLC, run)


def sar(start: float, step: float, most: float, out: str) -> Spec:
    """Parabolic stop and reverse; the first bar has none."""

    def run(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> tuple[np.ndarray]:
        found = np.full(len(c), NAN)
        if len(c) < 2:
            return (found,)
        rising = bool(c[1] > c[0])
        extreme, speed = (h[1] if rising else low[1]), start
        stop = low[0] if rising else h[0]
        for i in range(1, len(c)):
            stop += speed * (extreme - stop)
            turned = i == 1
            if low[i] < stop if rising else h[i] > stop:
                stop = max(h[i], extreme) if rising else min(low[i], extreme)
                rising, turned, speed = not rising, True, start
                extreme = h[i] if rising else low[i]
            better = h[i] > extreme if rising else low[i] < extreme
            if better and not turned:
                extreme, speed = (h[i] if rising else low[i]), min(speed + step, most)
            recent = slice(max(0, i - 2), i)  # not beyond the two bars before
            stop = min(stop, low[recent].min()) if rising else max(stop, h[recent].max())
            found[i] = stop
        return (found,)

    return Spec((out,), HLC, run)


def _index(turns: Callable[[np.ndarray, np.ndarray], np.ndarray], out: str) -> Spec:
    def run(c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.where((c[:-1] != 0) & turns(v[1:], v[:-1]), np.diff(c) / c[:-1], 0.0)
        return (np.array(list(accumulate(rate.tolist(), lambda p, r: p + r * p, initial=1.0)))[: len(c)],)

    return Spec((out,), ("close", "volume"), run)


def nvi(out: str) -> Spec:
    """Index from 1 that moves when volume falls."""
    return _index(np.less, out)


def pvi(out: str) -> Spec:
    """Index from 1 that moves when volume rises."""
    return _index(np.greater, out)


def heikin_ashi(out: str) -> Spec:
    def run(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        close = (o + h + low + c) / 4
        first = (o[:1] + c[:1]) / 2
        opened = np.array(list(accumulate(first.tolist() + close[:-1].tolist(), lambda p, x: (p + x) / 2)))[: len(c)]
        return opened, np.maximum(h, np.maximum(opened, close)), np.minimum(low, np.minimum(opened, close)), close

    return Spec(tuple(f"{out}_{c}" for c in ("open", "high", "low", "close")), ("open", *HLC), run)


def recur(df: DataFrame, specs: list[Spec], keys: tuple[str, ...] = ("symbol",), time: str = "ts") -> DataFrame:
    """``df`` with the outputs of all specs, by one shuffle on the series' keys and one pass over each.

    Other columns pass through as they came; outputs are arrays of numbers with a mask of what is missing.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for s in specs for o in s.outputs]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        found: dict[str, np.ndarray] = {}
        for spec in specs:
            columns = [found[c] if c in found else _floats(table[c]) for c in spec.inputs]
            there = ~np.isnan(np.stack(columns)).any(axis=0)
            results = spec.run(*[c[there] for c in columns]) if there.any() else [np.zeros(0)] * len(spec.outputs)
            for name, values in zip(spec.outputs, results):
                found[name] = np.full(table.num_rows, NAN)
                found[name][there] = values
        for name, values in found.items():
            table = table.append_column(name, pa.array(values, pa.float64(), mask=np.isnan(values)))
        return table

    return df.groupBy(*keys).applyInArrow(run, schema)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers, NaN where they are missing."""
    return pc.fill_null(column.cast(pa.float64()), NAN).to_numpy()
