"""Timeframe strings: their seconds, ratios, calendar periods and kinds."""

from __future__ import annotations

# Seconds of the units that a timeframe string may end with.
UNITS = {"S": 1, "D": 86_400, "W": 604_800}
PERIODS = {"D": "DAY", "W": "WEEK", "M": "MONTH"}


def tf_seconds(tf: str) -> int:
    """Seconds of a timeframe: minutes, or a number with S, D or W; -1 for months, 0 for none."""
    if not tf:
        return 0
    if tf[-1] == "M":
        return -1
    if tf[-1] in UNITS:
        return int(tf[:-1] or 1) * UNITS[tf[-1]]
    return int(tf) * 60


def tf_ratio(source: str, target: str) -> int:
    """Bars of ``source`` in one of ``target``: -1 for calendar months, -2 if the target is finer."""
    a, b = tf_seconds(source), tf_seconds(target)
    if b < 0:
        return -1
    return -2 if b < a else b // a


def calendar_period(tf: str) -> str | None:
    return PERIODS.get(tf[-1:]) if not tf[:-1].strip("1") else None


def unit(tf: str) -> str:
    """'ticks' for no timeframe, 'seconds', 'minutes', 'day', 'week' or 'month'."""
    return {"": "ticks", "S": "seconds", "D": "day", "W": "week", "M": "month"}.get(tf[-1:], "minutes")


def multiplier(tf: str) -> int:
    """The number before the unit, 1 if there is none."""
    return int(tf.rstrip("SDWM") or 1)


def is_intraday(tf: str) -> bool:
    return unit(tf) in ("seconds", "minutes")


def is_dwm(tf: str) -> bool:
    return unit(tf) in ("day", "week", "month")


def from_seconds(seconds: int) -> str:
    """The timeframe of so many seconds: whole weeks, days, minutes, or seconds."""
    for name, size in (("W", 604_800), ("D", 86_400)):
        if seconds % size == 0:
            return f"{seconds // size}{name}"
    return str(seconds // 60) if seconds % 60 == 0 else f"{seconds}S"
