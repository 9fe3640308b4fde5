"""Calendar parts, trading sessions and bar times in a time zone, as column expressions."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tickframe.plans.periods import calendar_period, tf_seconds


def zone_id(zone: str) -> str:
    """A zone as Spark knows it: 'UTC+2', 'GMT-0530' and 'UTC+5:30' are offsets east of Greenwich; other names stay."""
    if zone in ("", "UTC", "Etc/UTC", "GMT"):
        return "UTC"
    found = re.fullmatch(r"(?:UTC|GMT)([+-])(?:(\d{1,2})|(\d{1,2}):?(\d{2}))", zone)
    if not found:
        return zone
    sign, hours, minutes = found[1], int(found[2] or found[3]), int(found[4] or 0)
    if hours > 23 or minutes > 59:
        return zone
    return f"{sign}{hours:02}:{minutes:02}" if hours or minutes else "UTC"


def local(ts: Column, zone: str = "UTC") -> Column:
    """Wall-clock time of a UTC time."""
    zone = zone_id(zone)
    return ts if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def universal(wall: Column, zone: str = "UTC") -> Column:
    """UTC time of a wall-clock time; one that the clocks skip is the next that there is."""
    zone = zone_id(zone)
    return wall if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def part(name: str, ts: Column, zone: str = "UTC") -> Column:
    """year, month, dayofmonth, hour, minute, second; dayofweek counts from Sunday, 1; weekofyear from the first day on."""
    t = local(ts, zone)
    if name == "weekofyear":  # by Mondays since the year began, unlike ISO weeks
        return F.floor((F.dayofyear(t) - 1 + 7 - F.weekday(t)) / 7).cast("int")
    return getattr(F, name)(t)


def minute_of_day(ts: Column, zone: str = "UTC") -> Column:
    t = local(ts, zone)
    return F.hour(t) * 60 + F.minute(t)


# --- sessions -------------------------------------------------------------------------------


def parsed(session: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Windows as minutes of the day, and the days (Sunday is 1; none for all). What can't be read is left out."""
    body, _, days = session.strip().rpartition(":") if re.search(r":[1-7]+$", session.strip()) else (session.strip(), "", "")
    windows = []
    for window in body.split(","):
        found = re.fullmatch(r"\s*(\d{2})(\d{2})-(\d{2})(\d{2})\s*", window)
        if found:
            a, b, c, d = map(int, found.groups())
            windows.append((a * 60 + b, c * 60 + d))
    return windows, {int(d) for d in days}


def always(session: str) -> bool:
    return session.strip() in ("", "24x7")


def holds(session: str, seconds: int, zone: str = "UTC") -> bool:
    """As ``in_session``, of a time in seconds since 1970, outside of queries."""
    if always(session):
        return True
    windows, days = parsed(session)
    found = re.fullmatch(r"([+-])(\d\d):(\d\d)", zone_id(zone))
    if found:
        tz = dt.timezone(dt.timedelta(minutes=(1 if found[1] == "+" else -1) * (int(found[2]) * 60 + int(found[3]))))
    else:
        tz = ZoneInfo(zone_id(zone))
    t = dt.datetime.fromtimestamp(seconds, tz)
    m = t.hour * 60 + t.minute
    inside = any(a <= m < b if a <= b else m >= a or m < b for a, b in windows)
    return inside and (not days or t.isoweekday() % 7 + 1 in days)


def _on(days: set[int], ts: Column, zone: str) -> Column:
    return F.dayofweek(local(ts, zone)).isin(sorted(days)) if days else F.lit(True)


def in_session(session: str, ts: Column, zone: str = "UTC") -> Column:
    """Whether a time lies in ``HHMM-HHMM[,HHMM-HHMM…][:days]``; starts count, ends don't.

    Days count from Sunday, 1, and are those of the time itself. A window whose end is before its
    start runs over midnight; one that ends as it starts is empty.
    """
    if always(session):
        return F.lit(True)
    windows, days = parsed(session)
    m = minute_of_day(ts, zone)
    found = F.lit(False)
    for a, b in windows:
        found = found | ((m >= a) & (m < b) if a <= b else (m >= a) | (m < b))
    return found & _on(days, ts, zone)


def premarket(session: str, ts: Column, zone: str = "UTC") -> Column:
    """From 04:00 to the start of the session's first window, on its days."""
    windows, days = parsed(session)
    if always(session) or not windows:
        return F.lit(False)
    m = minute_of_day(ts, zone)
    return (m >= 240) & (m < windows[0][0]) & _on(days, ts, zone)


def postmarket(session: str, ts: Column, zone: str = "UTC") -> Column:
    """From the end of the session's first window to 20:00, on its days."""
    windows, days = parsed(session)
    if always(session) or not windows:
        return F.lit(False)
    m = minute_of_day(ts, zone)
    return (m >= windows[0][1]) & (m < 1200) & _on(days, ts, zone)


def first_bar(session: str, ts: str = "ts", zone: str = "UTC", keys: tuple[str, ...] = ("symbol",)) -> Column:
    """Whether a bar is in the session and the bar before it isn't."""
    own = in_session(session, F.col(ts), zone)
    return own & ~F.coalesce(F.lag(own).over(Window.partitionBy(*keys).orderBy(ts)), F.lit(False))


def last_bar(session: str, ts: str = "ts", zone: str = "UTC", keys: tuple[str, ...] = ("symbol",)) -> Column:
    """Whether a bar is in the session and the bar after it isn't, or there is none."""
    own = in_session(session, F.col(ts), zone)
    return own & ~F.coalesce(F.lead(own).over(Window.partitionBy(*keys).orderBy(ts)), F.lit(False))


# --- times of bars --------------------------------------------------------------------------


def day_open(ts: Column, zone: str = "UTC") -> Column:
    """UTC time of the local midnight before ``ts``; of the first hour where midnight is skipped."""
    return universal(F.date_trunc("day", local(ts, zone)).cast("timestamp_ntz"), zone)


def _session_zone(session: str, zone: str) -> tuple[str, str]:
    """A zone's name in the session's place is no session, and no zone either."""
    if not zone and ("/" in session or session.startswith(("GMT", "UTC"))):
        session = ""
    return session, zone or "UTC"


def _opened(ts: Column, tf: str, zone: str) -> Column:
    period = calendar_period(tf)
    if period:
        return universal(F.date_trunc(period, local(ts, zone)).cast("timestamp_ntz"), zone)
    size = tf_seconds(tf)
    if not 0 < size < 86_400:
        return ts
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(size))).cast("timestamp_ntz")


def time(ts: Column, tf: str = "", session: str = "", zone: str = "", chart: str = "1") -> Column:
    """UTC open of the bar of ``tf`` (by default the chart's) that holds ``ts``; NULL outside the session."""
    session, zone = _session_zone(session, zone)
    return F.when(in_session(session, ts, zone), _opened(ts, tf or chart or "1", zone))


def time_close(ts: Column, tf: str = "", session: str = "", zone: str = "", chart: str = "1") -> Column:
    """Where that bar ends: the next open within days, the last millisecond before it for days, weeks and months."""
    session, zone = _session_zone(session, zone)
    tf = tf or chart or "1"
    opened, period, size = _opened(ts, tf, zone), calendar_period(tf), tf_seconds(tf)
    if period:
        wall = F.date_trunc(period, local(ts, zone)).cast("timestamp_ntz")
        beyond = wall + F.expr({"DAY": "interval 1 day", "WEEK": "interval 7 days", "MONTH": "interval 1 month"}[period])
        closed = universal(beyond, zone) - F.expr("interval 1 millisecond")
    else:
        closed = opened + F.expr(f"interval {size} seconds") if 0 < size < 86_400 else opened
    return F.when(in_session(session, ts, zone), closed)


def trading_day(ts: Column, session: str, zone: str = "UTC") -> Column:
    """UTC open of the session that ``ts`` belongs to: today's, or yesterday's before its start; the UTC day if trade never stops."""
    windows, _ = parsed(session)
    if always(session) or not windows or windows[0] in ((0, 1440), (0, 0)):
        return F.date_trunc("day", ts).cast("timestamp_ntz")
    start = windows[0][0]
    day = F.when(minute_of_day(ts, zone) < start, day_open(ts - F.expr("interval 24 hours"), zone)).otherwise(day_open(ts, zone))
    return day + F.expr(f"interval {start} minutes")


def timestamp(year: Column, month: Column, day: Column, hour: Column | int = 0, minute: Column | int = 0, second: Column | int = 0, zone: str = "UTC") -> Column:
    """UTC time of the parts of a wall-clock time; parts beyond their range carry over."""
    column = lambda x: F.lit(x) if isinstance(x, int) else x
    months = F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), (month - 1).cast("int"))
    wall = months + F.make_dt_interval((day - 1).cast("int"), column(hour).cast("int"), column(minute).cast("int"), column(second).cast("decimal(18,6)"))
    return universal(wall, zone)
